"""Plans whose actions depend on each other: names that one action frees or makes and another one takes.

Names are linked where an action can turn one into the other's business: a wished name with the numbered forms of it that are sources
or wishes themselves, and the source and destination of an action whose source another action may make. Only components
that hold such a source are folded, in order, one component after another inside a task; everything else goes by ranks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clustering import components
from ..session import materialize
from .conflicts import parent_name, split_path

PLACED = ["copy", "move", "rename"]
OUTCOME = "order bigint, status string, final string, origin string, made bigint"
#: Orders before all actions: names to watch, then names that files hold.
_WATCH, _HELD = -3, -2


def _hashed(name: str) -> Column:
    return F.xxhash64(name)


def tangled_names(todo: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``(name, family)`` of the names in components with a source that another action may make or whose name one may want, and
    ``(name)`` of these sources; None when there is no such component. ``todo`` has ``action_type``, ``source`` and ``target``."""
    kind = F.col("action_type")
    placed = todo.where(kind.isin(PLACED))
    wished = materialize(placed.select(F.col("target").alias("name")).distinct(), "wished")
    sources = todo.where(kind.isin(*PLACED, "delete")).select(F.col("source").alias("name")).distinct()
    up = lambda rows: rows.withColumn("up", parent_name(F.col("name"))["name"])
    above = wished.select(F.col("name").alias("up"))
    same = sources.join(wished, "name", "left_semi").select("name", F.col("name").alias("up"))
    linked = materialize(same.unionByName(up(sources).join(above, "up").select("name", "up")), "linked")
    if linked.isEmpty():
        return None
    watched = linked.select("name").distinct()
    between = up(wished).join(above, "up").select(F.col("name").alias("a"), F.col("up").alias("b"))
    acts = placed.join(watched.select(F.col("name").alias("source")), "source", "left_semi").select(F.col("source").alias("a"), F.col("target").alias("b"))
    links = linked.select(F.col("name").alias("a"), F.col("up").alias("b")).unionByName(between).unionByName(acts)
    # Components of 64-bit hashes: far smaller than paths in every round. Two names that share a hash only join their families, and families
    # folded together come out as they do apart.
    known = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", _hashed("a").alias("hash_a"), _hashed("b").alias("hash_b"))
    known = materialize(known, "links")
    rooted = components(known.select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b")))
    every = known.select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("hash_a").alias("seq")),
                                           F.struct(F.col("b").alias("name"), F.col("hash_b").alias("seq")))).alias("n")).select("n.*").distinct()
    names = materialize(every.join(rooted, "seq", "left").select("name", F.coalesce("root", "seq").alias("family")), "names")
    knotted = names.join(watched, "name", "left_semi").select("family").distinct()
    return materialize(names.join(knotted, "family", "left_semi").select("name", "family"), "tangled"), materialize(watched, "watched")


class _Family:
    """What is taken in one component while its actions run. Of the numbers under a wished name all below ``next`` are taken but those
    given back, so only held names, watched ones and numbers given back are remembered, not every name given out."""

    def __init__(self) -> None:
        self.watched: dict[str, tuple[str | None, int]] = {}
        self.taken: dict[str, tuple[str, int] | None] = {}
        self.next: dict[str, int] = {}
        self.back: dict[str, list[int]] = {}
        self.free: dict[str, set[int]] = {}

    def holds(self, name: str, parent: str | None, number: int) -> bool:
        return name in self.taken or (number < self.next.get(parent, 0) and number not in self.free.get(parent, ()))

    def wish(self, target: str, parent: str | None, number: int, folder: str, stem: str, ext: str) -> str:
        """The name that a file wished at ``target`` gets; it is not yet taken."""
        if not self.holds(target, parent, number):
            return target
        waiting, free = self.back.get(target, []), self.free.get(target, set())
        while waiting:
            k = heapq.heappop(waiting)
            if k in free:
                free.discard(k)
                name = f"{folder}{stem}_{k}{ext}"
                if name not in self.taken:
                    return name
        k = self.next.get(target, 1)
        while (name := f"{folder}{stem}_{k}{ext}") in self.taken:
            k += 1
        self.next[target] = k + 1
        return name

    def take(self, name: str, target: str, origin: str, order: int) -> None:
        if name in self.watched:
            self.taken[name] = (origin, order)
            parent, number = self.watched[name]
            self.free.get(parent, set()).discard(number)
        elif name == target:
            self.taken[name] = None

    def release(self, name: str) -> None:
        del self.taken[name]
        parent, number = self.watched[name]
        if number < self.next.get(parent, 0):
            self.free.setdefault(parent, set()).add(number)
            heapq.heappush(self.back.setdefault(parent, []), number)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs the actions of sorted components one after another."""
    current, state = None, _Family()
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if row.family != current:
                current, state = row.family, _Family()
            if row.order == _WATCH:
                state.watched[row.source] = (row.parent, row.number)
                continue
            if row.order == _HELD:
                state.taken[row.source] = (row.source, -1) if row.source in state.watched else None
                continue
            if row.source in state.watched:
                found = state.taken.get(row.source)
            else:
                found = (row.source, -1) if row.ok else None
            if found is None:
                out.append((row.order, "nothing to delete" if row.action_type == "delete" else "failed", None, None, None))
                continue
            final = None
            if row.action_type != "delete":
                final = state.wish(row.target, row.parent, row.number, row.folder, row.stem, row.ext)
            if row.action_type != "copy" and row.source in state.watched:
                state.release(row.source)
            if final is not None:
                state.take(final, row.target, found[0], row.order)
            out.append((row.order, "executed", final, *found))
        yield pd.DataFrame(out, columns=["order", "status", "final", "origin", "made"]).astype({"order": "int64", "made": "Int64"})


def run_chained(todo: DataFrame, files: DataFrame, names: DataFrame, watched: DataFrame) -> DataFrame:
    """``(order, status, final, origin, made)`` of the actions that touch a tangled name, as if they ran one after another.

    ``todo`` has ``order``, ``action_type``, ``source``, ``target`` and ``ok``: whether the source is there, for sources that no other
    action may make. ``origin`` is the inventory path of the file that an executed action worked on, and ``made`` the order of
    the action that put it where it was (-1: it was there from the beginning).
    """
    kind = F.col("action_type")
    by_source = todo.join(names.select(F.col("name").alias("source"), F.col("family").alias("of_source")), "source", "left")
    both = by_source.join(names.select(F.col("name").alias("target"), F.col("family").alias("of_target")), "target", "left")
    family = F.coalesce(F.when(kind.isin(PLACED), F.col("of_target")), "of_source")
    up, parts = parent_name(F.col("target")), split_path(F.col("target"))
    none = lambda t: F.lit(None).cast(t)
    acts = both.withColumn("family", family).where("family IS NOT NULL").select(
        "family", "order", "action_type", "source", "target", "ok", up.alias("p"), parts.alias("s")).select(
        "family", "order", "action_type", "source", "target", "ok", F.col("p.name").alias("parent"),
        F.coalesce("p.number", F.lit(0)).alias("number"), "s.folder", "s.stem", "s.ext")

    def told(rows: DataFrame, order: int) -> DataFrame:
        return rows.select("family", F.lit(order).cast("bigint").alias("order"), F.lit("").alias("action_type"), F.col("name").alias("source"),
                           none("string").alias("target"), F.lit(True).alias("ok"), F.col("p.name").alias("parent"),
                           F.coalesce("p.number", F.lit(0)).alias("number"), *(none("string").alias(c) for c in ("folder", "stem", "ext")))

    held = files.select(F.col("path").alias("name")).distinct().withColumn("p", parent_name(F.col("name")))
    near = held.select("name", "p", F.explode(F.array_compact(F.array("name", "p.name"))).alias("at")).join(
        names.select(F.col("name").alias("at"), "family"), "at").select("name", "p", "family").distinct()
    watch = names.join(watched, "name", "left_semi").withColumn("p", parent_name(F.col("name")))
    events = acts.unionByName(told(near, _HELD)).unionByName(told(watch, _WATCH))
    dealt = events.repartition("family").sortWithinPartitions("family", "order")
    return dealt.mapInPandas(_fold, OUTCOME)
