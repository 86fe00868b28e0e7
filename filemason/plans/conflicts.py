"""Free names for destinations: ``stem_1.ext``, ``stem_2.ext``, … as if actions ran one after another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranking import CHUNK, rank_in_group, running_sum
from ..session import materialize

_NUMBERED = r"((?:_[1-9][0-9]*)+)$"


def _suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s).(\.[^.]+)$", 1)


def split_path(path: Column) -> Column:
    """``(folder, stem, ext)`` of a path, the folder with its closing slash."""
    name = F.substring_index(path, "/", -1)
    ext = _suffix(name)
    return F.struct(
        F.left(path, F.length(path) - F.length(name)).alias("folder"),
        F.left(name, F.length(name) - F.length(ext)).alias("stem"), ext.alias("ext"))


def numbered(path: Column, number: Column) -> Column:
    parts = split_path(path)
    tail = F.when(number == 0, F.lit("")).otherwise(F.concat(F.lit("_"), number.cast("string")))
    return X.let(parts, lambda p: F.concat(p["folder"], p["stem"], tail, p["ext"]))


def parent_name(path: Column) -> Column:
    """``(name, number)`` when the path reads ``name`` numbered once, else NULL."""
    def strip(p: Column) -> Column:
        tail = F.regexp_extract(p["stem"], r"_([1-9][0-9]{0,17})$", 1)
        base = F.left(p["stem"], F.length(p["stem"]) - F.length(tail) - 1)
        return F.when((tail != "") & (base != ""), F.struct(
            F.concat(p["folder"], base, p["ext"]).alias("name"), tail.cast("bigint").alias("number")))
    return X.let(split_path(path), strip)


def _ancestors(path: Column) -> Column:
    """Every name that could be numbered, once or again and again, into this one."""
    def strip(p: Column) -> Column:
        tail = F.regexp_extract(p["stem"], _NUMBERED, 1)
        base = F.left(p["stem"], F.length(p["stem"]) - F.length(tail))
        steps = F.split(F.substring(tail, 2, 2**30), "_")
        longer = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.concat(
            p["folder"], base, F.when(i == 0, F.lit("")).otherwise(
                F.concat(F.lit("_"), F.array_join(F.slice(steps, F.lit(1), i), "_"))), p["ext"]))
        return F.when((tail != "") & (base != ""), longer).otherwise(F.array().cast("array<string>"))
    return X.let(split_path(path), strip)


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Number the contested wishes of one family in order."""
    rows = rows.sort_values("order")
    taken = set(rows.loc[~rows["wish"], "name"])
    last: dict[str, int] = {}
    numbers = []
    wishes = rows[rows["wish"]]
    for name, folder, stem, ext in zip(wishes["name"], wishes["folder"], wishes["stem"], wishes["ext"]):
        number, path = last.get(name, 0), name
        if path in taken:
            while path in taken:
                number += 1
                path = f"{folder}{stem}_{number}{ext}"
            last[name] = number
        else:
            number = 0
        taken.add(path)
        numbers.append(number)
    return wishes[["order", "name"]].assign(number=numbers)


def resolve(wishes: DataFrame, existing: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(order, destination, final)`` for wishes ``(order, destination)``, given existing ``(path)``.

    ``order`` is a unique integer. A wish gets its destination if no existing file and no earlier wish
    holds it, else the first free number. Three cases:

    * a name wished once and free is taken as it is;
    * if no other wish is for one of its numbered forms, the number follows from the rank of the wish
      and the existing numbers below it (ranks and counts are range-partitioned, so one name may be
      wished by any share of all rows);
    * otherwise the family of such names is numbered one by one in a grouped task, but only as many
      wishes per name as its highest foreign number; the rest follow from the last number given.

    Existing names count as taken throughout; plans that free names they also wish go through ``chains``.
    """
    wishes = materialize(wishes.select("order", F.col("destination").alias("name")), "wishes")
    names = wishes.groupBy("name").agg(F.count("*").alias("n"))
    held = existing.select(F.col("path").alias("name")).distinct()
    names = materialize(names.join(held.withColumn("exists", F.lit(True)), "name", "left").withColumn(
        "exists", F.coalesce("exists", F.lit(False))), "names")
    needy = names.where("n > 1 OR exists")

    # Families: wished names under the topmost name that needs numbers and could be numbered into them.
    line = names.select("name", F.explode(F.concat(F.array("name"), _ancestors(F.col("name")))).alias("head"))
    line = line.join(needy.select(F.col("name").alias("head")), "head")
    family = line.groupBy("name").agg(F.min(F.struct(F.length("head"), F.col("head").alias("head")))["head"].alias("family"))
    shared = family.groupBy("family").agg(F.count("*").alias("members")).where("members > 1").select("family")
    family = materialize(family.join(shared.withColumn("contested", F.lit(True)), "family", "left").select(
        "name", "family", F.coalesce("contested", F.lit(False)).alias("contested")), "families")

    # Numbers already used under names that need numbers, by existing files.
    used = held.select(parent_name(F.col("name")).alias("p")).where("p IS NOT NULL").select("p.name", "p.number")
    used = materialize(used.join(family, "name", "left_semi").distinct(), "used")

    free = wishes.join(family, "name", "left_anti").select("order", "name", F.lit(0).cast("bigint").alias("number"))
    ranked = materialize(
        rank_in_group(wishes.join(family, "name"), ["name"], "order", "rank", chunk)
        .join(names.select("name", "exists"), "name"), "ranked")

    plain = ranked.where("NOT contested").withColumn("index", F.col("rank") - F.when(F.col("exists"), 0).otherwise(1))
    gaps = rank_in_group(used, ["name"], "number", "pos", chunk).select("name", (F.col("number") - F.col("pos")).alias("gap"))
    gaps = gaps.groupBy("name", "gap").agg(F.count("*").alias("skipped"))
    steps = plain.select("name", (F.col("index") * 2).alias("at"), F.lit(0).cast("bigint").alias("skipped"), "order", "index").unionByName(
        gaps.join(family.where("NOT contested"), "name", "left_semi").select(
            "name", (F.col("gap") * 2 + 1).alias("at"), "skipped", F.lit(None).cast("bigint").alias("order"),
            F.lit(None).cast("bigint").alias("index")))
    plain = running_sum(steps, ["name"], "at", F.col("skipped"), "shift", chunk).where("order IS NOT NULL").select(
        "order", "name", F.when(F.col("index") == 0, F.lit(0)).otherwise(F.col("index") + F.col("shift")).cast("bigint").alias("number"))

    every = free.unionByName(plain)
    if family.where("contested").isEmpty():
        return _named(every)

    # Contested families: fold the first wishes of each name, up to its highest foreign number.
    foreign = used.unionByName(
        names.select(parent_name(F.col("name")).alias("p")).where("p IS NOT NULL").select("p.name", "p.number"))
    foreign = foreign.groupBy("name").agg(F.max("number").alias("highest"))
    knotted = ranked.where("contested").join(foreign, "name", "left").withColumn(
        "folded", F.coalesce("highest", F.lit(0)) + 1)
    head = knotted.where(F.col("rank") <= F.col("folded"))
    parts = split_path(F.col("name"))
    events = head.select("family", "order", "name", F.lit(True).alias("wish")).unionByName(
        used.join(family.where("contested"), "name").select(
            "family", F.lit(-1).cast("bigint").alias("order"),
            numbered(F.col("name"), F.col("number")).alias("name"), F.lit(False).alias("wish"))
    ).unionByName(
        names.where("exists").join(family.where("contested"), "name").select(
            "family", F.lit(-1).cast("bigint").alias("order"), "name", F.lit(False).alias("wish")))
    folded = materialize(
        events.withColumn("p", parts).select("*", "p.*").drop("p").groupBy("family")
        .applyInPandas(_fold, "order bigint, name string, number bigint"), "folded")
    last = folded.groupBy("name").agg(F.max("number").alias("last"))
    tail = knotted.where(F.col("rank") > F.col("folded")).join(last, "name").select(
        "order", "name", (F.col("last") + F.col("rank") - F.col("folded")).alias("number"))

    return _named(every.unionByName(folded).unionByName(tail))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("order", F.col("name").alias("destination"), numbered(F.col("name"), F.col("number")).alias("final"))
