"""Exact k nearest vectors by cosine, with a two-level tree of pivots that grows with the data.

Each vector belongs to the nearest of at most ``MAX_PIVOTS`` first pivots, and there to the nearest of that pivot's own
second ones, of which there is one for about ``BLOCK_ROWS`` vectors. Second pivots and cells are tables, never broadcast. A cell whose
centre is at angle ``p`` and whose members reach ``r`` around it holds nothing nearer than ``p - r``: a vector first searches its
home cell, and then just those cells that could hold something nearer than the k-th found there. Cells, cut into bounded blocks, meet by a
Cartesian product, so vectors are not copied for the cells they visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import block_pairs as B
from .neighbours import distinct_vectors, unit_vectors

# Vectors for each second pivot, and per side of a block.
BLOCK_ROWS = 2048
MAX_PIVOTS = 256
# Vectors of one first pivot that are compared with its second pivots in one task.
SLICE_ROWS = 4 * BLOCK_ROWS
# Angles are compared with this much slack, more than rounding can make of them.
SLACK = 1e-6
FOUND = "seq bigint, neighbour bigint, n bigint, cosine double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _sliced(rows: DataFrame, beside: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with a ``slice`` of the key: rows are dealt out, what stands beside them is in every slice."""
    slices = materialize(rows.groupBy(key).agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices")), "slices")
    dealt = rows.join(slices, key).withColumn("slice", F.pmod(F.xxhash64("seq"), F.col("slices")).cast("int")).drop("slices")
    copied = beside.join(slices, key).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return dealt, copied


def _first_homes(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            angles = _angles(_matrix(batch["vector"]), pivots)
            yield batch.assign(top=angles.argmin(axis=1).astype("int32"), top_angle=angles.min(axis=1))

    return points.mapInPandas(home, "seq bigint, n bigint, vector array<double>, top int, top_angle double")


def _second_homes(key: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame({"seq": [], "n": [], "vector": [], "top": [], "cell": [], "angle": []})
    pivots = pivots.sort_values("cell")
    angles = _angles(_matrix(rows["vector"]), _matrix(pivots["vector"]))
    return rows[["seq", "n", "vector", "top"]].assign(cell=pivots["cell"].to_numpy()[angles.argmin(axis=1)], angle=angles.min(axis=1))


def _tree(points: DataFrame, total: int) -> DataFrame:
    """Points with their cells."""
    wanted = min(MAX_PIVOTS, -(-total // BLOCK_ROWS))
    sample = points.orderBy(F.xxhash64("seq"), "seq").limit(wanted).select("vector").collect()
    pivots = np.array([r["vector"] for r in sample], dtype=np.float64)
    first = materialize(_first_homes(points.select("seq", "n", "vector"), pivots), "first")
    earliest = first.groupBy("top").agg(F.min("seq").alias("seq"))  # so that every first pivot has a second one
    picked = first.where(F.pmod(F.xxhash64("seq"), F.lit(BLOCK_ROWS)) == 0).select("top", "seq")
    ids = picked.unionByName(earliest).distinct()
    second = materialize(first.join(ids, ["top", "seq"]).select("top", F.col("seq").alias("cell"), "vector"), "second")
    rows, beside = _sliced(first.select("seq", "n", "vector", "top"), second, "top")
    return materialize(
        rows.groupBy("top", "slice").cogroup(beside.groupBy("top", "slice")).applyInPandas(
            _second_homes, "seq bigint, n bigint, vector array<double>, top int, cell bigint, angle double"), "homes")


def _kth(k: int):
    """A function from the vectors of a block (and its centre) to the k-th highest cosine of each one with the others, -2 where there are fewer."""
    def work(vectors: np.ndarray, _: np.ndarray) -> np.ndarray:
        found, step = np.full(len(vectors), -2.0), max(1, B.HELD // len(vectors))
        if len(vectors) > k:
            for at in range(0, len(vectors), step):
                cosine = vectors[at:at + step] @ vectors.T
                cosine[np.arange(len(cosine)), np.arange(at, at + len(cosine))] = -np.inf
                found[at:at + step] = np.partition(cosine, -k, axis=1)[:, -k]
        return found
    return work


class _Found:
    """The k nearest found so far for the vectors of a block."""

    def __init__(self, block: B.Block, k: int):
        self.block, self.seq, self.k, self.known = block.value("block"), block.seq, k, block.numbers("kth").copy()
        self.row, self.neighbour, self.n, self.cosine = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))

    def add(self, *more: np.ndarray) -> None:
        """Rows, neighbours, numbers and cosines; ties go to the smaller neighbour."""
        row, neighbour, n, cosine = (np.concatenate(c) for c in zip((self.row, self.neighbour, self.n, self.cosine), more))
        order = np.lexsort((neighbour, -cosine, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        best = order[place < self.k]
        self.row, self.neighbour, self.n, self.cosine = row[best], neighbour[best], n[best], cosine[best]
        last = order[place == self.k - 1]
        self.known[row[last]] = np.maximum(self.known[row[last]], cosine[last])

    def rows(self) -> pa.RecordBatch:
        columns = self.seq[self.row], self.neighbour, self.n, self.cosine
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seq", "neighbour", "n", "cosine"])


def _meet(found: _Found, probes: B.Block, members: B.Block) -> None:
    """What a block's vectors find in another one, and whatever ties with it but for rounding. Vectors that know of k nearer ones than that
    block can hold don't look."""
    away = B.angles(probes.vector, members.centre[None])[:, 0] - members.radius
    rows, step = np.flatnonzero(away <= np.arccos(np.clip(found.known, -1, 1)) + SLACK), max(1, B.HELD // len(members.seq))
    for some in (rows[at:at + step] for at in range(0, len(rows), step)):
        cosine, least = probes.vector[some] @ members.vector.T, found.known[some]
        cosine[probes.seq[some][:, None] == members.seq[None, :]] = -np.inf
        better = cosine >= np.maximum(least, -2.0)[:, None] - 1e-12
        if cosine.shape[1] > found.k and np.count_nonzero(better) > 4 * found.k * len(some):
            least = np.maximum(least, np.partition(cosine, -found.k, axis=1)[:, -found.k])
            better = cosine >= np.maximum(least, -2.0)[:, None] - 1e-12
        i, j = np.nonzero(better)
        if len(i):
            found.add(some[i], members.seq[j], members.n[j], np.einsum("ij,ij->i", probes.vector[some[i]], members.vector[j]))


def _bounded(cells: DataFrame, k: int) -> DataFrame:
    """Cells that hold no k others themselves look as far as the first ones that certainly do."""
    far = B.angle_between() + F.col("a_radius") + F.col("b_radius")
    few = B.met(cells.where(F.col("size") <= k), cells, F.lit(True)).select(F.col("a_block").alias("block"), "b_block", "b_size", far.alias("far"))
    held = F.sum("b_size").over(Window.partitionBy("block").orderBy("far", "b_block"))  # the vector itself is one of them
    bound = few.withColumn("held", held).where(F.col("held") > k).groupBy("block").agg(F.min("far").alias("far"))
    span = F.least("span", F.col("radius") + F.col("far"))  # null where there are no k others at all
    return cells.join(bound, "block", "left").select("block", "centre", "radius", span.alias("span"))


def _nearest_in(k: int):
    """The k nearest for each vector among the blocks that its own one meets in a task, one after another."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for probes, members in B.pairs(batches):
            if found is None or found.block != probes.value("block"):
                if found is not None:
                    yield found.rows()
                found = _Found(probes, k)
            _meet(found, probes, members)
        if found is not None:
            yield found.rows()
    return work


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("cosine"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_vectors(vectors: DataFrame, k: int = 10) -> DataFrame:
    """``(seq, rank, neighbour, n, cosine)``: the k nearest other vectors of each distinct one, ties to the smaller ``seq``.

    Equal directions count as one vector: the first ``seq`` and their number ``n``. Zero vectors, which have no direction, are
    left out. The result is exact; vectors without any structure visit most cells, which is the search's own worst case.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    points = materialize(distinct_vectors(unit_vectors(vectors)), "points")
    total, kth = points.count(), _kth(k)
    homes = _tree(points, total) if total > BLOCK_ROWS else points.withColumn("cell", F.lit(0).cast("long"))
    # how far from the centre of a block its vectors look for nearer ones
    span = lambda v, c: float((B.angles(v, c[None])[:, 0] + np.arccos(np.clip(kth(v, c), -1, 1))).max())
    blocks = B.packed(homes, {"cell": "bigint"}, BLOCK_ROWS, also={"kth": ("binary", kth), "span": ("double", span)})
    cells = materialize(_bounded(blocks.select("block", "centre", "radius", "span", (F.octet_length("seq") / 8).alias("size")), k), "cells")
    near = B.angle_between() - F.col("b_radius") <= F.col("a_span") + SLACK
    visits = materialize(B.met(cells, cells, near).select(F.col("a_block").alias("block"), F.col("b_block").alias("other")), "visits")
    seen = visits.groupBy("block").agg(F.collect_list("other").alias("sees"))
    probes = blocks.join(seen, "block").repartition(B.partitions(total, B.width(points)), "block")
    found = B.met(materialize(probes, "probes"), blocks.drop("kth"), F.array_contains("a_sees", F.col("b_block")))
    return _best(found.drop("a_sees").mapInArrow(_nearest_in(k), FOUND), k).select("seq", "rank", "neighbour", "n", "cosine")
