"""Exact cosine-distance joins: cells around pivots, cut into bounded blocks.

Unit vectors get the pivot nearest by angle as home. A vector within angle ``e`` of one with home ``c`` is
at most ``2e`` further from ``c`` than from its own home, so it visits exactly those cells; the join is
exact for any distance, and the closer the wanted neighbours the fewer cells a vector visits. ``visits`` and ``blocks`` make a copy of a
vector for each cell; where there are many, points are ``placed`` in cells, packed and met as in ``block_pairs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import block_pairs as B

# Vectors per side of a block, and most pivots.
BLOCK_ROWS = 2048
MAX_PIVOTS = 256
# Rows that a task sends to cells at once, and pairs that it lists at once: what a Python worker holds stays the same however many pivots there are.
SENT_ROWS = 8192
LISTED_PAIRS = 1 << 16
# Bytes of the vectors that spots are found with, and most spots.
SAMPLED_BYTES, MAX_SPOTS = 1 << 24, 1024


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(seq, vector)`` scaled to length 1; zero vectors, which are near nothing, are left out."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))
    scaled = vectors.withColumn("norm", norm).where("norm > 0")
    return scaled.select("seq", F.transform("vector", lambda x: x.cast("double") / F.col("norm")).alias("vector"))


def distinct_vectors(units: DataFrame) -> DataFrame:
    """Equal vectors as one row: the first ``seq`` and their number ``n``."""
    return units.groupBy("vector").agg(F.min("seq").alias("seq"), F.count("*").alias("n")).select("seq", "n", "vector")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _pivots(points: DataFrame, wanted: int, apart: float) -> np.ndarray:
    """Up to ``wanted`` vectors of a repeatable sample, no two closer than the angle ``apart``: a dense spot
    then gets one cell instead of many that all visit one another."""
    sample = points.orderBy(F.xxhash64("seq"), "seq").limit(4 * wanted).select("vector").collect()
    chosen: list[np.ndarray] = []
    for vector in (np.array(r["vector"], dtype=np.float64) for r in sample):
        if len(chosen) < wanted and all(np.arccos(np.clip(vector @ c, -1, 1)) > apart for c in chosen):
            chosen.append(vector)
    return np.array(chosen)


def slices(batches: Iterator[pd.DataFrame], copies: int) -> Iterator[pd.DataFrame]:
    """Parts of the batches that make at most ``SENT_ROWS`` rows when each row is sent ``copies`` times."""
    step = max(1, SENT_ROWS // copies)
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.iloc[at:at + step]


def visits(points: DataFrame, max_distance: float, block_rows: int | None = None) -> DataFrame:
    """Rows ``(cell, probe, dense, seq, n, vector)``: each point at home and, as ``probe``, in the later cells
    that may hold a neighbour. Points marked ``dense`` are so close to their pivot that all those of one
    cell are neighbours of each other."""
    if not 0 < max_distance < 1:
        raise ValueError("the cosine distance must lie between 0 and 1")
    angle = acos(1 - max_distance)
    block_rows = block_rows or BLOCK_ROWS
    total = points.count()
    if total <= block_rows:
        return points.select(F.lit(0).alias("cell"), F.lit(False).alias("probe"), F.lit(False).alias("dense"), "seq", "n", "vector")
    pivots = _pivots(points, min(MAX_PIVOTS, -(-total // block_rows)), angle / 2)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, len(pivots)):
            angles = np.arccos(np.clip(_matrix(batch["vector"]) @ pivots.T, -1, 1))
            home, least = angles.argmin(axis=1), angles.min(axis=1)
            near = angles - least[:, None] <= 2 * angle + 1e-9
            near &= np.arange(len(pivots)) >= home[:, None]
            row, cell = np.nonzero(near)
            at_home = cell == home[row]
            yield pd.DataFrame({
                "cell": cell.astype("int32"), "probe": ~at_home, "dense": at_home & (least[row] <= angle / 2 - 1e-9),
                "seq": batch["seq"].to_numpy()[row], "n": batch["n"].to_numpy()[row],
                "vector": batch["vector"].to_numpy()[row]})

    schema = "cell int, probe boolean, dense boolean, seq bigint, n bigint, vector array<double>"
    return materialize(points.select("seq", "n", "vector").mapInPandas(visit, schema), "visits")


def blocks(visited: DataFrame, skip_dense: bool = False, block_rows: int | None = None) -> DataFrame:
    """Rows ``(cell, a, b, probe, seq, n, vector)`` such that every pair of points that may be near meets in
    exactly one ``(cell, a, b)``, each holding at most two blocks of points.

    With ``skip_dense`` the dense points of a cell do not meet each other: they are known to be near.
    """
    size = F.lit(block_rows or BLOCK_ROWS)
    dense = F.col("dense") if skip_dense else F.lit(False)
    visited = visited.withColumn("kind", F.when(F.col("probe"), 2).when(dense, 0).otherwise(1))

    def blocks_of(kind: int) -> Column:
        return F.ceil(F.count_if(F.col("kind") == kind) / size).cast("int")

    sizes = visited.groupBy("cell").agg(blocks_of(0).alias("d"), blocks_of(1).alias("h"), blocks_of(2).alias("g"))
    placed = visited.join(F.broadcast(sizes), "cell")  # one row per pivot, at most MAX_PIVOTS
    d, h, g = F.col("d"), F.col("h"), F.col("g")
    own = F.when(F.col("kind") == 0, d).when(F.col("kind") == 1, h).otherwise(g)
    start = F.when(F.col("kind") == 0, F.lit(0)).when(F.col("kind") == 1, d).otherwise(d + h)
    mine = F.col("mine")
    placed = placed.withColumn("mine", (start + F.pmod(F.xxhash64("seq"), own)).cast("int"))

    def meet(a: Column, b: Column, probe: bool) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(probe).alias("probe"))

    def span(first: Column, last: Column, body: Callable[[Column], Column]) -> Column:
        none = F.array().cast("array<struct<a:int,b:int,probe:boolean>>")
        return F.when(first <= last, F.transform(F.sequence(first, last), body)).otherwise(none)

    first_right = F.when(F.col("kind") == 0, d).otherwise(mine)
    last_left = F.when(F.col("kind") == 0, F.lit(-1)).when(F.col("kind") == 1, mine - 1).otherwise(d + h - 1)
    as_left = F.when(F.col("kind") == 2, F.array().cast("array<struct<a:int,b:int,probe:boolean>>")).otherwise(
        span(first_right, d + h + g - 1, lambda b: meet(mine, b, False)))
    as_right = span(F.lit(0), last_left, lambda a: meet(a, mine, True))
    rows = placed.select("cell", "seq", "n", "vector", F.explode(F.concat(as_left, as_right)).alias("m"))
    return rows.select("cell", "m.a", "m.b", "m.probe", "seq", "n", "vector")


def _first(points: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A repeatable sample of the points in order of ``seq``: their numbers, weights and vectors."""
    sample = points.orderBy(F.xxhash64("seq"), "seq").limit(rows).select("seq", "n", "vector").orderBy("seq").toArrow()
    return sample["seq"].to_numpy(), sample["n"].to_numpy(), B.matrix(sample)


def _spots(vectors: np.ndarray, n: np.ndarray, max_distance: float, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of some vectors the first one that it is linked with as a core point, -1 where these vectors don't show it to
    be one, and how many have the same first one."""
    root, core = np.arange(len(n)), np.zeros(len(n), bool)
    step = max(1, B.HELD // max(1, len(n)))
    near = [slice(at, at + step) for at in range(0, len(n), step)]
    for part in near:
        core[part] = (1 - vectors[part] @ vectors.T <= max_distance) @ n >= min_samples
    for part in near:
        i, j = np.nonzero((1 - vectors[part] @ vectors.T <= max_distance) & core[part, None] & core)
        root = merged(root, i + part.start, j)
    root = np.where(core, root, -1)
    return root, np.where(core, np.bincount(root[core], minlength=len(n))[root], 0)


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of linked rows, each the smallest row known to hang together, with the links ``(i, j)`` added."""
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low != high
        i, j = i[apart], j[apart]
        root = root.copy()
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def placed(points: DataFrame, max_distance: float, min_samples: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Points ``(seq, n, vector)`` with ``cell``, the pivot nearest by angle, and ``spot``; and the ``seq`` that stands for each spot.

    A spot holds points that a bounded sample shows to be core points linked with each other: they have enough neighbours in it, one of them a
    core point of that spot. All others have the spot -1, and so has everything without ``min_samples``.
    """
    if not 0 < max_distance < 1:
        raise ValueError("the cosine distance must lie between 0 and 1")
    total = points.count()
    pivots = _pivots(points, max(1, min(MAX_PIVOTS, -(-total // BLOCK_ROWS))), acos(1 - max_distance) / 2)
    known, weights, vectors, spots, heads = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), np.zeros(0, int), np.zeros(0, np.int64)
    if min_samples is not None and total:
        rows = max(1, min(2 * BLOCK_ROWS, SAMPLED_BYTES // (8 * B.width(points))))
        known, weights, vectors = _first(points, rows)
        root, size = _spots(vectors, weights, max_distance, min_samples)
        largest = np.lexsort((root, -size))  # rows of the largest spot first, and so the first core neighbour's spot is the largest
        known, weights, vectors, root = known[largest], weights[largest].astype(float), vectors[largest], root[largest]
        firsts = list(dict.fromkeys(int(r) for r in root if r >= 0))[:MAX_SPOTS]
        number = {r: i for i, r in enumerate(firsts)}
        spots = np.array([number.get(int(r), -1) for r in root])
        heads = known[[int(np.flatnonzero(root == r)[0]) for r in firsts]] if firsts else heads

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, B.HELD // max(1, len(pivots), len(known)))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                rows, seq = B.matrix(batch), batch.column("seq").to_numpy(zero_copy_only=False)
                cell, spot = (rows @ pivots.T).argmax(axis=1), np.full(len(rows), -1)
                if len(heads):
                    near = 1 - rows @ vectors.T <= max_distance
                    others = near & (known[None, :] != seq[:, None])
                    enough = others @ weights + batch.column("n").to_numpy() >= min_samples
                    near &= (spots >= 0)[None, :]
                    spot = np.where(enough & near.any(axis=1), spots[near.argmax(axis=1)], -1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(spot, pa.int32())], names=["seq", "n", "vector", "cell", "spot"])

    schema = "seq bigint, n bigint, vector array<double>, cell int, spot int"
    return materialize(points.select("seq", "n", "vector").mapInArrow(place, schema), "placed"), heads


def cosine_neighbours(vectors: DataFrame, min_cosine: float) -> DataFrame:
    """Pairs of distinct vectors at least that alike: ``(seq_a, seq_b, n_a, n_b, cosine)``. Equal vectors are
    represented by their first row and their number."""
    points = materialize(distinct_vectors(unit_vectors(vectors)), "points")
    limit = 1 - min_cosine
    where, _ = placed(points, limit)
    angle = acos(min_cosine)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, other in B.pairs(batches):
            for rows, others in B.near(one, other, limit, angle):
                for at in range(0, len(rows), LISTED_PAIRS):
                    i, j = rows[at:at + LISTED_PAIRS], others[at:at + LISTED_PAIRS]
                    a, b, n_a, n_b = one.seq[i], other.seq[j], one.n[i], other.n[j]
                    swap = a > b
                    columns = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n_b, n_a), np.where(swap, n_a, n_b)
                    cosine = np.einsum("ij,ij->i", one.vector[i], other.vector[j])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, cosine)], names=["seq_a", "seq_b", "n_a", "n_b", "cosine"])

    blocks_ = B.packed(where, {"cell": "int"}, BLOCK_ROWS)
    meet = (F.col("a_block") <= F.col("b_block")) & B.near_enough(angle)
    return B.met(blocks_, blocks_, meet).mapInArrow(found, "seq_a bigint, seq_b bigint, n_a bigint, n_b bigint, cosine double")
