"""Blocks of unit vectors as single rows, and pairs of blocks by a Cartesian product.

A pair of blocks is made where it is compared: each task of the product reads one partition of blocks for each side, so no
vector is copied, shuffled or kept on disk for the blocks that it meets. Only what the comparing finds leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Cosines held at once inside a task, bytes of the vectors of a block, and of the blocks of a partition.
HELD, BLOCK_BYTES, PARTITION_BYTES = 1 << 20, 1 << 22, 1 << 25
# Rows that are one partition when there are few.
SMALL_ROWS = 4096
# Angles are compared with this much slack, more than rounding can make of them.
SLACK = 1e-6


def width(rows: DataFrame) -> int:
    """The dimensions of the vectors, 1 where there are none."""
    first = rows.select(F.size("vector").alias("width")).first()
    return max(1, first["width"]) if first else 1


def matrix(batch: pa.RecordBatch | pa.Table, name: str = "vector") -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def partitions(total: int, dims: int) -> int:
    """How many partitions of blocks so many vectors make; a task holds one of them for each side."""
    return max(1, min(8, total // SMALL_ROWS), ceil(8 * dims * total / PARTITION_BYTES))


def packed(rows: DataFrame, keys: dict[str, str], block_rows: int, label: str = "blocks", also: dict | None = None) -> DataFrame:
    """The rows ``(*keys, seq, n, vector)`` as blocks of equal keys and about ``block_rows`` rows at most: ``(block, *keys, centre, radius,
    seq, n, vector)``, the last three as bytes. ``keys`` has the types by name; ``also`` has the types of further columns and how they are made from a block's vectors and their centre."""
    also = also or {}
    dims = width(rows)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * dims)))
    sizes = materialize(rows.groupBy(*keys).agg(F.count("*").alias("rows")), "sizes")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    parts = sizes.select(*keys, F.ceil(F.col("rows") / block_rows).cast("int").alias("parts"))
    dealt = rows.join(parts, list(keys)).select(*keys, "seq", "n", "vector", F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int").alias("part"))
    dealt = dealt.repartition(partitions(total, dims), *keys, "part")

    def pack(t: pa.Table) -> pa.Table:
        vectors = matrix(t)
        mean = vectors.mean(axis=0)
        length = np.linalg.norm(mean)
        centre = mean / length if length > 0 else vectors[0]
        held = {
            "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([float(angles(vectors, centre[None]).max())]),
            "seq": t["seq"].to_numpy().astype(np.int64), "n": t["n"].to_numpy().astype(np.int64), "vector": vectors,
            **{name: make(vectors, centre) for name, (_, make) in also.items()}}
        arrays = {c: v if isinstance(v, pa.Array) else pa.array([v.tobytes() if isinstance(v, np.ndarray) else v]) for c, v in held.items()}
        return pa.table({**{k: t[k].slice(0, 1) for k in keys}, **arrays})

    schema = ", ".join([*(f"{k} {v}" for k, v in keys.items()), "centre array<double>, radius double, seq binary, n binary, vector binary",
                        *(f"{name} {kind}" for name, (kind, _) in also.items())])
    blocks = dealt.groupBy(*keys, "part").applyInArrow(pack, schema)
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()), label)


def angle_between() -> Column:
    """The angle between the centres of two blocks that meet."""
    cosine = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def met(one: DataFrame, other: DataFrame, condition: Column) -> DataFrame:
    """Pairs of blocks, with columns ``a_*`` and ``b_*``. The condition is looked at before a pair is made."""
    sides = [t.toDF(*(f"{s}_{c}" for c in t.columns)) for t, s in ((one, "a"), (other, "b"))]
    return sides[0].hint("shuffle_replicate_nl").join(sides[1], condition)


def near_enough(angle: float) -> Column:
    """Whether two blocks can hold vectors within this angle of each other."""
    return angle_between() - F.col("a_radius") - F.col("b_radius") <= angle + SLACK


class Block:
    """One side of a pair inside a task."""

    def __init__(self, batch: pa.RecordBatch, side: str, row: int):
        self._batch, self._side, self._row = batch, side, row
        self.seq, self.n = self.numbers("seq", np.int64), self.numbers("n", np.int64)
        self.vector = self.numbers("vector").reshape(len(self.seq), -1)
        self.centre, self.radius = np.array(self.value("centre")), self.value("radius")

    def value(self, name: str):
        return self._batch.column(f"{self._side}_{name}")[self._row].as_py()

    def numbers(self, name: str, kind: type = np.float64) -> np.ndarray:
        return np.frombuffer(self._batch.column(f"{self._side}_{name}")[self._row].as_buffer(), dtype=kind)


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Block]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, "a", row), Block(batch, "b", row)


def near(one: Block, other: Block, max_distance: float, angle: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows ``(i, j)`` of two blocks within the distance, each pair once, some at a time. Rows that are too far from all of the
    other block are left out before."""
    same = one.value("block") == other.value("block")
    mine, theirs = np.arange(len(one.seq)), np.arange(len(other.seq))
    if not same:
        mine = np.flatnonzero(angles(one.vector, other.centre[None])[:, 0] <= angle + other.radius + SLACK)
        theirs = np.flatnonzero(angles(other.vector, one.centre[None])[:, 0] <= angle + one.radius + SLACK)
    if not len(mine) or not len(theirs):
        return
    right = (other.vector if len(theirs) == len(other.seq) else other.vector[theirs]).T
    step = max(1, HELD // len(theirs))
    for at in range(0, len(mine), step):
        rows = mine[at:at + step]
        close = 1 - one.vector[rows] @ right <= max_distance
        if same:
            close &= theirs[None, :] > rows[:, None]
        i, j = np.nonzero(close)
        if len(i):
            yield rows[i], theirs[j]
