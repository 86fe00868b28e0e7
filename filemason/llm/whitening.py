"""Embedding whitening: spectra of partitions grow by rank-one updates, are combined, and refined over all vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import small_batches

EPS = np.finfo(float).eps
#: Entries beyond this (times the scale) can't be squared and summed as whole numbers; spectra combined by one task.
LARGEST, FAN_IN = 2**40, 8


def secular_roots(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(poles) + z zᵀ, for strictly rising poles and z without zeros.

    The j-th root of 1 + Σ zᵢ² / (polesᵢ - μ) lies between poles j and j + 1. All roots are sought at once, as distances from
    the nearer pole, by rational steps through the values of the sums on both sides of the root, or by halving where a step
    leaves the bracket. The vectors come from the z that has exactly these roots, which keeps them orthogonal.
    """
    k = len(poles)
    if k == 1:
        return poles + z * z, np.ones((1, 1))
    squares, whole = z * z, float(z @ z)
    gap = np.append(np.diff(poles), whole)
    j, last = np.arange(k), np.arange(k) == k - 1
    middle = 1 + (squares / ((poles - poles[:, None]) - gap[:, None] / 2)).sum(1)
    left = last | (middle >= 0)
    origin = np.where(left, j, np.minimum(j + 1, k - 1))
    apart = poles[None, :] - poles[origin][:, None]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, np.where(last, gap, gap / 2), 0.0)
    tau, below = (low + high) / 2, np.tril(np.ones((k, k), bool))
    for _ in range(200):
        distance = apart - tau[:, None]
        share = squares / distance
        f = 1 + share.sum(1)
        low, high = np.where(f < 0, tau, low), np.where(f > 0, tau, high)
        done = (np.abs(f) <= 2 * EPS * (1 + np.abs(share).sum(1))) | (high - low <= EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        slope = share / distance
        psi, phi = np.where(below, slope, 0).sum(1), np.where(below, 0, slope).sum(1)
        here = distance[j, j]
        there = np.where(last, gap - tau, distance[j, np.minimum(j + 1, k - 1)])
        with np.errstate(all="ignore"):
            a, b = (here + there) * f - here * there * (psi + phi), here * there * f
            c = f - here * psi - there * phi
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = tau + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        tau = np.where(done, tau, np.where((step > low) & (step < high), step, (low + high) / 2))
    distance = apart - tau[:, None]
    between = poles[:, None] - poles[None, :]
    np.fill_diagonal(between, 1.0)
    exact = np.sqrt(np.abs((-distance / between).prod(0))) * np.sign(z)
    vectors = (exact[None, :] / distance).T
    return poles[origin] + tau, vectors / np.linalg.norm(vectors, axis=0)


def rank_one(values: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the eigenvectors of diag(values) + z zᵀ for rising values.

    Deflation first: an entry of z that changes nothing leaves its eigenpair as it is, and of two values that are as good as
    equal a rotation makes one entry of z zero. What is left goes to the secular equation.
    """
    values, z, turned = values.copy(), z.copy(), np.eye(len(values))
    length = float(np.sqrt(z @ z))
    tolerance = 8 * EPS * max(float(np.abs(values).max(initial=0.0)), length * length)
    z[np.abs(z) * length <= tolerance] = 0
    before = -1
    for i in np.flatnonzero(z).tolist():
        if before >= 0:
            r = float(np.hypot(z[before], z[i]))
            c, s = z[i] / r, z[before] / r
            if abs((values[i] - values[before]) * c * s) <= tolerance:
                z[before], z[i] = 0.0, r
                pair = turned[:, [before, i]]
                turned[:, before], turned[:, i] = c * pair[:, 0] - s * pair[:, 1], s * pair[:, 0] + c * pair[:, 1]
                low, high = values[before], values[i]
                values[before], values[i] = low * c * c + high * s * s, low * s * s + high * c * c
        before = i
    live = np.flatnonzero(z)
    live = live[np.argsort(values[live], kind="stable")]
    if len(live):
        roots, vectors = secular_roots(values[live], z[live])
        values[live], turned[:, live] = roots, turned[:, live] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], turned[:, order]


@dataclass
class Spectrum:
    """Number, mean, and eigenvalues and eigenvectors of the sum of centred outer products of vectors."""

    size: int
    n: int = 0
    mean: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.mean is None:
            self.mean, self.values, self.vectors = np.zeros(self.size), np.zeros(self.size), np.eye(self.size)

    def update(self, v: np.ndarray) -> None:
        """Add v vᵀ."""
        if v.any():
            self.values, turned = rank_one(self.values, self.vectors.T @ v)
            self.vectors = self.vectors @ turned

    def join(self, n: int, mean: np.ndarray, parts: np.ndarray) -> None:
        """Add n vectors with this mean whose centred outer products sum to those of the rows of ``parts``: an update for each
        row, and one for the distance of the means."""
        for row in parts:
            self.update(row)
        if self.n and n:
            self.update((mean - self.mean) * np.sqrt(self.n * (n / (self.n + n))))
        self.mean = self.mean + (mean - self.mean) * (n / max(1, self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        """Add vectors: the rows of a batch, centred, are first condensed to the rows of their triangular factor, whose outer
        products have the same sum, so a batch costs at most one update for each dimension."""
        mean = rows.mean(axis=0)
        centred = rows - mean
        self.join(len(rows), mean, np.linalg.qr(centred, mode="r") if len(centred) > self.size else centred)

    def merge(self, other: Spectrum) -> None:
        """Add another spectrum by an update for each of its eigenpairs."""
        self.join(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)


def usable(vectors: DataFrame, id_column: str, vector: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    """``(id, x)`` of the rows that take part, as whole numbers, and their dimension."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v")).where(F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < LARGEST)))
    grid = rows.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))
    grid = materialize(grid, "grid")
    size = grid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = size["d"] if size else 0
    return grid.where(F.size("x") == d), d


def matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of ``of`` (a flat array for the matrix of a batch) over all rows: one array a task, added up by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch, 0, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    found = rows.select("x").mapInArrow(run, f"k long, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(found, key=lambda r: r["k"])])


def combined_spectrum(rows: DataFrame, d: int, origin: np.ndarray) -> Spectrum:
    """The spectrum of all distinct vectors (less ``origin``): one a partition, then by a tree of tasks that merge a few."""
    schema = "part long, n long, mean array<double>, values array<double>, vectors array<double>"

    def told(part: int, s: Spectrum) -> pa.Table:
        return pa.table({"part": pa.array([part]), "n": pa.array([s.n]), **{c: pa.array([getattr(s, c).ravel()], pa.list_(pa.float64()))
                                                                           for c in ("mean", "values", "vectors")}})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(d)
        for batch in batches:
            if batch.num_rows:
                s.add((matrix(batch, 0, d) - origin).astype(float))
        if s.n:
            yield from told(TaskContext.get().partitionId(), s).to_batches()

    def read(row: dict) -> Spectrum:
        return Spectrum(d, row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(d, d))

    def merge(group: pa.Table) -> pa.Table:
        found = sorted(group.to_pylist(), key=lambda r: r["part"])
        first = read(found[0])
        for row in found[1:]:
            first.merge(read(row))
        return told(found[0]["part"] // FAN_IN, first)

    spectra = materialize(rows.select("x").mapInArrow(learn, schema), "spectra")
    parts = (spectra.agg(F.max("part")).first()[0] or 0) + 1
    for _ in range(ceil(log(parts, FAN_IN) - 1e-9)):
        spectra = spectra.groupBy(F.floor(F.col("part") / FAN_IN).alias("_group")).applyInArrow(merge, schema)
    return read(spectra.first().asDict())


def refined(rows: DataFrame, d: int, centred: Callable[[np.ndarray], np.ndarray], n: int, basis: np.ndarray, wanted: int,
            rounds: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and eigenvectors of the covariance inside the span of ``basis``, and the covariance's trace.

    Each round takes the covariance's product with the basis over all rows and solves the small problem in its span; where what the
    wanted pairs leave over is more than rounding, the product becomes the next basis.
    """
    for _ in range(rounds):
        q = np.linalg.qr(basis)[0]
        p = q.shape[1]

        def of(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            y = centred(x)
            return np.append((y.T @ (y @ q)).ravel(), (y * y).sum())

        sums = summed(rows, d, of)
        product, trace = sums[:-1].reshape(d, p) / n, sums[-1] / n
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, basis = q @ turn, product @ turn
        left = np.linalg.norm(basis[:, :wanted] - vectors[:, :wanted] * values[:wanted], axis=0).max()
        if left <= 1e-13 * max(values[0], 0) or p == d:
            break
        basis = np.hstack([vectors, basis])[:, :min(d, 2 * p)] if p < d else vectors
    return values, vectors, float(trace)


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: rows projected on the principal axes of all distinct
    vectors, with unit variance along each.

    Entries c count as x = floor(scale · c) + offset. The axes are unit eigenvectors of the covariance of the n distinct
    x, numbered from 1 by falling eigenvalue e (their sign is free); ``whitened`` is (x - mean) on the axis over √e, ``explained`` is
    e over the covariance's trace, ``deviation`` the exact sum of (n · x - S)² over the dimensions (S: sums of the distinct x; null
    where it exceeds a long), ``identity_error`` the largest distance of an entry of the whitened covariance from the identity's.

    Null vectors and those with null, non-finite or unsummably large entries (scale · |c| from 2^40) have no rows, nor have vectors of another than the
    most frequent dimension (of equally frequent ones the largest). Repeated rows and null ids all come out, but each vector is fitted
    once. Axes without variance are left out, so there are fewer than ``components`` where the distinct vectors span less, and no rows
    for one distinct vector, empty vectors or an empty table. Other columns are not read. Sums, one spectrum of d² numbers and products of d rows
    reach the driver, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows, d = usable(vectors, id_column, vector, scale, offset)
    schema = T.StructType([T.StructField(id_column, rows.schema["id"].dataType), *T._parse_datatype_string(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    nothing = rows.limit(0).mapInArrow(lambda batches: iter(()), schema)
    if not d:
        return nothing
    distinct = materialize(rows.select("x").distinct(), "distinct")
    about = distinct.agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    n, low, high = about["n"], about["low"], about["high"]
    if not n:
        return nothing
    # sums of what exceeds the least entry, so that they stay whole numbers for any number of rows
    sums = [int(s) + n * low for s in summed(distinct, d, lambda x: (x - low).sum(axis=0), "long").tolist()]
    origin = np.array([s // n for s in sums])
    rest = np.array([s - n * (s // n) for s in sums])
    spread = n * (high - low + 1)
    fits = d * spread * spread < 2**63

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - origin) - rest / n

    def deviations(x: np.ndarray) -> list[int | None]:
        if fits:
            return ((n * (x - origin) - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest.tolist())) for row in (x - origin).tolist()]
        return [v if v < 2**63 else None for v in exact]

    start = combined_spectrum(distinct, d, origin)
    wanted = min(components, d)
    basis = start.vectors[:, ::-1][:, :min(d, 2 * wanted)]
    values, axes, trace = refined(distinct, d, centred, n, basis, wanted)
    count = int((values[:wanted] > 1e-12 * trace).sum()) if trace > 0 else 0
    if not count:
        return nothing
    values = values[:count]
    project = axes[:, :count] / np.sqrt(values)
    mean = summed(distinct, d, lambda x: (centred(x) @ project).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ project - mean
        return (w.T @ w).ravel()

    error = float(np.abs(summed(distinct, d, products).reshape(count, count) / n - np.eye(count)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, 1, d)
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), count))
            constant = lambda v, kind: pa.array(np.full(m * count, v), kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1), m), pa.int32()), constant(n, pa.int64()),
                 pa.array(deviations(x), pa.int64()).take(at), pa.array((centred(x) @ project).ravel()), pa.array(np.tile(explained, m)),
                 constant(error, pa.float64())], names=schema.names)

    return rows.select("id", "x").mapInArrow(run, schema)
