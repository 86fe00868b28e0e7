"""DBSCAN and k-means clustering, hierarchical clustering top-down; bottom-up it is in ``ward``. Input is ``(seq, vector array)``, output ``(seq, label)``."""

from __future__ import annotations

from math import acos

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import block_pairs as B
from . import neighbours
from .neighbours import distinct_vectors, merged, placed, unit_vectors
from .ranking import rank_in_group


def components(links: DataFrame) -> DataFrame:
    """``(seq, root)`` for the nodes of links ``(a, b)``, the root being the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every node links its larger
    neighbours, then its smaller ones, to the smallest node it knows, until nothing changes.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("v").alias("seq")).distinct().join(edges.select(F.col("u").alias("seq")), "seq", "left_anti")
            return edges.select(F.col("u").alias("seq"), F.col("v").alias("root")).unionByName(
                roots.select("seq", F.col("seq").alias("root")))
        before = state


def _degrees(eps: float):
    """How many neighbours the points without a spot find in the blocks they meet."""
    def work(batches):
        for one, other in B.pairs(batches):
            mine, theirs = np.zeros(len(one.seq)), np.zeros(len(other.seq))
            for i, j in B.near(one, other, eps, acos(1 - eps)):
                mine += np.bincount(i, other.n[j], len(mine))
                theirs += np.bincount(j, one.n[i], len(theirs))
            for side, degree in ((one, mine), (other, theirs)):
                if side.value("spot") < 0 and degree.any():
                    some = np.flatnonzero(degree)
                    yield pa.RecordBatch.from_arrays([pa.array(side.seq[some]), pa.array(degree[some].astype(np.int64))], names=["seq", "degree"])
    return work


def _links(eps: float, heads: np.ndarray):
    """Links of one block pair: core points to a core point they reach inside the pair, spots to spots, and border points to
    the core points or spots they touch. At most one row per core point instead of all pairs."""
    def found(one: B.Block, other: B.Block) -> tuple[np.ndarray, np.ndarray, bool]:
        spots, close = (one.value("spot"), other.value("spot")), B.near(one, other, eps, acos(1 - eps))
        if min(spots) >= 0:
            head = heads[list(spots)]
            return (head[:1], head[1:], False) if next(close, None) is not None else (head[:0], head[:0], False)
        if max(spots) >= 0:
            single, at = (one, 0) if spots[0] < 0 else (other, 1)
            touched = np.zeros(len(single.seq), bool)
            for hit in close:
                touched[hit[at]] = True
            seq = single.seq[touched]
            return seq, np.full(len(seq), heads[max(spots)]), not single.value("core")
        if one.value("core") and other.value("core"):
            same = one.value("block") == other.value("block")
            seq, shift = (one.seq, 0) if same else (np.concatenate([one.seq, other.seq]), len(one.seq))
            root = np.arange(len(seq))
            for i, j in close:
                root = merged(root, i, j + shift)
            linked = np.flatnonzero(root != np.arange(len(seq)))
            return seq[linked], seq[root[linked]], False
        hits = [*close]  # a point that is none has few core points beside it
        i, j = (np.concatenate([h[k] for h in hits]) if hits else np.zeros(0, int) for k in (0, 1))
        ends = one.seq[i], other.seq[j]
        return (*(ends if other.value("core") else ends[::-1]), True)

    def work(batches):
        for one, other in B.pairs(batches):
            a, b, border = found(one, other)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), border))], names=["a", "b", "border"])
    return work


def dbscan(vectors: DataFrame, eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """DBSCAN by cosine distance; label -1 is noise, clusters are numbered by their first core point.

    Exact at any size: degrees and then links are computed block by block around pivots, so neighbour
    pairs are never collected, and vectors are never copied for the blocks they meet. Equal vectors count through one representative. What a sample
    shows to be core points of one cluster, a spot, is never compared with itself; all other points meet everything they may be near to.
    """
    units = materialize(unit_vectors(vectors), "units")
    points = materialize(distinct_vectors(units), "points")
    where, heads = placed(points, eps, min_samples)
    size = neighbours.BLOCK_ROWS
    known = where.where("spot >= 0")
    blocks = B.packed(where, {"spot": "int", "cell": "int"}, size)
    near = B.near_enough(acos(1 - eps))
    once = F.col("a_block") <= F.col("b_block")
    degrees = B.met(blocks.where("spot < 0"), blocks, (once | (F.col("b_spot") >= 0)) & near).mapInArrow(_degrees(eps), "seq bigint, degree bigint")
    degrees = degrees.groupBy("seq").agg(F.sum("degree").alias("degree"))
    single = materialize(
        where.where("spot < 0").join(degrees, "seq", "left")
        .select("seq", "n", "vector", "cell", "spot", (F.col("n") + F.coalesce("degree", F.lit(0)) >= min_samples).alias("core")), "single")
    flagged = B.packed(single, {"spot": "int", "core": "boolean", "cell": "int"}, size, "flagged").withColumn("block", -1 - F.col("block"))
    flagged = flagged.unionByName(blocks.where("spot >= 0").withColumn("core", F.lit(True)))
    apart = (F.col("a_spot") < 0) | (F.col("a_spot") != F.col("b_spot"))
    found = B.met(flagged, flagged, once & apart & (F.col("a_core") | F.col("b_core")) & near).mapInArrow(
        _links(eps, heads), "a bigint, b bigint, border boolean")
    spark = vectors.sparkSession
    head = spark.createDataFrame([(i, int(seq)) for i, seq in enumerate(heads)], "spot int, head bigint")  # one row per spot, at most MAX_SPOTS
    first = known.groupBy("spot").agg(F.min("seq").alias("b")).join(head, "spot").select(F.col("head").alias("a"), "b", F.lit(False).alias("border"))
    links = materialize(found.unionByName(first), "links")
    grouped = components(links.where("NOT border").select("a", "b"))
    nodes = single.where("core").select("seq", F.col("seq").alias("node")).unionByName(known.join(head, "spot").select("seq", F.col("head").alias("node")))
    core_roots = materialize(
        nodes.join(grouped.withColumnRenamed("seq", "node"), "node", "left").select("seq", F.coalesce("root", "node").alias("root")), "roots")
    ranked = rank_in_group(core_roots.select("root").distinct().withColumn("all", F.lit(0)), ["all"], "root", "rank")
    core_labels = materialize(
        core_roots.join(ranked.select("root", (F.col("rank") - 1).cast("int").alias("label")), "root").select("seq", "label"), "labels")
    border_labels = (
        links.where("border").join(core_labels, F.col("b") == F.col("seq"))
        .groupBy(F.col("a").alias("seq")).agg(F.min("label").alias("label"))
    )
    labels = points.select("seq", "vector").join(core_labels.unionByName(border_labels), "seq").select("vector", "label")
    labelled = units.join(labels, "vector").select("seq", "label")
    return vectors.select("seq").join(labelled, "seq", "left").select("seq", F.coalesce("label", F.lit(-1)).alias("label"))


def _ml(vectors: DataFrame) -> DataFrame:
    return vectors.select("seq", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))


def kmeans(vectors: DataFrame, k: int | None = None, seed: int = 42, n_init: int = 10) -> DataFrame:
    """The cheapest of ``n_init`` k-means runs; by default a fifth of the rows as k, between 2 and 10."""
    data = _ml(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    n = data.count()
    k = min(n, k or min(10, max(2, n // 5)))
    if k < 2:
        return vectors.select("seq", F.lit(0).alias("label"))
    models = (KMeans(k=k, seed=seed + i).fit(data) for i in range(n_init))
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(_ml(vectors)).select("seq", F.col("prediction").alias("label"))


def bisecting(vectors: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """Divisive k-means, the scalable alternative to Ward; it gives other clusters than Ward does."""
    data = _ml(vectors)
    return BisectingKMeans(k=k or 8, seed=seed).fit(data).transform(data).select("seq", F.col("prediction").alias("label"))


def cluster(vectors: DataFrame, algorithm: str = "dbscan", eps: float = 0.5, min_samples: int = 2,
            n_clusters: int | None = None) -> DataFrame:
    """Dispatch by algorithm name."""
    if algorithm == "dbscan":
        return dbscan(vectors, eps, min_samples)
    if algorithm == "kmeans":
        return kmeans(vectors, n_clusters)
    if algorithm == "hierarchical":
        from .ward import ward

        return ward(vectors, n_clusters)
    if algorithm == "bisecting":
        return bisecting(vectors, n_clusters)
    raise ValueError(f"unknown clustering algorithm: {algorithm}")
