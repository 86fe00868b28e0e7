"""Approximate nearest neighbours by scanning learned rotated binary codes in blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

#: Rows of a block of the index, queries that meet it at a time, and queries worked on together.
BLOCK_ROWS, BLOCK_QUERIES, TOGETHER = 8192, 1024, 64


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part: no null, zero, or non-finite vectors, and of the most frequent dimension."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = 20, seed: int = 11) -> np.ndarray:
    """``bits`` directions whose signs are the code: principal directions, rotated so that the signs lose little
    (alternating between the codes and the best rotation towards them), as often as it takes to fill the bits."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    width = min(bits, d)
    _, _, axes = np.linalg.svd(sample.T @ sample)
    axes = axes[:width]
    parts = []
    for _ in range(ceil(bits / width)):
        turned, _ = np.linalg.qr(rng.standard_normal((width, width)))
        flat = sample @ axes.T
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(flat @ turned >= 0, 1.0, -1.0).T @ flat)
            turned = w.T @ u.T
        parts.append(turned.T @ axes)
    return np.vstack(parts)[:bits]


def _codes(lifted: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.packbits(lifted @ directions.T >= 0, axis=1)


def _lift(v: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors among which the angle orders by inner product: one more coordinate fills up to the longest vector."""
    if query:
        return np.hstack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))])
    v = v / longest
    return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1, keepdims=True)))])


class Block:
    """The codes of one block. At the radius that the k-th neighbour needs nearly all rows share a near substring, so
    no tables of substrings are kept."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray, longest: float, margin: float) -> None:
        self.vectors, self.directions, self.longest, self.margin = vectors, directions, longest, margin
        codes = _codes(_lift(vectors, longest, False), directions)
        self.whole = codes.view(np.uint64)

    def within(self, codes: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of every code within each query's radius."""
        apart = np.zeros((len(codes), len(self.whole)), np.uint16)
        for ours, theirs in zip(codes.view(np.uint64).T, self.whole.T):
            apart += np.bitwise_count(ours[:, None] ^ theirs[None, :])
        return np.nonzero(apart <= radius[:, None])

    def nearest(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of the k best of each query, with all that tie with the last of them. The radius grows until a row at the k-th best angle found would
        have its code inside with the wanted certainty: ``margin`` standard deviations beyond its expected distance."""
        bits = len(self.directions)
        codes = _codes(_lift(queries, self.longest, True), self.directions)
        radius, found = np.full(len(queries), bits * 3 // 8), [None] * len(queries)
        lengths, todo = np.linalg.norm(queries, axis=1) * self.longest, np.arange(len(queries))
        while len(todo):
            q, r = self.within(codes[todo], radius[todo])
            score = np.einsum("ij,ij->i", queries[todo[q]], self.vectors[r])
            ends = np.searchsorted(q, np.arange(len(todo) + 1))
            again = []
            for at, i in enumerate(todo):
                rows, scores = r[ends[at]:ends[at + 1]], score[ends[at]:ends[at + 1]]
                if len(rows) > k:
                    best = scores >= np.partition(scores, -k)[-k]
                    rows, scores = rows[best], scores[best]
                wanted = bits
                if len(rows) >= k:
                    p = np.arccos(np.clip(scores.min() / lengths[i], -1, 1)) / np.pi
                    wanted = min(bits, ceil(bits * p + self.margin * np.sqrt(bits * p * (1 - p))))
                elif radius[i] < bits:
                    wanted = min(bits, radius[i] + max(1, bits // 16))
                if wanted > radius[i]:
                    radius[i] = wanted
                    again.append(i)
                else:
                    found[i] = rows, scores
            todo = np.array(again, int)
        return found


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", bits: int = 128,
           sample: int = 4096, margin: float = 2.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the largest inner product for each row where ``is_query`` holds.

    ``score`` is the inner product of the original vectors in double precision; ties go to the smaller id, and a
    row is no neighbour of its own id. Null, zero and non-finite vectors and null ids take no part, nor do vectors of another than the
    most frequent dimension. Repeated rows count once; with fewer than k other rows all come out; no rows give no rows.

    The code's rotations are learned on at most ``sample`` distinct vectors; every vector is indexed. Equal vectors are searched
    and found once: of each only the k + 1 smallest ids can be among the nearest. Blocks of queries meet blocks of the
    index, and only the best k + 1 of each query and block are shuffled.
    """
    spark, keep = vectors.sparkSession, k + 1
    own = vectors.select("*", is_query.alias("_asks")).select(F.col(id_column), F.col(vector), "_asks")
    rows = usable(own, id_column, vector).dropDuplicates(["id", "v"])
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    distinct = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    asks = own.where("_asks").select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asking = materialize(rows.join(asks.select("id").distinct(), "id", "left_semi").withColumn("h", F.sha2(F.to_json("v").cast("binary"), 256)), "queries")
    wanted = materialize(asking.groupBy("h").agg(F.first("v").alias("v")), "wanted")

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    about = distinct.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    n_rows, n_queries = about["n"], wanted.count()
    chosen = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    longest = float(about["longest"] or 1.0)
    directions = learn_rotations(_lift(np.array([r["v"] for r in chosen]), longest, False), bits) if chosen else None

    across, down = max(1, ceil(n_rows / BLOCK_ROWS)), max(1, ceil(n_queries / BLOCK_QUERIES))
    by = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = distinct.select(by("v", across).alias("c"), every(down).alias("q"), "v", "ids")
    ask = wanted.select(by("h", down).alias("q"), every(across).alias("c"), "h", "v")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out_h, out_id, out_score = [], [], []
        if left.num_rows and right.num_rows:
            block = Block(matrix(left["v"]), directions, longest, margin)
            queries, names, ids = matrix(right["v"]), right["h"].to_pylist(), left["ids"].to_pylist()
            for at in range(0, len(queries), TOGETHER):
                for i, (found, scores) in enumerate(block.nearest(queries[at:at + TOGETHER], min(keep, len(ids)))):
                    best = sorted((-s, x) for r, s in zip(found.tolist(), scores.tolist()) for x in ids[r])[:keep]
                    out_h += [names[at + i]] * len(best)
                    out_id += [x for _, x in best]
                    out_score += [-s for s, _ in best]
        return pa.table({"h": pa.array(out_h, pa.string()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_score, pa.float64())})

    met = index.groupBy("q", "c").cogroup(ask.groupBy("q", "c")).applyInArrow(meet, "h string, vec_id long, score double")
    best = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    top = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n")
    found = asking.select(F.col("id").cast("long").alias("query_id"), "h").join(top, "h").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
