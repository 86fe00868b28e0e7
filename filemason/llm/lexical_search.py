"""Ranked lexical search: bundles of items pass through the owners of their terms one after another, carrying accumulators.

The index is cut twice: by blocks of documents, so that the accumulators of a bundle over a block are bounded, and by
term owners. In each stage the bundles of a block meet the postings of that block's next owner, which adds its terms'
integer contributions to the sparse accumulators and strikes these terms off; after the last owner the best documents
of each item and block are selected, and of these the best of all blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import materialize
from .common import partitions, small_batches

#: What separates terms: all of ASCII but digits and letters; A to Z fall together with a to z, other letters stay as they are.
SEPARATES = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in SEPARATES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Bits of the filter that tells in one look which terms of a document may be an item's.
FILTER_BITS = 1 << 20


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(FOLD).split()


def _raw(frame: DataFrame, id_column: str, text: str, out: str) -> DataFrame:
    return frame.select(F.col(id_column).alias(out), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))


def item_terms(items: DataFrame, item_column: str, text: str) -> DataFrame:
    """``(item, term, wanted)``: how often each item has each of its terms. Repeated rows count once; texts of one id add up."""
    rows = _raw(items.dropDuplicates([item_column, text]), item_column, text, "item")
    schema = T.StructType([rows.schema["item"], *T._parse_datatype_string("term string, n long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms_of(x)) for x in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([t.decode() for c in counted for t in c], pa.string()),
                 pa.array([n for c in counted for n in c.values()], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema).groupBy("item", "term").agg(F.sum("n").alias("wanted"))


def index_blocks(docs: DataFrame, id_column: str, text: str, wanted: bytes, owners: int, block: int) -> DataFrame:
    """The blocks of the index: rows ``(block, owner, terms, holders, rows, tfs)`` with the postings of one owner's terms that
    ``wanted`` (a bit per remainder of the terms' crc32) lets pass, one after another, and for each block a row of owner
    -1 with the documents' ``ids`` in ascending order (null last) and their numbers of terms ``ns``."""
    small_batches(docs.sparkSession)
    rows = _raw(docs, id_column, text, "id")
    schema = T.StructType([
        *T._parse_datatype_string("block long, owner int, terms array<string>, holders array<int>, rows array<int>, tfs array<int>").fields,
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("ns", T.ArrayType(T.IntegerType()))])

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def flush(number: int, parts: list[pa.Array], ns: list[int], postings: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(parts)
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        none, numbers = pa.nulls(1, pa.list_(pa.int32())), lambda x: one(pa.array(x, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([-1], pa.int32()), pa.nulls(1, pa.list_(pa.string())), none, none, none,
             one(ids.take(pa.array(order))), numbers(np.array(ns, np.int32)[order])], names=schema.names)
        of: list[list[bytes]] = [[] for _ in range(owners)]
        for term in postings:
            of[zlib.crc32(term) // FILTER_BITS % owners].append(term)
        for owner, terms in enumerate(of):
            if terms:
                flat = np.array([x for t in terms for x in postings[t]], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([owner], pa.int32()), one(pa.array([t.decode() for t in terms], pa.string())),
                     numbers([len(postings[t]) for t in terms]), numbers(place[flat >> 32]), numbers(flat & 0xFFFFFFFF),
                     pa.nulls(1, pa.list_(ids.type)), none], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, ns, postings = TaskContext.get().partitionId() << 32, [], [], {}
        for batch in batches:
            split = [terms_of(x) for x in batch.column(1).to_pylist()]
            crc = {t: zlib.crc32(t) % FILTER_BITS for t in set().union(*split)}
            passed = {t for t, x in crc.items() if wanted[x >> 3] >> (x & 7) & 1}.__contains__
            for terms in split:
                for t, n in Counter(filter(passed, terms)).items():
                    postings.setdefault(t, []).append(len(ns) << 32 | n)
                ns.append(len(terms))
            parts.append(batch.column(0))
            if len(ns) >= block:
                yield from flush(number, parts, ns, postings)
                number, parts, ns, postings = number + 1, [], [], {}
        if ns:
            yield from flush(number, parts, ns, postings)

    return rows.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id",
           item_text: str = "text", owners: int = 4, block: int = 2048, bundle: int = 256) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` documents with the highest score above 0 for each item, equal scores by ascending id.

    Terms are runs of letters and digits (all beyond ASCII counts as a letter), A to Z in lower case. With N documents that have
    a term, L terms in all of them, df documents that hold a term, tf its occurrences in a document of n terms: the
    weight is floor(1000 ln((2N + 2) / (2df + 1))), m is 75 + 25nN div L, and the score sums weight * (10^9 tf div (1000 tf + 12m))
    over an item's terms, repeats included. Whole texts of all documents are counted and searched, nothing is pruned.

    Every row of ``docs`` is a document: repeated rows get a rank each; null and empty texts count nowhere; a null id comes last
    among equal scores. Repeated rows of items count once, several texts of an item are taken together, items without a term
    have no rows, and no rows of either give no rows. Other columns are not read.

    Only the filter's bits (128 KB), two sums and the number of items reach the driver. A bundle holds about ``bundle`` items and
    meets about ``block`` documents at a time, whatever the number of documents that share a term.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_column, item_text), "item-terms")
    crc = F.crc32(F.col("term").cast("binary"))
    bits = bytearray(FILTER_BITS >> 3)
    for row in asked.select((crc % FILTER_BITS).alias("x")).distinct().toLocalIterator():
        bits[row["x"] >> 3] |= 1 << (row["x"] & 7)
    blocks = materialize(index_blocks(docs, id_column, text, bytes(bits), owners, block), "blocks")
    held, postings = blocks.where("owner < 0").select("block", "ids", "ns"), blocks.where("owner >= 0").drop("ids", "ns")

    total = held.agg(F.sum(F.size(F.filter("ns", lambda n: n > 0))).cast("long").alias("n"),
                     F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, max(1, total["l"] or 0)
    zipped = F.explode(F.arrays_zip("terms", "holders"))
    df = postings.select(zipped.alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.holders").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, "term").withColumn("weight", weight * F.col("wanted")).where("weight > 0")

    n_bundles = max(1, ceil(asked.select("item").distinct().count() / bundle))
    weighted = materialize(weighted.select(F.pmod(F.xxhash64("item"), F.lit(n_bundles)).cast("int").alias("bundle"), "item", "term",
                                           (F.floor(crc / FILTER_BITS) % owners).cast("int").alias("owner"), "weight"), "weighted")
    numbered = weighted.groupBy("bundle", "item").agg(F.collect_list(F.struct("owner", "term", "weight")).alias("t"))
    numbered = numbered.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("item", "t"))).alias("i"))
    todo = F.flatten(F.transform("i", lambda x, no: F.transform(x["t"], lambda t: F.struct(
        t["owner"].alias("owner"), t["term"].alias("term"), no.cast("int").alias("no"), t["weight"].alias("weight")))))
    bundles = numbered.select("bundle", F.col("i.item").alias("items"), todo.alias("t")).select(
        "bundle", "items", *(F.col(f"t.{c}").alias(f"t_{c}") for c in ("owner", "term", "no", "weight")))
    # each bundle visits every block: a copy of the bundle for each of so many shares of the blocks, so that no key is hot
    shares = partitions(spark)
    copies = bundles.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    visits = held.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")).withColumn(
        "bundle", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))))
    nothing = F.lit(b"")
    carried = visits.join(copies.hint("merge"), ["bundle", "share"]).drop("share").withColumn("at", nothing).withColumn("scores", nothing)
    schema = T._parse_datatype_string(", ".join(f"{name} {kind}" for name, kind in carried.dtypes))
    arrow = to_arrow_schema(schema)

    def values(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def add(owner: int):
        def visit(left: pa.Table, right: pa.Table) -> pa.Table:
            """One bundle and block at one owner: its terms' contributions go into the accumulators, the terms leave the bundle."""
            left = left.cast(arrow)
            if not left.num_rows or not right.num_rows:
                return left
            ns, items = values(left["ns"]).astype(np.int64), len(left["items"][0])
            m = 100 - 25 + 25 * ns * n_docs // n_terms
            total = np.zeros(items * len(ns), np.int64)
            total[np.frombuffer(left["at"][0].as_py(), "<i4")] = np.frombuffer(left["scores"][0].as_py(), "<i8")
            rows, tfs = values(right["rows"]), values(right["tfs"]).astype(np.int64)
            ends = np.cumsum(values(right["holders"]))
            place = {t: i for i, t in enumerate(values(right["terms"]).tolist())}
            share = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[rows])
            owners_of, numbers, weights = (values(left[c]) for c in ("t_owner", "t_no", "t_weight"))
            terms = values(left["t_term"])
            for i in np.flatnonzero(owners_of == owner).tolist():
                at = place.get(terms[i])
                if at is not None:
                    own = slice(ends[at - 1] if at else 0, ends[at])
                    total[numbers[i] * len(ns) + rows[own]] += weights[i] * share[own]
            at, still = np.flatnonzero(total), np.flatnonzero(owners_of != owner)
            columns = {c: left[c] for c in left.column_names}
            columns["at"], columns["scores"] = pa.array([at.astype("<i4").tobytes()]), pa.array([total[at].astype("<i8").tobytes()])
            for c in ("t_owner", "t_term", "t_no", "t_weight"):
                kept = left[c].combine_chunks().flatten().take(pa.array(still))
                columns[c] = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
            return pa.table(columns).cast(arrow)

        return visit

    for owner in range(owners):
        own = postings.where(F.col("owner") == owner).select(F.col("block").alias("place"), "terms", "holders", "rows", "tfs").withColumn(
            "guest", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))))
        carried = carried.groupBy("block", "bundle").cogroup(own.groupBy("place", "guest")).applyInArrow(add(owner), schema)

    best = T.StructType([T.StructField("item", schema["items"].dataType.elementType), T.StructField("id", schema["ids"].dataType.elementType),
                         T.StructField("score", T.LongType())])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, items = batch.column("ids")[row].values, batch.column("items")[row].values
                at, scores = np.frombuffer(batch.column("at")[row].as_py(), "<i4"), np.frombuffer(batch.column("scores")[row].as_py(), "<i8")
                ends = np.searchsorted(at, np.arange(len(items) + 1) * len(ids))
                chosen = []
                for begin, end in zip(ends, ends[1:]):
                    own = np.arange(begin, end)
                    if len(own) > k:  # of equal scores the first, as ids ascend
                        least = np.partition(scores[begin:end], -k)[-k]
                        own = np.concatenate([own[scores[own] > least], own[scores[own] == least]])[:k]
                    chosen.append(own)
                flat = np.concatenate([*chosen, np.zeros(0, int)]).astype(int)
                yield pa.RecordBatch.from_arrays(
                    [items.take(pa.array(np.repeat(np.arange(len(items)), [len(c) for c in chosen]))), ids.take(pa.array(at[flat] % max(1, len(ids)))),
                     pa.array(scores[flat])], names=best.names)

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = carried.select("ids", "items", "at", "scores").mapInArrow(select, best)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


def oracle_sql(k: int = 20) -> str:
    """The same ranking in DuckDB's SQL."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}'))"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
words AS (SELECT row, {words} AS term FROM numbered),
tfs AS (SELECT row, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM tfs GROUP BY row),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (SELECT item_id, term, count(*)::BIGINT AS wanted FROM (
  SELECT item_id, {words} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
weighted AS (
  SELECT item_id, term, wanted * floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM asked JOIN dfs USING (term), total),
scored AS (
  SELECT item_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weighted JOIN tfs USING (term) JOIN lengths USING (row), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored JOIN numbered USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
