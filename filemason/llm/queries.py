"""The registered queries over the given tables: each operator with production parameters on whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, lexical_search, license_scan, line_templates, near_copies, neighbour_search, packing, quality, substrings, token_counts, whitening
from .common import rank_in_group, small_batches, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a reply chain, formatted; the digests are read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    tricky = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    chain = rank_in_group(rows.unionByName(extra), ["conv_id"], ["turn", "role", "text"], "place")
    previous = F.when(F.col("place") > 1, F.col("place") - 1)
    formatted = chat.format_conversations(
        chain.withColumn("previous", previous), tree="conv_id", message="place", parent="previous", score=None)
    small_batches(spark)
    kept = formatted.select("tree_id", "formatted", F.col("loss_spans.start").alias("starts"), F.col("loss_spans.end").alias("ends"))

    def digest(*parts: str) -> str:
        total = hashlib.sha256()
        for p in parts:
            total.update(p.encode())
        return total.hexdigest()

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, starts, ends = (batch.column(i) for i in range(4))
            out: list[list] = [[] for _ in range(5)]
            for text, begin, end in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
                turns = chat.parse(text)
                trained = [chat.unescape(text[a:b]) for a, b in zip(begin, end)]
                values = (len(turns), digest(*(x for role, body in turns for x in (role, "\n", body, "\n"))),
                          sum(map(len, trained)), digest(*trained), len(text))
                for column, value in zip(out, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return kept.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                      "formatted_chars long")


OP1_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
marked AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS escaped,
    length(role) + length(regexp_replace(role, '[^\\\\:#<\\n]', '', 'g')) AS escaped_role
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + escaped_role + 14)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), quality.learnt_from)
    return scored.select("doc_id", (~quality.learnt_from(F.col("doc_id"))).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Ids of each document and the text that they decode to, as digests."""
    path = public_tokenizers.path(vocabulary)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                             F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))
    decoded = bpe.decode(digests, path, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Tokens of each document under a unigram model with the given pieces and scores."""
    path = public_tokenizers.path(vocabulary)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), lambda: token_counts.sentencepiece_vocabulary(path), name=path)


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near copies."""
    return near_copies.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_neighbour_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbour_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_packing(spark: SparkSession, sf_dir: str, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Every document's pieces with their places in as few sequences as best fit finds."""
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), capacity)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(narrow, capacity)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, those dropped, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_templates.drop_recurring_lines(docs, count_columns=True)
    kept = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_lines", "n_dropped", F.length(kept).cast("long").alias("kept_chars"),
                       F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = "WITH " + line_templates.oracle_sql() + """
SELECT doc_id, n_lines, n_dropped, length(coalesce(text, ''))::BIGINT AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256 FROM line_result"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself with the last half replaced by the beginning of the next document."""
    def edit(text: str, following: str) -> str:
        half = len(text) // 2
        return text[:len(text) - half] + following[:half]

    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"), edit)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-byte strings of earlier ones."""
    left = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 principal axes of the distinct ones, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, licence phrases and licence labels."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_near_copies": op5_near_copies,
    "op6_neighbour_search": op6_neighbour_search,
    "op7_packing": op7_packing,
    "op8_line_templates": op8_line_templates,
    "op9_fingerprints": op9_fingerprints,
    "op10_substrings": op10_substrings,
    "op11_lexical_search": op11_lexical_search,
    "op12_whitening": op12_whitening,
    "op13_license_scan": op13_license_scan,
}
#: The pipeline is registered beside these by the module at the repository's top.
SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op8_line_templates": OP8_SQL, "op11_lexical_search": lexical_search.oracle_sql(),
                       "op13_license_scan": license_scan.oracle_sql()}
