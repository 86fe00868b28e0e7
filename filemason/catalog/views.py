"""How the given tables are read as inventories, ledgers and snapshots, in Spark and as SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import paths as P
from ..functions import text as X
from ..session import small_batches

AS_OF = "2025-12-01 00:00:00"
USAGE_AS_OF = "2024-01-31 00:00:00"

STEMS = [
    "invoice", "quarterly_report", "recipe_pasta", "course_algebra", "Untitled", "summary_copy", "photo (1)",
    "IMG_1234", "Screenshot 2024-03-10", "song_track", "setup_tool", "old_backup", "family photo",
    "instagram_post", "tutorial_intro", "podcast_talk", "meeting notes", "source_code", ".localrc", "DATA",
    "budget v2", "random", "movie", "report-2024-01-15",
]
SUFFIXES = [
    ".txt", ".pdf", ".md", ".docx", ".jpg", ".png", ".mp4", ".mp3", ".zip", ".py", ".js", ".java", ".c",
    ".exe", ".bak", ".html",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def usage_as_of() -> Column:
    return F.lit(USAGE_AS_OF).cast("timestamp")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _as_files(docs: DataFrame, name: Column) -> DataFrame:
    modified = F.timestamp_micros(
        F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (F.col("doc_id") * 37 % 700) * F.lit(86400000000))
    return (
        docs.withColumn("name", name)
        .select(
            F.col("doc_id").alias("seq"),
            F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"),
                     F.col("name")).alias("path"),
            "name",
            P.extension(F.col("name")).alias("extension"),
            F.octet_length("text").cast("bigint").alias("size"),
            modified.alias("created_at"),
            modified.alias("modified_at"),
            modified.alias("accessed_at"),
            "source",
            "text",
        )
        .withColumn("parent_dir", P.parent_dir(F.col("path")))
        .withColumn("file_type", P.file_type(F.col("extension")))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files whose names reach every rule."""
    doc = F.col("doc_id")
    name = F.concat(_pick(STEMS, doc % 24), F.lit("_"), (doc % 50).cast("string"),
                    _pick(SUFFIXES, F.floor(doc / 24) % 16))
    return _as_files(table(spark, sf_dir, "documents"), name)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as .txt files named by the four longest words of their whole text, so that near copies share name words."""
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    ranked = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("short"), i.alias("first"), w.alias("word")))
    longest = F.coalesce(F.transform(F.slice(F.sort_array(ranked), 1, 4), lambda r: r["word"]), F.array().cast("array<string>"))
    name = F.concat(F.array_join(longest, " "), F.lit(".txt"))
    # One row each: filters on what follows from the name then don't work it out a second time.
    return _as_files(table(spark, sf_dir, "documents").withColumn("title", F.explode(F.array(name))), F.col("title"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a cluster label: the number of their source, one less, so that one label is noise."""
    return files(spark, sf_dir).withColumn("label", F.substring("source", 4, 10).cast("int") - 1)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger of model calls, without costs."""
    kind = F.col("event_type")
    model = (
        F.when(kind == "click", "gpt-3.5-turbo").when(kind == "view", "gpt-4")
        .when(kind == "purchase", "claude-3-haiku").when(kind == "signup", "claude-3-opus")
        .otherwise("unknown-model")
    )
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind.isin("purchase", "signup"), "anthropic").otherwise("openai").alias("provider"),
        model.alias("model"),
        F.floor(F.col("value") * 10).cast("bigint").alias("prompt_tokens"),
        F.floor(F.col("value") * 3).cast("bigint").alias("completion_tokens"),
        F.lit("organization").alias("operation"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model answers: plain JSON, JSON inside prose, or no JSON."""
    folder = F.when(F.col("role") == "user", "Work").otherwise("Personal")
    payload = F.to_json(F.struct(F.col("text").alias("summary"), folder.alias("category"),
                                 F.array(F.col("role")).alias("topics")))
    answer = (
        F.when(F.col("turn") % 3 == 0, payload)
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure: "), payload, F.lit(" done")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", answer.alias("answer"))


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as code files."""
    clean = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "/index")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"),
        F.concat(clean, F.lit(".html")).alias("path"),
        F.octet_length("html").cast("bigint").alias("size"),
        F.col("html").alias("text"),
    ).transform(P.with_path_columns)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_SQL_TYPE = "CASE " + " ".join(
    f"WHEN extension IN {sql_in(exts)} THEN '{kind}'" for kind, exts in V.EXTENSIONS_BY_TYPE.items()
) + " ELSE 'other' END"


def _sql_files(view: str, name: str) -> str:
    return f"""
{view}_named AS (
  SELECT *, {name} AS name FROM documents
), {view}_ext AS (
  SELECT *, regexp_extract(lower(name), '(?s).(\\.[^.]+)$', 1) AS extension,
         '/corpus/' || source || '/' || doc_id || '/' || name AS path
  FROM {view}_named
), {view} AS (
  SELECT doc_id AS seq, path, name, extension, CAST(strlen(text) AS BIGINT) AS size,
         TIMESTAMP '2024-01-01' + to_days(CAST(doc_id * 37 % 700 AS INTEGER)) AS modified_at,
         source, text, regexp_replace(path, '/[^/]*$', '') AS parent_dir, {_SQL_TYPE} AS file_type
  FROM {view}_ext
)"""


FILES_SQL = _sql_files(
    "files",
    f"{_sql_list(STEMS)}[doc_id % 24 + 1] || '_' || (doc_id % 50) || "
    f"{_sql_list(SUFFIXES)}[CAST(floor(doc_id / 24) AS BIGINT) % 16 + 1]",
)
TITLED_SQL = """
title_words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents)
), longest AS (
  SELECT doc_id, w, min(p) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, min(p)) AS r FROM title_words GROUP BY doc_id, w
), titles AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY r) || '.txt' AS title FROM longest WHERE r <= 4 GROUP BY doc_id
),""" + _sql_files("titled", "coalesce((SELECT title FROM titles t WHERE t.doc_id = documents.doc_id), '.txt')")
CLUSTERED_SQL = FILES_SQL + """, clustered AS (
  SELECT *, CAST(substr(source, 4) AS INTEGER) - 1 AS label FROM files
)"""
USAGE_SQL = """
usage_raw AS (
  SELECT ts AS "timestamp",
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'anthropic' ELSE 'openai' END AS provider,
         CASE event_type WHEN 'click' THEN 'gpt-3.5-turbo' WHEN 'view' THEN 'gpt-4'
              WHEN 'purchase' THEN 'claude-3-haiku' WHEN 'signup' THEN 'claude-3-opus'
              ELSE 'unknown-model' END AS model,
         CAST(floor(value * 10) AS BIGINT) AS prompt_tokens,
         CAST(floor(value * 3) AS BIGINT) AS completion_tokens
  FROM events
)"""
ANSWERS_SQL = """
payloads AS (
  SELECT conv_id, turn, role, text, CAST(json_object('summary', text, 'category',
         CASE WHEN role = 'user' THEN 'Work' ELSE 'Personal' END, 'topics', [role]) AS VARCHAR) AS payload
  FROM conversations
), answers AS (
  SELECT conv_id, turn, role,
         CASE turn % 3 WHEN 0 THEN payload WHEN 1 THEN 'Sure: ' || payload || ' done' ELSE text END AS answer
  FROM payloads
)"""


HASH_LETTERS = "ainorstu"


# Bytes of text whose letters are counted at once.
COUNTED_BYTES = 1 << 20


def _grid_hashes(texts: pa.Array) -> np.ndarray:
    """The hashes of some texts, which lie one after another in a buffer. A character begins at each byte that doesn't continue one."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data, ends = data[ends[0]:ends[-1]], ends.astype(np.int64) - ends[0]
    letter = np.full(256, 255, np.uint8)
    letter[[ord(c) for c in HASH_LETTERS]] = np.arange(len(HASH_LETTERS))
    found = letter[data]
    at = np.flatnonzero(found != 255)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    width = np.maximum(1, -(-np.diff(begun[ends]) // 8))
    text = np.searchsorted(ends, at, "right") - 1
    segment = (begun[at] - begun[ends[text]]) // width[text]
    counts = np.bincount(text * 64 + segment * 8 + found[at], minlength=64 * len(texts)).reshape(-1, 64)
    bits = (counts * 64 > counts.sum(axis=1)[:, None]).astype(np.uint64)
    return np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64), axis=1).view(np.int64)


def _hash_column(texts: pa.Array) -> pa.Array:
    """Null texts have no letters."""
    texts, out, at = texts.fill_null(""), [np.zeros(0, np.int64)], 0
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    while at < len(texts):
        size = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED_BYTES, "right")) - at)
        out.append(_grid_hashes(texts.slice(at, size)))
        at += size
    return pa.array(np.concatenate(out))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average hash of each whole text: eight equal segments by the counts of eight letters make an
    8 × 8 grid, and a bit tells whether its cell is above the mean."""
    small_batches(spark)

    def hashed(texts: pa.Array) -> pa.Array:
        return _hash_column(texts)

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.octet_length("text").cast("bigint").alias("size"),
        F.arrow_udf(hashed, "bigint")(F.lower("text")).alias("hash"))


HASHES_SQL = f"""
segments AS (
  SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, lower(text) AS t,
         greatest(1, CAST(ceil(length(text) / 8.0) AS BIGINT)) AS w
  FROM documents
), cells AS (
  SELECT doc_id AS seq, size, flatten([[
    length(s) - length(replace(s, l, '')) for l in [{", ".join(f"'{c}'" for c in HASH_LETTERS)}]
  ] for s in [substr(t, 1 + i * w, w) for i in range(8)]]) AS c FROM segments
), hashes AS (
  SELECT seq, size, list_sum([CASE WHEN c[i + 1] * 64 > list_sum(c) THEN (1::HUGEINT << i) ELSE 0::HUGEINT END
                              for i in range(64)])::HUGEINT AS hash
  FROM cells
)"""


def sql(*ctes: str, recursive: bool = False) -> str:
    """``WITH`` clause from common table expressions, the last argument being the query."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {', '.join(c.strip() for c in ctes[:-1])}\n{ctes[-1].strip()}"
