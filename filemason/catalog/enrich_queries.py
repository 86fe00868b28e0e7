"""Enrichment and cache queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..operators import enrich as E
from ..operators import usage as U
from ..operators.budget import Budget
from ..operators.folder_match import match_folders
from ..session import scratch_root
from ..sources import cache_store as CS
from ..sources.result_store import ResultStore
from . import views
from .inventory_queries import AS_OF_SQL
from .usage_queries import _PRICES
from .views import ANSWERS_SQL, FILES_SQL, sql, sql_in


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata summaries whose importance follows the quality labels where there are any."""
    labels = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality")
    rows = E.metadata_summaries(views.files(spark, sf_dir)).join(labels, "seq", "left")
    graded = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise(F.col("importance"))
    return rows.withColumn("importance", graded).drop("quality")


def _topics(df: DataFrame) -> DataFrame:
    return df.withColumn("topics", F.array_join("topics", ","))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over whole texts, plain and with custom criteria, by digest and length."""
    plain = E.analysis_prompt(F.col("text"))
    custom = E.analysis_prompt(F.col("text"), criteria="by project")
    return views.files(spark, sf_dir).select(
        "seq", F.sha2(plain, 256).alias("plain_hash"), F.length(plain).alias("plain_chars"),
        F.sha2(custom, 256).alias("custom_hash"))


def metadata_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(_summaries(spark, sf_dir))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = views.answers(spark, sf_dir).select("conv_id", "turn", E.parsed_answer(F.col("answer"), summary_chars=100).alias("p"))
    return _topics(parsed.select("conv_id", "turn", "p.*"))


def enrich_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(E.summarize(views.files(spark, sf_dir))).select(
        "seq", "summary", "category", "topics", "importance", "suggested_folder", "confidence", "prompt_tokens")


def enrich_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files after a run that has read the labelled ones: their results come from the store."""
    files = views.files(spark, sf_dir)
    labelled = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    run = E.ModelRun(views.as_of(), ResultStore(spark, f"{scratch_root(spark)}/results-{uuid.uuid4().hex}"))
    E.summarize(files.join(labelled, "seq", "left_semi"), run=run)
    return E.summarize(files, run=run).select("seq", "origin", "summary", "category", "confidence", "prompt_tokens")


def enrich_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files under a limit that a part of them uses up, with what their calls cost."""
    run = E.ModelRun(views.as_of(), budget=Budget(0.5, "openai", "gpt-4"))
    summaries = E.summarize(views.files(spark, sf_dir), run=run)
    priced = U.with_cost(summaries.withColumns({"provider": F.lit("openai"), "model": F.lit("gpt-4")}))
    return priced.select("seq", "origin", "category", F.round("cost_usd", 6).alias("cost_usd"))


def usage_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger rows of the stub's calls, with costs, in total."""
    summaries = E.summarize(views.files(spark, sf_dir))
    ledger = U.with_cost(E.metered(summaries, "openai", "gpt-4", views.as_of()))
    return U.totals(ledger).select(F.round("cost_usd", 4).alias("cost_usd"), "calls")


def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files whose texts fit a running budget of input characters."""
    files = views.files(spark, sf_dir).select("seq", "size")
    return E.within_budget(files, F.col("size"), 1000000).select("seq", "spent")


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.category_report(_summaries(spark, sf_dir))


def category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.category_files(_summaries(spark, sf_dir))


def folder_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.folder_prompt(_summaries(spark, sf_dir)).select("prompt")


def fallback_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fallback_folders(_summaries(spark, sf_dir))


def folder_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = _summaries(spark, sf_dir)
    return match_folders(summaries, E.propose_folders(summaries)).select("seq", "folder")


def enrichment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = _summaries(spark, sf_dir)
    plan = E.enrichment_plan(summaries, E.propose_folders(summaries), reason_chars=50)
    return plan.select("action_type", "source", "destination", "reason", "confidence")


def enrichment_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.preview(views.files(spark, sf_dir), 10)


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).select("seq", CS.cache_key().alias("key"), CS.cache_key("v2").alias("salted_key"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result for every labelled document; those of low quality expired in November."""
    labels = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality", "toxic")
    rows = views.files(spark, sf_dir).join(labels, "seq")
    at = F.lit("2025-11-01").cast("timestamp")
    value = F.to_json(F.struct("toxic"))
    lasting = CS.entries(rows.where("quality = 1"), CS.cache_key(), value, at)
    return lasting.unionByName(CS.entries(rows.where("quality = 0"), CS.cache_key(), value, at, 86400))


def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, misses = CS.split(views.files(spark, sf_dir), _cache(spark, sf_dir), views.as_of())
    return hits.select("seq", F.lit("hit").alias("route"), "value").unionByName(
        misses.select("seq", F.lit("miss").alias("route"), F.lit(None).cast("string").alias("value")))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.statistics(_cache(spark, sf_dir), views.as_of())


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after results for all toxic documents were stored again."""
    cache = _cache(spark, sf_dir)
    labels = views.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("seq"))
    again = views.files(spark, sf_dir).join(labels, "seq", "left_semi")
    new = CS.entries(again, CS.cache_key(), F.lit('{"toxic":"again"}'), views.as_of())
    merged = CS.upsert(cache, new)
    return merged.select("key", "value", F.date_format("timestamp", "yyyy-MM-dd").alias("stored"),
                         F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


QUERIES = {f.__name__: f for f in (
    prompts, metadata_summaries, parsed_answers, enrich_stub, usage_metering, budget_cut, category_report,
    category_files, folder_prompt, fallback_folders, folder_match, enrichment_plan, enrichment_preview,
    cache_key, cache_split, cache_stats, cache_upsert, enrich_cached, enrich_limited)}


def _prompt_sql(task: str) -> str:
    return f"'{task}' || chr(10) || 'File: ' || name || chr(10) || 'Content: ' || text || chr(10) || '{E._ANSWER_FORM}'"


def _category_sql(by_type: bool) -> str:
    words = " ".join(f"WHEN regexp_matches(lower(name), '{X.literal_pattern(w)}') THEN '{c}'" for c, w in V.CATEGORY_WORDS)
    types = " ".join(f"WHEN file_type = '{t}' THEN '{c}'" for t, c in V.CATEGORY_BY_TYPE.items()) if by_type else ""
    return f"CASE {words} {types} ELSE 'General' END"


_FOLDER_SQL = "CASE file_type " + " ".join(f"WHEN '{t}' THEN '{f}'" for t, f in V.SUMMARY_FOLDER_BY_TYPE.items()) + " END"
SUMMARIES_SQL = f"""
summaries AS (
  SELECT seq, name AS file_name, path AS file_path, file_type, file_type || ' file: ' || name AS summary,
         {_category_sql(True)} AS category, file_type AS topics,
         CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS importance,
         {_FOLDER_SQL} AS suggested_folder, 0.6::DOUBLE AS confidence
  FROM files LEFT JOIN labels ON doc_id = seq
)"""
_DIRS_SQL = "CASE lower(category) " + " ".join(
    f"WHEN '{c}' THEN [{', '.join(chr(39) + f + chr(39) for f in fs)}]" for c, fs in V.CATEGORY_DIRECTORIES.items()
) + " ELSE ['Documents/' || category] END"
FOLDERS_SQL = f"""
categories AS (
  SELECT category, count(*) AS n_files, min(seq) AS first_seq FROM summaries GROUP BY category
), folders AS (
  SELECT first_seq, unnest({_DIRS_SQL}) AS folder, generate_subscripts({_DIRS_SQL}, 1) - 1 AS pos FROM categories
)"""
MATCH_SQL = f"""
scores AS (
  SELECT s.seq, f.folder, f.first_seq, f.pos,
         CASE WHEN contains(lower(f.folder), lower(s.category)) THEN 3 ELSE 0 END
         + CASE WHEN contains(lower(f.folder), lower(s.topics)) THEN 2 ELSE 0 END
         + CASE WHEN contains(lower(f.folder), lower(s.suggested_folder)) THEN 4 ELSE 0 END AS score
  FROM summaries s, folders f
), best AS (
  SELECT seq, folder FROM scores WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, first_seq, pos) = 1
), matched AS (
  SELECT s.*, coalesce(b.folder,
    CASE WHEN lower(category) IN {sql_in(V.WORK_CATEGORIES)}
         THEN (SELECT arg_min(folder, (first_seq, pos)) FROM folders WHERE contains(lower(folder), 'work'))
         WHEN lower(category) IN {sql_in(V.PERSONAL_CATEGORIES)}
         THEN (SELECT arg_min(folder, (first_seq, pos)) FROM folders WHERE contains(lower(folder), 'personal')) END,
    'Documents') AS folder
  FROM summaries s LEFT JOIN best b USING (seq)
)"""
LISTING_SQL = """
listed AS (
  SELECT category, file_name, topics, row_number() OVER (PARTITION BY category ORDER BY seq) AS rank FROM summaries
)"""
STUB_SQL = f"""
stub AS (
  SELECT seq, name, file_type, size, text, file_type IN ('document', 'code') AND text <> '' AS asked,
         {_category_sql(False)} AS asked_category, {_category_sql(True)} AS category, {_FOLDER_SQL} AS folder,
         {_prompt_sql("Describe this file.")} AS prompt
  FROM files
), stub_calls AS (
  SELECT *, len(list_filter(regexp_split_to_array(prompt, '\\s+'), lambda w: w <> '')) AS prompt_tokens,
         len(list_filter(regexp_split_to_array('{{"summary": "About ' || name || '", "category": "' || asked_category
             || '", "topics": ["' || lower(asked_category) || '"]}}', '\\s+'), lambda w: w <> '')) AS completion_tokens
  FROM stub
)"""
_KEY_SQL = "'llm_analysis:' || md5(path || ':' || epoch_us(modified_at) || ':' || size{})".format
CACHE_SQL = f"""
cache AS (
  SELECT {_KEY_SQL("")} AS key, '{{"toxic":' || toxic || '}}' AS value, TIMESTAMP '2025-11-01' AS stored,
         CASE WHEN quality = 0 THEN TIMESTAMP '2025-11-02' END AS expires, toxic
  FROM files JOIN labels ON doc_id = seq
)"""

SQL = {
    "prompts": sql(FILES_SQL, f"""
        SELECT seq, sha256({_prompt_sql("Describe this file.")}) AS plain_hash,
               CAST(length({_prompt_sql("Describe this file.")}) AS BIGINT) AS plain_chars,
               sha256({_prompt_sql("Describe this file by these criteria: by project")}) AS custom_hash FROM files"""),
    "metadata_summaries": sql(FILES_SQL, SUMMARIES_SQL, "SELECT * FROM summaries"),
    "parsed_answers": sql(ANSWERS_SQL, """
        shaped AS (
          SELECT *, CASE WHEN json_valid(answer) THEN answer
                         ELSE nullif(regexp_extract(answer, '(?s)\\{.*\\}'), '') END AS body,
                 CASE WHEN json_valid(answer) THEN 'object'
                      WHEN json_valid(nullif(regexp_extract(answer, '(?s)\\{.*\\}'), '')) THEN 'rescued' ELSE 'text' END AS form
          FROM answers
        )""", """
        SELECT conv_id, turn, CASE WHEN form = 'text' THEN left(answer, 100) ELSE json_extract_string(body, '$.summary') END AS summary,
               CASE WHEN form = 'text' THEN 'General' ELSE json_extract_string(body, '$.category') END AS category,
               CASE WHEN form = 'text' THEN '' ELSE json_extract_string(body, '$.topics[0]') END AS topics,
               'medium' AS importance, 'Documents' AS suggested_folder,
               CASE WHEN form = 'text' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence, form
        FROM shaped"""),
    "enrich_stub": sql(FILES_SQL, STUB_SQL, """
        SELECT seq, CASE WHEN asked THEN 'About ' || name ELSE file_type || ' file: ' || name END AS summary,
               CASE WHEN asked THEN asked_category ELSE category END AS category,
               CASE WHEN asked THEN lower(asked_category) ELSE file_type END AS topics, 'medium' AS importance,
               CASE WHEN asked THEN 'Documents' ELSE folder END AS suggested_folder,
               CASE WHEN asked THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence,
               CASE WHEN asked THEN prompt_tokens ELSE 0 END::BIGINT AS prompt_tokens
        FROM stub_calls"""),
    "enrich_cached": sql(FILES_SQL, STUB_SQL, """
        SELECT seq, CASE WHEN NOT asked THEN 'metadata' WHEN doc_id IS NULL THEN 'model' ELSE 'cache' END AS origin,
               CASE WHEN asked THEN 'About ' || name ELSE file_type || ' file: ' || name END AS summary,
               CASE WHEN asked THEN asked_category ELSE category END AS category, CASE WHEN asked THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence,
               CASE WHEN asked AND doc_id IS NULL THEN prompt_tokens ELSE 0 END::BIGINT AS prompt_tokens
        FROM stub_calls LEFT JOIN (SELECT DISTINCT doc_id FROM labels) ON doc_id = seq"""),
    "enrich_limited": sql(FILES_SQL, STUB_SQL, f"""
        prices(provider, model, input, output) AS (VALUES {_PRICES})""", """
        costs AS (
          SELECT *, CASE WHEN asked THEN (prompt_tokens / 1000 * input + completion_tokens / 1000 * output)::DECIMAL(30, 12) ELSE 0 END AS cost
          FROM stub_calls, prices WHERE model = 'gpt-4')""", """
        admitted AS (SELECT *, asked AND sum(cost) OVER (ORDER BY seq) - cost < 0.5 AS used FROM costs)""", """
        SELECT seq, CASE WHEN used THEN 'model' ELSE 'metadata' END AS origin, CASE WHEN used THEN asked_category ELSE category END AS category,
               CASE WHEN used THEN round(cost::DOUBLE, 6) ELSE 0 END::DOUBLE AS cost_usd FROM admitted"""),
    "usage_metering": sql(FILES_SQL, STUB_SQL, f"""
        prices(provider, model, input, output) AS (VALUES {_PRICES})""", """
        SELECT round(sum(prompt_tokens / 1000 * input + completion_tokens / 1000 * output), 4) AS cost_usd, count(*) AS calls
        FROM stub_calls, prices WHERE asked AND model = 'gpt-4'"""),
    "budget_cut": sql(FILES_SQL, """
        SELECT seq, CAST(spent AS BIGINT) AS spent FROM (
          SELECT seq, size, sum(size) OVER (ORDER BY seq) AS spent FROM files) WHERE spent - size < 1000000"""),
    "category_report": sql(FILES_SQL, SUMMARIES_SQL, FOLDERS_SQL, "SELECT category, n_files, first_seq FROM categories"),
    "category_files": sql(FILES_SQL, SUMMARIES_SQL, LISTING_SQL, "SELECT * FROM listed WHERE rank <= 5"),
    "folder_prompt": sql(FILES_SQL, SUMMARIES_SQL, FOLDERS_SQL, LISTING_SQL, """
        blocks AS (
          SELECT first_seq, chr(10) || category || ':' || chr(10)
                 || string_agg('  - ' || file_name || ' (topics: ' || topics || ')' || chr(10), '' ORDER BY rank)
                 || CASE WHEN n_files > 5 THEN '  ... and ' || (n_files - 5) || ' more files' || chr(10) ELSE '' END AS block
          FROM listed JOIN categories USING (category) WHERE rank <= 5 GROUP BY first_seq, category, n_files
        )""", f"""
        SELECT 'Propose a folder structure.' || chr(10) || 'Files:' || string_agg(block, '' ORDER BY first_seq)
               || chr(10) || '{E._FOLDER_FORM}' AS prompt FROM blocks"""),
    "fallback_folders": sql(FILES_SQL, SUMMARIES_SQL, FOLDERS_SQL, "SELECT first_seq, pos, folder FROM folders"),
    "folder_match": sql(FILES_SQL, SUMMARIES_SQL, FOLDERS_SQL, MATCH_SQL, "SELECT seq, folder FROM matched"),
    "enrichment_plan": sql(FILES_SQL, SUMMARIES_SQL, FOLDERS_SQL, MATCH_SQL, """
        SELECT 'move' AS action_type, file_path AS source, folder || '/' || file_name AS destination,
               'LLM categorized as ' || category || ': ' || left(summary, 50) || '...' AS reason, confidence FROM matched
        UNION ALL
        SELECT 'create_dir', '', folder, 'LLM-suggested directory structure', 1.0 FROM folders"""),
    "enrichment_preview": sql(FILES_SQL, STUB_SQL, """
        summaries AS (
          SELECT seq, CASE WHEN asked THEN asked_category ELSE category END AS category FROM stub ORDER BY seq LIMIT 10
        )""", FOLDERS_SQL, """
        SELECT category, n_files, (SELECT string_agg(folder, ', ' ORDER BY first_seq, pos) FROM folders) AS folders
        FROM categories"""),
    "cache_key": sql(FILES_SQL, f"""
        SELECT seq, {_KEY_SQL("")} AS key, {_KEY_SQL(" || ':v2'")} AS salted_key FROM files"""),
    "cache_split": sql(FILES_SQL, CACHE_SQL, f"""
        SELECT seq, CASE WHEN c.key IS NULL THEN 'miss' ELSE 'hit' END AS route, c.value
        FROM files f LEFT JOIN (SELECT * FROM cache WHERE expires IS NULL OR expires >= {AS_OF_SQL}) c
          ON c.key = {_KEY_SQL("")}"""),
    "cache_stats": sql(FILES_SQL, CACHE_SQL, f"""
        SELECT count(*) AS total_entries, count(*) FILTER (expires < {AS_OF_SQL}) AS expired_entries,
               count(*) - count(*) FILTER (expires < {AS_OF_SQL}) AS valid_entries FROM cache"""),
    "cache_upsert": sql(FILES_SQL, CACHE_SQL, """
        SELECT key, CASE WHEN toxic = 1 THEN '{"toxic":"again"}' ELSE value END AS value,
               CASE WHEN toxic = 1 THEN '2025-12-01' ELSE strftime(stored, '%Y-%m-%d') END AS stored,
               CASE WHEN toxic = 0 THEN strftime(expires, '%Y-%m-%d') END AS expires FROM cache"""),
}
