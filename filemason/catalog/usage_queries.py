"""Usage, cost and corpus-profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import profile
from ..operators import usage as U
from . import views
from .views import FILES_SQL, USAGE_SQL, sql


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_cost(views.usage(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 8))
    return df


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ledger(spark, sf_dir).select("timestamp", "provider", "model", "cost_usd"), "cost_usd").withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.totals(_ledger(spark, sf_dir)), "cost_usd")


def _daily(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    return U.daily_costs(_ledger(spark, sf_dir), views.usage_as_of(), days)


def _dated(df: DataFrame) -> DataFrame:
    return _rounded(df, "cost_usd").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(_daily(spark, sf_dir, 20))


def usage_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(U.last_days(_daily(spark, sf_dir, 30), 10))


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.by_model(_ledger(spark, sf_dir)), "cost_usd")


def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.report(_ledger(spark, sf_dir), views.usage_as_of()), "cost_usd", "recent_cost_usd")


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.corpus_profile(views.files(spark, sf_dir), "corpus"), "value")


QUERIES = {f.__name__: f for f in (
    usage_cost, usage_totals, usage_daily, usage_last10, usage_by_model, usage_report, corpus_profile)}

_PRICES = ", ".join(f"('{p}', '{m}', {i}::DOUBLE, {o}::DOUBLE)" for (p, m), (i, o) in V.PRICES.items())
LEDGER_SQL = f"""
prices(provider, model, input, output) AS (VALUES {_PRICES}), ledger AS (
  SELECT u.*, prompt_tokens / 1000 * coalesce(p.input, d.input)
              + completion_tokens / 1000 * coalesce(p.output, d.output) AS cost_usd
  FROM usage_raw u LEFT JOIN prices p ON p.provider = u.provider AND p.model = u.model
  LEFT JOIN prices d ON d.provider = u.provider AND d.model IN ('gpt-3.5-turbo', 'claude-3-haiku')
)"""
_AS_OF = f"TIMESTAMP '{views.USAGE_AS_OF}'"
_AGGS = f"""
  round(sum(cost_usd), 8) AS cost_usd, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
  count(*) AS calls,
  round(coalesce(sum(cost_usd) FILTER ("timestamp" > {_AS_OF} - INTERVAL 7 DAY), 0), 8) AS recent_cost_usd,
  count(*) FILTER ("timestamp" > {_AS_OF} - INTERVAL 7 DAY) AS recent_calls"""


def _daily_sql(days: int) -> str:
    return f"""
daily AS (
  SELECT strftime("timestamp", '%Y-%m-%d') AS day, round(sum(cost_usd), 8) AS cost_usd FROM ledger
  WHERE "timestamp" > {_AS_OF} - INTERVAL {days} DAY GROUP BY 1
)"""


PROFILE_SQL = """
dup_groups AS (SELECT size, count(*) AS n FROM files GROUP BY size, sha256(text) HAVING count(*) > 1),
profile_rows AS (
  SELECT 'files' AS metric, count(*)::DOUBLE AS value FROM files
  UNION ALL SELECT 'total_mb', sum(size) / 1048576.0 FROM files
  UNION ALL SELECT 'type_' || file_type, count(*)::DOUBLE FROM files GROUP BY file_type
  UNION ALL SELECT 'duplicate_groups', count(*)::DOUBLE FROM dup_groups
  UNION ALL SELECT 'duplicate_files', coalesce(sum(n - 1), 0)::DOUBLE FROM dup_groups
  UNION ALL SELECT 'wasted_mb', coalesce(sum(size * (n - 1)), 0) / 1048576.0 FROM dup_groups
)"""

SQL = {
    "usage_cost": sql(USAGE_SQL, LEDGER_SQL, """
        SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", provider, model,
               round(cost_usd, 8) AS cost_usd FROM ledger"""),
    "usage_totals": sql(USAGE_SQL, LEDGER_SQL, """
        SELECT round(sum(cost_usd), 8) AS cost_usd,
               CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM ledger"""),
    "usage_daily": sql(USAGE_SQL, LEDGER_SQL, _daily_sql(20), "SELECT * FROM daily"),
    "usage_last10": sql(USAGE_SQL, LEDGER_SQL, _daily_sql(30), "SELECT * FROM daily ORDER BY day DESC LIMIT 10"),
    "usage_by_model": sql(USAGE_SQL, LEDGER_SQL, """
        SELECT provider, model, round(sum(cost_usd), 8) AS cost_usd,
               CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, count(*) AS calls
        FROM ledger GROUP BY provider, model"""),
    "usage_report": sql(USAGE_SQL, LEDGER_SQL, f"""
        SELECT 'total' AS section, NULL AS provider, NULL AS model, {_AGGS} FROM ledger
        UNION ALL SELECT 'model', provider, model, {_AGGS} FROM ledger GROUP BY provider, model"""),
    "corpus_profile": sql(FILES_SQL, PROFILE_SQL, """
        SELECT 'corpus' AS label, metric, round(value, 8) AS value FROM profile_rows"""),
}
