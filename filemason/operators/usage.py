"""Model usage: prices, costs and reports over a ledger of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.paths import days_before


def price_table(spark: SparkSession) -> DataFrame:
    """The price dimension: one row per provider and model, the provider's default marked."""
    rows = [(p, m, i, o, V.DEFAULT_MODELS[p] == m) for (p, m), (i, o) in V.PRICES.items()]
    return spark.createDataFrame(rows, "provider string, model string, input double, output double, is_default boolean")


def with_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``cost_usd`` by provider and model; unknown models cost what the provider's default does.

    Both joins are on the price table, which Spark broadcasts by its size statistics.
    """
    prices = price_table(calls.sparkSession) if prices is None else prices
    exact = prices.select("provider", "model", "input", "output")
    default = prices.where("is_default").select(
        "provider", F.col("input").alias("default_input"), F.col("output").alias("default_output"))
    priced = calls.join(exact, ["provider", "model"], "left").join(default, "provider", "left")
    cost = (
        F.col("prompt_tokens") / 1000 * F.coalesce("input", "default_input")
        + F.col("completion_tokens") / 1000 * F.coalesce("output", "default_output")
    )
    return priced.withColumn("cost_usd", cost).drop("input", "output", "default_input", "default_output")


def recent(calls: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Calls strictly younger than ``days`` days."""
    return calls.where(F.col("timestamp") > days_before(as_of, days))


def _tokens() -> Column:
    return F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))


def totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(_tokens(), F.lit(0)).alias("tokens"), F.count("*").alias("calls"))


def daily_costs(ledger: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return recent(ledger, as_of, days).groupBy(F.to_date("timestamp").alias("day")).agg(
        F.sum("cost_usd").alias("cost_usd"))


def last_days(daily: DataFrame, n: int = 10) -> DataFrame:
    """The latest ``n`` days that have usage, in date order."""
    return daily.orderBy(F.desc("day")).limit(n).orderBy("day")


def by_model(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("provider", "model").agg(
        F.sum("cost_usd").alias("cost_usd"), _tokens().alias("tokens"), F.count("*").alias("calls"))


def report(ledger: DataFrame, as_of: Column) -> DataFrame:
    """Totals, last seven days and one line per model, in a single rollup over the ledger."""
    young = F.col("timestamp") > days_before(as_of, 7)
    lines = ledger.rollup("provider", "model").agg(
        F.grouping_id().alias("level"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(_tokens(), F.lit(0)).alias("tokens"), F.count("*").alias("calls"),
        F.coalesce(F.sum(F.when(young, F.col("cost_usd"))), F.lit(0.0)).alias("recent_cost_usd"),
        F.count_if(young).alias("recent_calls"))
    section = F.when(F.col("level") == 3, "total").otherwise("model")
    lines = lines.where("level in (0, 3)").select(section.alias("section"), *[c for c in lines.columns if c != "level"])
    # An empty ledger has no rollup rows; a zero line keeps the total.
    zero = ledger.sparkSession.createDataFrame([("total", None, None, 0.0, 0, 0, 0.0, 0)], lines.schema)
    keys = ["section", "provider", "model"]
    return lines.unionByName(zero).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in lines.columns if c not in keys])


def report_text(ledger: DataFrame, as_of: Column) -> DataFrame:
    """The report as lines of text; a single line when nothing was used."""
    money = lambda c: F.format_string("$%.4f", c)
    r = report(ledger, as_of)
    total = F.concat(
        F.lit("Total: "), money(F.col("cost_usd")), F.lit(", "), F.format_number("tokens", 0), F.lit(" tokens, "),
        F.col("calls").cast("string"), F.lit(" calls; last 7 days: "), money(F.col("recent_cost_usd")), F.lit(", "),
        F.col("recent_calls").cast("string"), F.lit(" calls"))
    model = F.concat(
        F.col("provider"), F.lit(" "), F.col("model"), F.lit(": "), money(F.col("cost_usd")), F.lit(" ("),
        F.format_number("tokens", 0), F.lit(" tokens, "), F.col("calls").cast("string"), F.lit(" calls)"))
    line = (
        F.when((F.col("section") == "total") & (F.col("calls") == 0), F.lit("No model usage recorded yet."))
        .when(F.col("section") == "total", total).otherwise(model)
    )
    return r.select((F.col("section") != "total").alias("detail"), "provider", "model", line.alias("line"))


def within_limit(ledger: DataFrame, limit_usd: float) -> bool:
    """False once the money spent has reached the limit."""
    return totals(ledger).first()["cost_usd"] < limit_usd
