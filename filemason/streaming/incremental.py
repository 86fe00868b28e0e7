"""The same operators over streams of new files and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import usage
from ..plans import rules as R


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def classify_stream(files: DataFrame, rules: R.RuleSet) -> DataFrame:
    """Rules on a stream: a projection without state."""
    return R.classify(files, rules)


def daily_costs_stream(calls: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Costs per day over a stream of calls; a day is final once the watermark has passed its end."""
    priced = usage.with_cost(calls.withWatermark("timestamp", lateness))
    days = priced.groupBy(F.window("timestamp", "1 day").alias("w")).agg(
        F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
    return days.select(F.to_date("w.start").alias("day"), "cost_usd", "calls")
