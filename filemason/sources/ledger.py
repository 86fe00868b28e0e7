"""The usage ledger: JSON exports, and an appended table by day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import USAGE

_EXPORT = (
    "usage_records array<struct<timestamp double, provider string, model string, prompt_tokens bigint, "
    "completion_tokens bigint, cost_usd double, operation string>>, last_updated double"
)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON ledgers ``{"usage_records": […], "last_updated": …}``; unreadable ones count as empty."""
    try:
        loaded = spark.read.schema(_EXPORT).json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], USAGE)
    rows = loaded.select(F.explode("usage_records").alias("r")).select("r.*")
    rows = rows.withColumn("timestamp", F.timestamp_micros(F.floor(F.col("timestamp") * 1000000).cast("bigint")))
    return rows.withColumn("operation", F.coalesce("operation", F.lit("organization"))).select(*USAGE.fieldNames())


def append(ledger: DataFrame, path: str) -> None:
    """Append calls to the table; nothing already stored is rewritten."""
    ledger.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*USAGE.fields, T.StructField("day", T.DateType())])).parquet(path)


def read_recent(spark: SparkSession, path: str, first_day: str) -> DataFrame:
    """The ledger from a day on; older day folders are pruned."""
    return read(spark, path).where(F.col("day") >= F.lit(first_day).cast("date"))
