"""A keyed store of model results with an optional time to live, kept as versions of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CACHE

PREFIX = "llm_analysis:"


def cache_key(salt: Column | str | None = None) -> Column:
    """Key of a file's result by path, modification time and size, and by prompt or model if salted."""
    parts = [F.col("path"), F.unix_micros("modified_at").cast("string"), F.col("size").cast("string")]
    if salt is not None:
        parts.append(F.lit(salt) if isinstance(salt, str) else salt)
    return F.concat(F.lit(PREFIX), F.md5(F.concat_ws(":", *parts)))


def entries(rows: DataFrame, key: Column, value: Column, at: Column, ttl_seconds: int | None = None) -> DataFrame:
    """Cache rows; without a time to live they never expire."""
    expires = F.timestamp_micros(F.unix_micros(at) + ttl_seconds * 1000000) if ttl_seconds else F.lit(None).cast("timestamp")
    return rows.select(key.alias("key"), value.alias("value"), at.alias("timestamp"), expires.alias("expires_at"))


def valid(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key, the new one replacing the old; an aggregate, so repeated keys combine early."""
    both = cache.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    fields = [f.name for f in CACHE.fields if f.name != "key"]
    last = F.max(F.struct("version", "timestamp", "value", "expires_at")).alias("last")
    return both.groupBy("key").agg(last).select("key", *[F.col(f"last.{f}").alias(f) for f in fields])


def split(files: DataFrame, cache: DataFrame, as_of: Column, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with a valid result, as (hits with ``value``, misses)."""
    keyed = files.withColumn("key", cache_key() if key is None else key)
    live = valid(cache, as_of).select("key", "value")
    return keyed.join(live, "key"), keyed.join(live, "key", "left_anti")


def statistics(cache: DataFrame, as_of: Column) -> DataFrame:
    expired = F.count_if(F.coalesce(F.col("expires_at") < as_of, F.lit(False)))
    return cache.agg(F.count("*").alias("total_entries"), expired.alias("expired_entries"),
                     (F.count("*") - expired).alias("valid_entries"))


def write_version(cache: DataFrame, root: str, version: int) -> str:
    """Write a whole new version beside the old ones, so readers of the old one are not disturbed."""
    path = f"{root}/version={version:08d}"
    cache.select(*CACHE.fieldNames()).write.parquet(path)
    return path
