"""Corpus profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def type_mix(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("n_files"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"),
                     P.size_mb(F.coalesce(F.sum("size"), F.lit(0))).alias("total_size_mb"))


def corpus_profile(files: DataFrame, label: str, content: str = "text") -> DataFrame:
    """Files, MB, type mix and duplicate figures of one inventory as ``(label, metric, value)``."""
    from .duplicates import duplicate_stats

    def rows(df: DataFrame, pairs: list) -> DataFrame:
        parts = [F.struct(name.alias("metric"), value.cast("double").alias("value")) for name, value in pairs]
        return df.select(F.explode(F.array(*parts)).alias("m")).select("m.*")

    lit, col = F.lit, F.col
    size = rows(totals(files), [(lit("files"), col("n_files")), (lit("total_mb"), col("total_size_mb"))])
    mix = rows(type_mix(files), [(F.concat(lit("type_"), col("file_type")), col("n_files"))])
    dup = rows(duplicate_stats(files, content), [
        (lit("duplicate_groups"), col("duplicate_groups")), (lit("duplicate_files"), col("total_duplicates")),
        (lit("wasted_mb"), col("wasted_space_mb"))])
    return reduce(DataFrame.unionByName, [size, mix, dup]).select(lit(label).alias("label"), "metric", "value")


def compare_profiles(before: DataFrame, after: DataFrame, content: str = "text") -> DataFrame:
    return corpus_profile(before, "before", content).unionByName(corpus_profile(after, "after", content))
