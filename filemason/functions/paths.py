"""Column helpers for paths, sizes and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Last suffix, lower-cased; empty for dotfiles and names without one."""
    return F.regexp_extract(F.lower(name), r"(?s).(\.[^.]+)$", 1)


def stem(name: Column, ext: Column) -> Column:
    return F.left(name, F.length(name) - F.length(ext))


def parent_dir(path: Column) -> Column:
    cut = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def file_type(ext: Column) -> Column:
    chain = F
    for kind, extensions in V.EXTENSIONS_BY_TYPE.items():
        chain = chain.when(ext.isin(extensions), F.lit(kind))
    return chain.otherwise(F.lit("other"))


def size_mb(size: Column) -> Column:
    return size / F.lit(1048576.0)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def days_before(at: Column, days: float) -> Column:
    return F.timestamp_micros(F.unix_micros(at) - F.lit(round(days * 86400000000)).cast("bigint"))


def with_path_columns(df: DataFrame) -> DataFrame:
    """Add name, extension, parent_dir and file_type to rows that have a path."""
    return (
        df.withColumn("name", file_name(F.col("path")))
        .withColumn("extension", extension(F.col("name")))
        .withColumn("parent_dir", parent_dir(F.col("path")))
        .withColumn("file_type", file_type(F.col("extension")))
    )
