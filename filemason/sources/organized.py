"""The organised corpus as files: rows laid out under their target folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def write_organized(rows: DataFrame, path: str, rows_per_file: int = 100_000, file_format: str = "parquet") -> None:
    """Write rows that have a ``target_path`` partitioned by its folder.

    Folders are counted first: one with up to ``rows_per_file`` rows is one file, a larger one as many tasks' files as its rows
    need, so a folder that holds much of the corpus is not written by one of them.
    """
    placed = rows.withColumn("target_dir", P.parent_dir(F.col("target_path")))
    writers = placed.groupBy("target_dir").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_writers"))
    dealt = placed.join(writers.hint("merge"), "target_dir")
    dealt = dealt.withColumn("_writer", F.pmod(F.xxhash64("target_path"), F.col("_writers")))
    columns = [*rows.columns, "target_dir"]
    dealt.repartition("target_dir", "_writer").select(*columns).write.partitionBy("target_dir").format(file_format).save(path)
