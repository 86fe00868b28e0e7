"""Running sums and ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 20


def running_sum(rows: DataFrame, group: Sequence[str], position: str, value: Column, out: str,
                chunk: int = CHUNK) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to each row, by the integer column ``position``.

    Positions are cut into ranges, summed per range first, and finished inside each range, so the
    window of a task covers one range of a group and never the whole group.
    """
    cut = rows.withColumn("_chunk", F.floor(F.col(position) / chunk)).withColumn("_value", value)
    keys = [*group, "_chunk"]
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys).agg(F.sum("_value").alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn(out, F.sum("_value").over(inside)).join(offsets, keys)
        .withColumn(out, F.col(out) + F.col("_offset")).drop("_chunk", "_value", "_offset")
    )


def rank_in_group(rows: DataFrame, group: Sequence[str], position: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """1-based rank of each row of a group by a unique integer column."""
    return running_sum(rows, group, position, F.lit(1), out, chunk)
