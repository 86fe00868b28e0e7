"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize, small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality of several columns, null equal to null."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def rank_in_group(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Add the 1-based rank of each row inside its group, also for groups that hold most of the rows.

    Rows are dealt out by ranges of (group, order) and written, so that a large group spans many
    partitions; a window covers one group inside one partition, and the counts of earlier partitions are
    added. Among rows with equal order columns any order may result.
    """
    spark = rows.sparkSession
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.withColumn("_tie", F.rand(7)).repartitionByRange(partitions(spark), *group, *sort, "_tie")
    keyed = materialize(keyed.withColumn("_part", F.spark_partition_id()), "ranked")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy(*group, "_part").agg(F.count("*").alias("_n")).select(
        *group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*sort, "_tie")
    local = keyed.withColumn("_local", F.row_number().over(inside))
    joined = local.join(before, same(local, before, [*group, "_part"]))
    return joined.select(*(local[c] for c in rows.columns), (F.col("_local") + F.col("_before")).cast("long").alias(out))


def kept(name: str, make: Callable):
    """What ``make`` returns, made once in a Python worker and kept for the worker's later tasks.

    Functions travel with their code, so their modules' variables start anew in each task; the place for
    what shall outlast a task (tables of a vocabulary, words already seen) is a module made for it.
    """
    import sys
    import types

    place = sys.modules.setdefault("_filemason_kept", types.ModuleType("_filemason_kept")).__dict__
    if name not in place:
        place[name] = make()
    return place[name]


def per_text(docs: DataFrame, id_column: str, text: str, start: Callable[[], Callable], columns: str) -> DataFrame:
    """``(id, columns…)`` for every row, by a function over lists of whole texts (null: empty).

    ``start`` is called once per task and returns the function, which gives one list or array per
    column. No shuffle; columns other than the id and the text are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(columns).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            found = work(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c if isinstance(c, pa.Array) else pa.array(c) for c in found)], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
