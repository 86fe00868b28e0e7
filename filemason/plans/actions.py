"""Plans: tables of typed actions, their order, text and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import paths as P
from ..schemas import ACTIONS


def action_rows(rows: DataFrame, action_type: str, source: Column, destination: Column | None = None,
                reason: Column | None = None, confidence: Column | float = 1.0,
                metadata: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Project rows onto the plan schema."""
    values = {
        "seq": F.col("seq") if seq is None else seq,
        "action_type": F.lit(action_type),
        "source": source,
        "destination": F.lit(None) if destination is None else destination,
        "reason": F.lit("") if reason is None else reason,
        "confidence": F.lit(confidence) if isinstance(confidence, float) else confidence,
        "metadata": F.lit(None) if metadata is None else metadata,
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in ACTIONS.fields])


def create_dirs(spark: SparkSession, directories: Sequence[str], reason: str = "") -> DataFrame:
    """One create_dir row per listed directory, numbered before every file."""
    n = len(directories)
    rows = [(i - n, "create_dir", "", d, reason, 1.0, None) for i, d in enumerate(directories)]
    return spark.createDataFrame(rows, ACTIONS)


def missing_dirs(moves: DataFrame, known: DataFrame | None = None, reason: str = "") -> DataFrame:
    """create_dir rows for the folders that ``moves`` use, each once and only if not already planned."""
    used = moves.where(F.col("action_type") == "move").select(
        P.parent_dir(F.col("destination")).alias("destination"), "seq")
    used = used.groupBy("destination").agg(F.min("seq").alias("seq"))
    if known is not None:
        planned = known.where(F.col("action_type") == "create_dir").select("destination").distinct()
        used = used.join(planned, "destination", "left_anti")
    return action_rows(used, "create_dir", source=F.lit(""), destination=F.col("destination"), reason=F.lit(reason))


def compose(*plans: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, plans)


def of_type(actions: DataFrame, action_type: str) -> DataFrame:
    return actions.where(F.col("action_type") == action_type)


def phase() -> Column:
    """Rank of an action's kind: directories first, deletions last."""
    chain = F
    for rank, kind in enumerate(V.ACTION_ORDER):
        chain = chain.when(F.col("action_type") == kind, F.lit(rank))
    return chain.otherwise(F.lit(len(V.ACTION_ORDER)))


def ordered(actions: DataFrame) -> DataFrame:
    return actions.orderBy(phase(), "seq")


def action_text() -> Column:
    """How an action reads in a listing."""
    kind, name = F.col("action_type"), P.file_name(F.col("source"))
    return (
        F.when(kind == "move", F.concat(F.lit("MOVE: "), name, F.lit(" → "), F.col("destination")))
        .when(kind == "delete", F.concat(F.lit("DELETE: "), name, F.lit(" ("), F.col("reason"), F.lit(")")))
        .when(kind == "create_dir", F.concat(F.lit("CREATE: "), F.col("destination"), F.lit("/")))
        .otherwise(F.concat(F.upper(kind), F.lit(": "), F.col("source")))
    )


def _count_of(kind: str) -> Column:
    return F.count_if(F.col("action_type") == kind)


def plan_summary(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return actions.groupBy(*by).agg(
        F.count("*").alias("total_actions"),
        _count_of("move").alias("files_to_move"),
        _count_of("delete").alias("files_to_delete"),
        _count_of("create_dir").alias("directories_to_create"),
    )


def plan_sample(actions: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` actions in plan order, each with the number of actions not shown."""
    total = actions.agg(F.count("*")).scalar()
    shown = actions.orderBy("seq", phase()).limit(n).select("seq", action_text().alias("action"), "confidence")
    return shown.withColumn("more_actions", F.greatest(total - n, F.lit(0)))


def compare_strategies(plans: dict[str, DataFrame]) -> DataFrame:
    """Action counts of several plans side by side."""
    tagged = [plan.select(F.lit(name).alias("strategy"), "action_type") for name, plan in plans.items()]
    return plan_summary(compose(*tagged), by=["strategy"])
