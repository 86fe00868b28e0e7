"""Dry-run logs and plans applied to an inventory table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import materialize
from . import chains
from .actions import action_text, ordered
from .conflicts import resolve

PLACED = ["copy", "move", "rename"]


def drop_moves_of_deleted(actions: DataFrame) -> DataFrame:
    """The plan without the moves of files that it also deletes, so that the deletions take effect."""
    doomed = actions.where(F.col("action_type") == "delete").select("source").distinct()
    moves = actions.where(F.col("action_type") == "move")
    return actions.where(F.col("action_type") != "move").unionByName(moves.join(doomed, "source", "left_anti"))


def numbered_actions(actions: DataFrame) -> DataFrame:
    """Actions with ``order``, a unique number that follows the execution order."""
    fields = [c for c in actions.columns if c != "metadata"]
    placed = ordered(actions.select(*fields)).select(F.monotonically_increasing_id().alias("order"), *fields)
    return materialize(placed, "actions")


def _failed(reason: str) -> Column:
    return F.concat(F.lit("ERROR: Failed to execute "), action_text(), F.lit(f": {reason}: "), F.col("source"))


def dry_run_log(actions: DataFrame, files: DataFrame) -> DataFrame:
    """One message per action in execution order; nothing is changed."""
    known = files.select(F.col("path").alias("source")).distinct().withColumn("found", F.lit(True))
    name, target, kind = P.file_name(F.col("source")), F.col("destination"), F.col("action_type")
    gone = F.col("found").isNull() & kind.isin(PLACED)
    message = (
        F.when(gone, _failed("Source file does not exist"))
        .when(kind == "create_dir", F.concat(F.lit("[DRY RUN] Would create directory: "), target))
        .when(kind == "move", F.concat(F.lit("[DRY RUN] Would move: "), name, F.lit(" → "), target))
        .when(kind == "copy", F.concat(F.lit("[DRY RUN] Would copy: "), name, F.lit(" → "), target))
        .when(kind == "rename", F.concat(F.lit("[DRY RUN] Would rename: "), name, F.lit(" → "), P.file_name(target)))
        .when(F.col("found"), F.concat(F.lit("[DRY RUN] Would delete: "), name, F.lit(" ("), F.col("reason"), F.lit(")")))
    )
    status = F.when(gone, "failed").otherwise("executed")
    return ordered(actions.join(known, "source", "left")).select(
        "seq", "action_type", "source", status.alias("status"), message.alias("message"))


@dataclass
class Applied:
    """The inventory after a plan, and what happened to each action."""

    files: DataFrame
    log: DataFrame


def apply_plan(files: DataFrame, actions: DataFrame, backup: bool = False, backup_dir: str = ".backups") -> Applied:
    """Apply a plan to an inventory as one table transformation, with the outcome of its actions running one after another.

    Copies, moves and renames need their source: it must be in the inventory, or where an earlier action put it, and not
    have been moved or renamed since. A name that an action frees can be taken by later ones. Destinations that are planned
    directories receive the file's name. Deleting what is no longer there counts as executed. With ``backup`` a deleted file
    leaves a copy. Actions that share no name with others are resolved by ranks, the others folded by ``chains``.
    """
    todo = numbered_actions(actions)
    here = files.select(F.col("path").alias("source")).distinct().withColumn("known", F.lit(True))
    relocations = todo.where(F.col("action_type").isin("move", "rename"))
    first = relocations.groupBy("source").agg(F.min("order").alias("first_order"))
    folders = todo.where("action_type = 'create_dir'").select("destination").distinct().withColumn("is_dir", F.lit(True))
    state = (
        todo.join(here, "source", "left").join(first, "source", "left").join(folders, "destination", "left")
    )
    kind = F.col("action_type")
    placed_ok = F.col("known") & (F.col("first_order").isNull() | (F.col("first_order") >= F.col("order")))
    relocated = F.col("known") & F.col("first_order").isNotNull()
    target = F.when(F.col("is_dir"), F.concat("destination", F.lit("/"), P.file_name(F.col("source")))).otherwise(F.col("destination"))
    ok = (
        F.when(kind.isin(PLACED), F.coalesce(placed_ok, F.lit(False)))
        .when(kind == "delete", F.coalesce(F.col("known") & ~F.coalesce(relocated, F.lit(False)), F.lit(False)))
        .otherwise(True)
    )
    state = materialize(
        state.select("order", "seq", "action_type", "source", "reason", ok.alias("ok"),
                     F.when(kind.isin(PLACED), target).otherwise(F.col("destination")).alias("target")), "state")

    plain = state
    tangled = chains.tangled_names(state)
    if tangled is not None:
        chained = materialize(chains.run_chained(state, files, *tangled), "chained")
        plain = state.join(chained, "order", "left_anti")
    wishes = plain.where(kind.isin(PLACED) & F.col("ok"))
    final = resolve(wishes.select("order", F.col("target").alias("destination")), files.select("path")).select("order", "final")
    missing = F.when(kind == "delete", "nothing to delete").otherwise("failed")
    outcome = plain.select("order", F.when(F.col("ok"), "executed").otherwise(missing).alias("status"),
                           F.when(F.col("ok"), F.col("source")).alias("origin"), F.lit(-1).cast("bigint").alias("made"))
    outcome = outcome.join(final, "order", "left").select("order", "status", "final", "origin", "made")
    if tangled is not None:
        outcome = outcome.unionByName(chained)
    done = materialize(state.drop("ok").join(outcome, "order"), "done")

    executed = done.where("status = 'executed'")
    consuming = executed.where(kind.isin("move", "rename", "delete"))
    columns = files.columns

    def at_new_path(rows: DataFrame) -> DataFrame:
        return rows.withColumn("path", F.col("final")).transform(P.with_path_columns).select(*columns)

    leaving = consuming.where("made = -1").select(F.col("origin").alias("path")).distinct()
    kept = files.join(leaving, "path", "left_anti").select(*columns)
    moved_on = consuming.where("made >= 0").select(F.col("made").alias("order"))
    arrived = executed.where(kind.isin(PLACED)).join(moved_on, "order", "left_anti").select(F.col("origin").alias("path"), "final")
    after = kept.unionByName(at_new_path(files.join(arrived, "path")))
    if backup:
        deleted = executed.where("action_type = 'delete'").select(F.col("origin").alias("path"), F.col("source").alias("at")).distinct()
        saved = files.join(deleted, "path").withColumn(
            "final", F.concat(P.parent_dir(F.col("at")), F.lit(f"/{backup_dir}/"), P.file_name(F.col("at")), F.lit(".backup"))).drop("at")
        after = after.join(saved.select(F.col("final").alias("path")), "path", "left_anti").unionByName(at_new_path(saved))

    name, target = P.file_name(F.col("source")), F.coalesce("final", "destination")
    message = (
        F.when(F.col("status") == "failed", _failed("Source file does not exist"))
        .when(kind == "create_dir", F.concat(F.lit("Created directory: "), target))
        .when(kind == "move", F.concat(F.lit("Moved: "), name, F.lit(" → "), target))
        .when(kind == "copy", F.concat(F.lit("Copied: "), name, F.lit(" → "), target))
        .when(kind == "rename", F.concat(F.lit("Renamed: "), name, F.lit(" → "), P.file_name(target)))
        .when(F.col("status") == "executed", F.concat(F.lit("Deleted: "), name, F.lit(" ("), F.col("reason"), F.lit(")")))
    )
    log = done.withColumnRenamed("target", "destination").select(
        "order", "seq", "action_type", "source",
        F.when(F.col("status") == "failed", "failed").otherwise("executed").alias("status"), message.alias("message"))
    return Applied(after, log)


def execution_summary(log: DataFrame) -> DataFrame:
    """Executed, failed and the success rate in percent (100 for an empty plan)."""
    failed = F.count_if(F.col("status") == "failed")
    total = F.count("*")
    return log.agg(
        (total - failed).alias("executed"), failed.alias("failed"),
        F.when(total == 0, F.lit(100.0)).otherwise((total - failed) / total * 100).alias("success_rate"))
