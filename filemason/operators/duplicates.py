"""Exact duplicates by size and content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.actions import action_rows
from ..session import materialize
from .features import digest

KEY = ["size", "content_hash"]
NARROW = ["seq", "path", "name", "size", "modified_at", "content_hash"]


def fingerprints(files: DataFrame, content: str | Column = "text", algorithm: str = "sha256") -> DataFrame:
    """The narrow columns that duplicate detection needs. Unreadable content is left out, except that
    all empty files count as equal without being read. Where files carry a ``content_hash`` of their bytes, that
    decides, and no text is looked at."""
    body = F.col(content) if isinstance(content, str) else content
    known = F.col("content_hash") if "content_hash" in files.columns else digest(body, algorithm)
    key = F.when(F.col("size") == 0, F.lit("")).otherwise(known)
    return files.withColumn("content_hash", key).select(*NARROW).where(F.col("content_hash").isNotNull())


def same_size_only(files: DataFrame) -> DataFrame:
    """Files that share their size with another one. Worth its join when content still has to be fetched
    from storage, since files of unique size are then never opened."""
    repeated = files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    return files.join(repeated, "size", "left_semi")


def duplicate_groups(prints: DataFrame) -> DataFrame:
    """One row per group of equal files: members, first path, and the newest file (the earliest of equals).

    Plain aggregates with map-side combine: a group that holds a third of all rows costs one partial
    row per task.
    """
    newest = F.struct(F.col("modified_at"), (-F.col("seq")).alias("order"), F.col("name"), F.col("path"))
    return (
        prints.groupBy(*KEY)
        .agg(F.count("*").alias("n"), F.min("path").alias("group_id"), F.max(newest).alias("keep"))
        .where("n > 1")
    )


def exact_duplicates(files: DataFrame, content: str | Column = "text") -> DataFrame:
    """Members of duplicate groups as a long table ``(group_id, n, keep, …)``.

    The narrow fingerprints are written once, so the content is hashed once. The groups are written before they are
    joined, so that both sides of the join are shuffled for it alone: a hot group then only makes the member side
    skewed, which AQE splits.
    """
    prints = materialize(fingerprints(files, content), "fingerprints")
    return prints.join(materialize(duplicate_groups(prints), "groups"), KEY)


def duplicate_stats(files: DataFrame, content: str | Column = "text") -> DataFrame:
    """Groups, files, duplicates, MB in groups, wasted MB and the share that could be saved."""
    groups = duplicate_groups(fingerprints(files, content))
    size, wasted = F.sum(F.col("size") * F.col("n")), F.sum(F.col("size") * (F.col("n") - 1))
    zero = F.lit(0)
    return groups.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum("n"), zero).alias("total_files_in_groups"),
        (F.coalesce(F.sum("n"), zero) - F.count("*")).alias("total_duplicates"),
        P.size_mb(F.coalesce(size, zero)).alias("total_size_mb"),
        P.size_mb(F.coalesce(wasted, zero)).alias("wasted_space_mb"),
        F.when(size > 0, wasted / size * 100).otherwise(F.lit(0.0)).alias("space_savings_percent"),
    )


def keep_newest(files: DataFrame, content: str | Column = "text") -> DataFrame:
    """Delete actions for all but the newest file of each group."""
    members = exact_duplicates(files, content).where(F.col("path") != F.col("keep.path"))
    when = F.date_format("keep.modified_at", "yyyy-MM-dd HH:mm")
    reason = F.concat(F.lit("Duplicate of "), F.col("keep.name"), F.lit(" (keeping newer version from "), when, F.lit(")"))
    return action_rows(members, "delete", source=F.col("path"), reason=reason, confidence=0.95)
