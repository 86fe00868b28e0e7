"""What clusters contain, what they are called, and the plans they lead to. Input: files with ``label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..plans.actions import action_rows, compose, missing_dirs
from .near_duplicates import first_per_group

_BEFORE_FILES = -(1 << 40)


def cluster_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n_files"))


def cluster_totals(labels: DataFrame) -> DataFrame:
    """Clusters found and noise rows."""
    counts = cluster_counts(labels)
    return counts.agg(
        F.count_if(F.col("label") != -1).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label") == -1, F.col("n_files"))), F.lit(0)).alias("n_noise"))


def _dominant_type() -> Column:
    """Most frequent type of a group, ties by first occurrence: one struct per type inside one aggregation."""
    votes = [F.struct(F.count_if(F.col("file_type") == t).alias("n"),
                      (-F.min(F.when(F.col("file_type") == t, F.col("seq")))).alias("first"),
                      F.lit(t).alias("type")) for t in V.FILE_TYPES]
    return F.array_max(F.array(*votes))["type"]


def _common_prefix(a: Column, b: Column) -> Column:
    shortest = F.least(F.length(a), F.length(b))
    agreeing = F.filter(F.sequence(F.lit(0), shortest), lambda i: F.left(a, i) == F.left(b, i))
    return F.left(a, F.array_max(agreeing))


def top_name_words(files: DataFrame, k: int = 3) -> DataFrame:
    """(label, words): the ``k`` most frequent name words of each cluster that occur at least twice."""
    words = files.select("label", "seq", F.posexplode(X.name_words(F.col("name"))).alias("pos", "word"))
    counted = words.groupBy("label", "word").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    best = first_per_group(counted, "label", k, F.desc("n"), "first").where("n > 1")
    ranked = best.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("words"))
    return ranked.select("label", F.transform("words", lambda w: w["word"]).alias("words"))


def cluster_profiles(files: DataFrame, min_cluster_size: int = 2) -> DataFrame:
    """One row per cluster that is large enough: size, name, dominant type, patterns and date range."""
    lower = F.lower("name")
    grouped = (
        files.where("label <> -1").groupBy("label").agg(
            F.count("*").alias("size"), _dominant_type().alias("dominant_type"), F.avg("size").alias("avg_size"),
            F.stddev_pop("size").alias("spread"), F.min("extension").alias("ext_low"), F.max("extension").alias("ext_high"),
            F.min("modified_at").alias("min_date"), F.max("modified_at").alias("max_date"),
            F.min(lower).alias("name_low"), F.max(lower).alias("name_high"),
            F.bool_or(X.matches_any(lower, [r"\d{4}"])).alias("dated"))
        .where(F.col("size") >= min_cluster_size)
    )
    span = (F.unix_micros("max_date") - F.unix_micros("min_date")) / F.lit(86400e6)
    several = F.col("size") > 1
    patterns = F.array_compact(F.array(
        F.when(F.col("ext_low") == F.col("ext_high"), F.concat(F.lit("all_"), F.col("ext_low"), F.lit("_files"))),
        F.when(several & (F.col("avg_size") > 0) & (F.col("spread") / F.col("avg_size") < 0.5), F.lit("similar_size")),
        F.when(several & (span < 7), F.lit("created_recently"))))

    rows = grouped.join(top_name_words(files.where("label <> -1")), "label", "left")
    kind = X.title_case(F.col("dominant_type"))
    telling = F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: ~w.isin(V.CLUSTER_NAME_STOP_WORDS))
    by_words = F.when(F.size(telling) > 0, X.title_case(F.array_join(F.slice(telling, 1, 2), "_")))
    by_date = F.when(F.col("dated"), F.lit("Dated"))
    prefix = _common_prefix(F.col("name_low"), F.col("name_high"))
    clean = F.regexp_replace(prefix, "[^a-zA-Z0-9]", "")
    by_prefix = F.when(several & (F.length(prefix) > 3) & (clean != ""), X.title_case(clean))
    name = F.concat(F.coalesce(by_words, by_date, by_prefix, F.lit("Cluster")), F.lit("_"), kind)
    return rows.select("label", "size", name.alias("name"), "dominant_type", patterns.alias("common_patterns"),
                       "avg_size", "min_date", "max_date", span.alias("span_days"))


def cluster_plan(files: DataFrame, min_cluster_size: int = 2, root: str = "Clustered") -> DataFrame:
    """A folder per cluster and one move per file; noise and small groups have folders of their own."""
    profiles = cluster_profiles(files, min_cluster_size)
    known = profiles.select("label", F.col("size").alias("cluster_size"), F.col("name").alias("cluster_name"), "dominant_type")
    placed = files.join(known, "label", "left")
    noise, analysed = F.col("label") == -1, F.col("cluster_name").isNotNull()
    folder = F.when(noise, "Uncategorized").when(analysed, F.col("cluster_name")).otherwise("Small_Groups")
    reason = (
        F.when(noise, F.lit("ML clustering: outlier file"))
        .when(analysed, F.concat(F.lit("ML clustering: grouped with "), F.col("cluster_size").cast("string"), F.lit(" similar files")))
        .otherwise(F.lit("ML clustering: small group"))
    )
    moves = action_rows(
        placed, "move", source=F.col("path"), destination=F.concat(F.lit(root + "/"), folder, F.lit("/"), F.col("name")),
        reason=reason, confidence=F.when(noise, 0.3).when(analysed, 0.8).otherwise(0.5))
    about = F.concat(F.lit("ML cluster: "), F.col("cluster_size").cast("string"), F.lit(" files, type: "), F.col("dominant_type"))
    dirs = known.groupBy(F.concat(F.lit(root + "/"), F.col("cluster_name")).alias("destination")).agg(
        F.min(F.struct("label", about.alias("reason"))).alias("first"))
    dirs = action_rows(dirs, "create_dir", seq=F.col("first.label") + _BEFORE_FILES, source=F.lit(""),
                       destination=F.col("destination"), reason=F.col("first.reason"))
    return compose(dirs, missing_dirs(moves, dirs, "ML clustering directory"), moves)


def fallback_plan(files: DataFrame, root: str = "ByType") -> DataFrame:
    """Folders by file type, for corpora too small to cluster or without features."""
    kind = F.col("file_type")
    moves = action_rows(
        files, "move", source=F.col("path"),
        destination=F.concat(F.lit(root + "/"), X.title_case(kind), F.lit("/"), F.col("name")),
        reason=F.concat(F.lit("Fallback: "), kind, F.lit(" file")), confidence=0.6)
    return compose(missing_dirs(moves, reason="Fallback: organize by file type"), moves)


def cluster_samples(files: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` files of each cluster and how many more it has."""
    counts = cluster_counts(files).where("label <> -1")
    shown = first_per_group(files.where("label <> -1").select("label", "seq", "name", "file_type"), "label", k, "seq")
    return shown.join(counts, "label").select(
        "label", "rank", "name", "file_type", F.greatest(F.col("n_files") - k, F.lit(0)).alias("more_files"))


def largest_cluster(files: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` files of the largest cluster (of equal ones, the first to appear)."""
    sizes = files.where("label <> -1").groupBy("label").agg(F.count("*").alias("n_files"), F.min("seq").alias("first"))
    best = sizes.orderBy(F.desc("n_files"), "first").limit(1).select("label", "n_files")
    return files.join(best, "label").orderBy("seq").limit(k).select("label", "n_files", "seq", "name", "file_type")
