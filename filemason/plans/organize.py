"""Whole plans: one strategy's actions and the deletion of exact duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame

from ..operators import cluster_report, clustering, duplicates, enrich, features, vectors
from . import rules as R
from .actions import compose


def clustering_labels(files: DataFrame, as_of: Column, algorithm: str = "dbscan", eps: float = 0.5, min_samples: int = 2,
                      n_clusters: int | None = None, max_features: int = 1000,
                      feature_types: Sequence[str] = ("text", "metadata", "name_similarity")) -> DataFrame | None:
    """``(seq, label)`` by the chosen features, standardised; None when they give no feature at all."""
    matrix, names = vectors.feature_matrix(files, as_of, feature_types, max_features)
    if not names:
        return None
    scaled = vectors.as_arrays(vectors.standardize(matrix))
    return clustering.cluster(scaled, algorithm, eps, min_samples, n_clusters)


def clustering_strategy(files: DataFrame, as_of: Column, min_cluster_size: int = 2, **options) -> DataFrame:
    if files.limit(min_cluster_size).count() < min_cluster_size:
        return cluster_report.fallback_plan(files)
    labels = clustering_labels(files, as_of, **options)
    if labels is None:
        return cluster_report.fallback_plan(files)
    return cluster_report.cluster_plan(files.join(labels, "seq"), min_cluster_size)


def enrichment_strategy(files: DataFrame, make_model: Callable = enrich.offline_model, folder_model: Callable | None = None,
                        reason_chars: int | None = None, run: enrich.ModelRun | None = None, **options) -> DataFrame:
    """Moves into folders proposed from the files' summaries. A ``run`` brings results of earlier runs, a cost limit (reached
    before the first call, the run is refused) and a ledger of the calls."""
    if run is not None:
        run.start(files.sparkSession)
    summaries = enrich.summarize(files, make_model, run=run, **options)
    folders = enrich.propose_folders(summaries, folder_model, options.get("criteria"), run)
    return enrich.enrichment_plan(summaries, folders, reason_chars=reason_chars)


def rules_strategy(files: DataFrame, as_of: Column, rules: R.RuleSet | None = None, target: str = "organized") -> DataFrame:
    if rules is not None:
        return R.rules_plan(files, rules, target)
    return R.rules_plan(features.with_keywords(files), R.default_rules(as_of, "top_keywords"), target)


def organize(files: DataFrame, strategy: str, as_of: Column, find_duplicates: bool = True, **options) -> DataFrame:
    """The plan of a strategy ('rules', 'clustering' or 'ml', 'llm') plus deletions of exact duplicates."""
    if strategy == "rules":
        plan = rules_strategy(files, as_of, **options)
    elif strategy in ("clustering", "ml"):
        plan = clustering_strategy(files, as_of, **options)
    elif strategy == "llm":
        plan = enrichment_strategy(files, **options)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return compose(plan, duplicates.keep_newest(files)) if find_duplicates else plan
