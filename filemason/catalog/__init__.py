"""Every registered query and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering_queries, duplicate_queries, enrich_queries, inventory_queries, plan_queries, usage_queries

_MODULES = (inventory_queries, duplicate_queries, usage_queries, plan_queries, clustering_queries, enrich_queries)


#: Queries whose counts and lengths are 32-bit numbers in Spark and 64-bit ones in SQL.
_WIDENED = ("name_features", "text_features", "web_text_features", "feature_struct", "cluster_samples", "prompts", "category_files",
            "fallback_folders")


def _widened(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({name: df[name].cast("long") for name, kind in df.dtypes if kind == "int"})
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
    return {name: _widened(query) if name in _WIDENED else query for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
