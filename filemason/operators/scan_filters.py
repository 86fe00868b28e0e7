"""Predicates on an inventory and size-gated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import paths as P


def visible(files: DataFrame, root: str = "", include_hidden: bool = False, max_depth: int | None = None,
            size_limit_mb: float | None = None) -> DataFrame:
    """The scan's own predicates on an inventory table: hidden names, depth below ``root``, size."""
    relative = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 2**30)
    if not include_hidden:
        files = files.where(~relative.rlike(r"(^|/)\."))
    if max_depth is not None:
        files = files.where(F.length(relative) - F.length(F.replace(relative, F.lit("/"), F.lit(""))) <= max_depth)
    if size_limit_mb:
        files = files.where(F.col("size") <= size_limit_mb * 1048576)
    return files


def filtered(files: DataFrame, as_of: Column, extensions: Sequence[str] = (), exclude_extensions: Sequence[str] = (),
             min_age_days: float | None = None, max_age_days: float | None = None) -> DataFrame:
    """Keep by extension and age; both age bounds are inclusive and 0 or None switches one off. The bounds are
    constants compared with plain columns, so a stored inventory is filtered in its scan."""
    if extensions:
        files = files.where(F.col("extension").isin([e.lower() for e in extensions]))
    if exclude_extensions:
        files = files.where(~F.col("extension").isin([e.lower() for e in exclude_extensions]))
    if min_age_days:
        files = files.where(F.col("modified_at") <= P.days_before(as_of, min_age_days))
    if max_age_days:
        files = files.where(F.col("modified_at") >= P.days_before(as_of, max_age_days))
    return files


def text_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_type").isin(V.TEXT_TYPES))


def images_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_type") == "image")


def gated_text(content: str = "text", max_file_size_kb: int | None = None) -> Column:
    """The text of document and code files, with a bound only of those up to that size; else an empty string."""
    allowed = F.col("file_type").isin(V.TEXT_TYPES) & F.col(content).isNotNull()
    if max_file_size_kb is not None:
        allowed &= F.col("size") <= max_file_size_kb * 1024
    return F.when(allowed, F.col(content)).otherwise(F.lit(""))
