"""Feature extraction: one struct per extractor, absent where the extractor does not apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import paths as P
from ..functions import text as X


def metadata_features(as_of: Column) -> Column:
    """Fourteen features of name, size and age."""
    name, lower = F.col("name"), F.lower(F.col("name"))
    return F.struct(
        F.col("extension"),
        P.size_mb(F.col("size")).alias("size_mb"),
        P.days_between(as_of, F.col("modified_at")).alias("age_days"),
        F.length(name).alias("filename_length"),
        name.contains(" ").alias("has_spaces"),
        X.has_digit(name).alias("has_numbers"),
        X.is_upper(name).alias("is_uppercase"),
        X.is_lower(name).alias("is_lowercase"),
        F.size(X.words(name)).alias("word_count"),
        X.contains_any(lower, V.DOWNLOAD_HINTS).alias("likely_download"),
        X.contains_any(lower, V.SCREENSHOT_HINTS).alias("likely_screenshot"),
        X.contains_any(lower, V.BACKUP_HINTS).alias("likely_backup"),
        X.matches_any(name, V.DATE_PATTERNS).alias("has_date_pattern"),
        X.matches_any(name, V.VERSION_PATTERNS).alias("has_version_pattern"),
    )


def digest(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a content column; NULL content (unreadable) gives NULL."""
    if algorithm.startswith("sha") and algorithm[3:] in ("224", "256", "384", "512"):
        return F.sha2(content, int(algorithm[3:]))
    if algorithm in ("sha1", "md5"):
        return getattr(F, algorithm)(content)
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def hash_features(content: Column, algorithm: str = "sha256") -> Column:
    return F.struct(digest(content, algorithm).alias("content_hash"), F.lit(algorithm).alias("hash_algorithm"))


def text_features(content: Column, max_chars: int | None = None, preview_chars: int = 200, top_k: int | None = 10) -> Column:
    """Counts, flags, preview and keywords of a text.

    Without ``top_k`` no keywords are computed. The whole text is measured; pass ``max_chars=5000`` to measure only what a bounded reader sees.
    """
    body = X.unix_lines(content)
    if max_chars is not None:
        body = F.left(body, F.lit(max_chars))

    def measured(t: Column) -> Column:
        return X.let(X.words(t), lambda w: F.struct(
            F.lit(True).alias("has_content"),
            F.length(t).alias("char_count"),
            F.size(w).alias("word_count"),
            X.count_of(t, "\n").alias("line_count"),
            F.when(F.size(w) == 0, F.lit(0.0)).otherwise(
                F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)) / F.size(w)
            ).alias("avg_word_length"),
            F.size(F.array_distinct(w)).alias("unique_words"),
            F.lower(t).contains("http").alias("has_urls"),
            (t.contains("@") & t.contains(".")).alias("has_emails"),
            X.truncated(t, preview_chars, "...").alias("content_preview"),
            (F.lit(None).cast("array<string>") if top_k is None else X.top_keywords(w, top_k)).alias("top_keywords"),
        ))

    empty = F.struct(
        F.lit(False).alias("has_content"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("char_count", "int"), ("word_count", "int"), ("line_count", "int"), ("avg_word_length", "double"),
            ("unique_words", "int"), ("has_urls", "boolean"), ("has_emails", "boolean"),
            ("content_preview", "string"), ("top_keywords", "array<string>"),
        )],
    )
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, empty).otherwise(X.let(body, measured))


@dataclass(frozen=True)
class Extractor:
    """A named feature struct and the file types it applies to."""

    key: str
    types: Sequence[str]
    value: Column


def default_extractors(as_of: Column, content: str = "text", **text_options: int | None) -> list[Extractor]:
    return [
        Extractor("metadata", V.FILE_TYPES, metadata_features(as_of)),
        Extractor("contenthash", V.FILE_TYPES, hash_features(F.col(content))),
        Extractor("textcontent", V.TEXT_TYPES, text_features(F.col(content), **text_options)),
    ]


def extract_features(files: DataFrame, extractors: Sequence[Extractor]) -> DataFrame:
    """Add ``features``: one nested struct per extractor, NULL where the file type is not covered."""
    kind = F.col("file_type")
    parts = [
        (e.value if set(e.types) >= set(V.FILE_TYPES) else F.when(kind.isin(list(e.types)), e.value)).alias(e.key)
        for e in extractors
    ]
    return files.withColumn("features", F.struct(*parts))


def with_keywords(files: DataFrame, content: str = "text", top_k: int = 10) -> DataFrame:
    """Add ``top_keywords`` for document and code files only."""
    found = X.top_keywords(X.words(X.unix_lines(F.col(content))), top_k)
    return files.withColumn("top_keywords", F.when(F.col("file_type").isin(V.TEXT_TYPES), found))


def clustering_text(content: str | None = "text", keywords: str | None = None) -> Column:
    """Name, extension, type, text and keywords of a file as one string."""
    parts = [F.col("name"), F.col("extension"), F.col("file_type")]
    if content:
        parts.append(F.when(F.col("file_type").isin(V.TEXT_TYPES), F.col(content)))
    if keywords:
        parts.append(F.array_join(F.col(keywords), " "))
    return F.concat_ws(" ", *parts)
