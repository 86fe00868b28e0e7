"""Ordered rules: each gives a target folder or NULL, and the first answer wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import paths as P
from ..functions import text as X
from .actions import action_rows, create_dirs


def _lower() -> Column:
    return F.lower(F.col("name"))


def _is(kind: str) -> Column:
    return F.col("file_type") == kind


def _when(condition: Column, folder: str | Column) -> Column:
    return F.when(condition, F.lit(folder) if isinstance(folder, str) else folder)


def _first_folder(test: Callable[[list[str]], Column], folders: Sequence[tuple[list[str], str]]) -> Column:
    """The folder of the first entry whose words match; an entry without words always matches."""
    return F.coalesce(*[_when(test(words), folder) if words else F.lit(folder) for words, folder in folders])


def _name_has(words: list[str]) -> Column:
    return X.contains_any(_lower(), words)


def system_files() -> Column:
    return _when(_lower().isin(V.SYSTEM_NAMES) | F.col("name").startswith("."), "System_Files")


def temp_files() -> Column:
    return _when(_name_has(V.TEMP_WORDS) | F.col("extension").isin(V.TEMP_EXTENSIONS), "System_Files/Temp")


def duplicate_like() -> Column:
    stem = P.stem(_lower(), F.col("extension"))
    return _when(X.matches_any(stem, V.DUPLICATE_STEM_PATTERNS), "_Needs_Review/Potential_Duplicates")


def financial(keywords: str | None = None) -> Callable[[], Column]:
    """Documents with a financial word in the name, or as one of their top keywords if those are at hand."""
    def rule() -> Column:
        hit = _name_has(V.FINANCIAL_WORDS)
        if keywords:
            found = F.transform(F.col(keywords), F.lower)
            overlap = F.arrays_overlap(found, F.array(*[F.lit(w) for w in V.FINANCIAL_WORDS]))
            hit = hit | F.coalesce(overlap, F.lit(False))
        return _when(_is("document") & hit, "Documents/Financial")
    return rule


def named_documents(words: list[str], folder: str) -> Callable[[], Column]:
    return lambda: _when(_is("document") & _name_has(words), folder)


def screenshots() -> Column:
    hit = _name_has(V.SCREENSHOT_WORDS) | X.matches_any(_lower(), [V.SCREENSHOT_PATTERN])
    return _when(_is("image") & hit, "Images/Screenshots")


def camera_photos() -> Column:
    return _when(_is("image") & X.matches_any(_lower(), V.CAMERA_PATTERNS), "Images/Photos/Camera")


def social_images() -> Column:
    return _when(_is("image") & _name_has(V.SOCIAL_WORDS), "Images/Photos/Social_Media")


def by_words(kind: str, folders: Sequence[tuple[list[str], str]]) -> Callable[[], Column]:
    return lambda: _when(_is(kind), _first_folder(_name_has, folders))


def installers() -> Column:
    return _when(F.col("extension").isin(V.INSTALLER_EXTENSIONS) | _name_has(V.INSTALLER_WORDS), "Software/Installers")


def code_files() -> Column:
    return _when(_is("code"), _first_folder(lambda e: F.col("extension").isin(e), V.CODE_FOLDERS))


def by_type() -> Column:
    return F.coalesce(*[_when(_is(k), folder) for k, folder in V.TYPE_FOLDERS.items() if k != "other"],
                      F.lit(V.TYPE_FOLDERS["other"]))


def by_age(as_of: Column) -> Callable[[], Column]:
    """Archive folders for old files; answers only where it stands before the rule by type."""
    def rule() -> Column:
        age = P.days_between(as_of, F.col("modified_at"))
        old = F.concat(F.lit("Archive/Old_Files/"), F.year("modified_at").cast("string"))
        return F.when(age > V.OLD_AGE_DAYS, old).when(age > V.OLDER_AGE_DAYS, F.lit("Archive/Older"))
    return rule


@dataclass(frozen=True)
class RuleSet:
    """An immutable ordered list of named rules."""

    rules: tuple[tuple[str, Callable[[], Column]], ...]

    def add(self, name: str, rule: Callable[[], Column], priority: int | None = None) -> RuleSet:
        at = len(self.rules) if priority is None else priority
        return RuleSet((*self.rules[:at], (name, rule), *self.rules[at:]))

    def remove(self, name: str) -> RuleSet:
        return RuleSet(tuple(r for r in self.rules if r[0] != name))

    def folder(self) -> Column:
        return F.coalesce(*[rule() for _, rule in self.rules], F.lit("_Needs_Review"))

    def rule_name(self) -> Column:
        return F.coalesce(*[F.when(rule().isNotNull(), F.lit(n)) for n, rule in self.rules], F.lit("none"))


def default_rules(as_of: Column, keywords: str | None = None) -> RuleSet:
    """The standard rule order. ``keywords`` names an array column that feeds the financial rule."""
    return RuleSet((
        ("system", system_files),
        ("temp", temp_files),
        ("duplicate_like", duplicate_like),
        ("financial", financial(keywords)),
        ("work", named_documents(V.WORK_WORDS, "Documents/Work")),
        ("personal", named_documents(V.PERSONAL_WORDS, "Documents/Personal")),
        ("educational", named_documents(V.EDUCATION_WORDS, "Documents/Educational")),
        ("screenshots", screenshots),
        ("camera", camera_photos),
        ("social", social_images),
        ("video", by_words("video", V.VIDEO_FOLDERS)),
        ("audio", by_words("audio", V.AUDIO_FOLDERS)),
        ("installers", installers),
        ("archives", by_words("archive", V.ARCHIVE_FOLDERS)),
        ("code", code_files),
        ("by_type", by_type),
        ("by_age", by_age(as_of)),
    ))


def classify(files: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``target_path``: folder and name relative to the target. One projection, no shuffle."""
    return files.withColumn("target_path", F.concat(rules.folder(), F.lit("/"), F.col("name")))


def rules_plan(files: DataFrame, rules: RuleSet, target: str = "organized") -> DataFrame:
    """The base directories and one move per file."""
    moves = classify(files, rules)
    moves = action_rows(
        moves, "move", source=F.col("path"),
        destination=F.concat(F.lit(target + "/"), F.col("target_path")),
        reason=F.concat(F.lit("Rule-based classification: "), F.col("target_path")),
    )
    return create_dirs(files.sparkSession, [f"{target}/{d}" for d in V.BASE_DIRECTORIES]).unionByName(moves)
