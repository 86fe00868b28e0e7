"""Column helpers for names and texts. Everything here is a native expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V

# What splits words: Unicode white space plus the four ASCII separators.
SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
WORD_RUN = r"[\p{L}\p{N}_][\p{L}\p{N}_]++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_pattern(words: Iterable[str]) -> str:
    """An alternation that matches any of the literal ``words``."""
    return "|".join(re.sub(r"([.^$*+?()\[\]{}|\\~-])", r"\\\1", w) for w in words)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(literal_pattern(words))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """True if any regular expression is found; digits and spaces in the Unicode sense."""
    return text.rlike("(?U)" + "|".join(patterns))


def count_of(text: Column, piece: str) -> Column:
    """Occurrences of a one-character ``piece``."""
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_lower(text: Column) -> Column:
    return (F.lower(text) == text) & (F.upper(text) != text)


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def words(text: Column) -> Column:
    """Lower-case white-space separated words."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def unix_lines(text: Column) -> Column:
    """Line ends as text mode reads them."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def truncated(text: Column, limit: int | None, ending: str) -> Column:
    """The text itself, or its first ``limit`` characters and ``ending`` when it is longer."""
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(ending))).otherwise(text)


def title_case(text: Column) -> Column:
    """Capitalise after every non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 2**30)))), ""
    )


def counted(items: Column) -> Column:
    """Array of ``(minus, first, item)`` per distinct item of an array: minus its count, and where it is first.

    Sorting puts equal items side by side, so a run's length is the distance to the next start:
    no shuffle, no Python and no quadratic scan for long texts.
    """
    placed = F.sort_array(F.transform(items, lambda w, i: F.struct(w.alias("item"), i.alias("pos"))))

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1, F.lit(1)),
            lambda i: (i == 0) | (F.get(s, i - 1)["item"] != F.get(s, i)["item"]),
        )
        return let(starts, lambda st: F.transform(st, lambda at, i: let(F.get(s, at), lambda x: F.struct(
            (at - F.coalesce(F.get(st, i + 1), F.size(s))).alias("minus"), x["pos"].alias("first"), x["item"].alias("item")))))

    return let(placed, lambda s: F.when(F.size(s) > 0, runs(s)))


def top_items(items: Column, k: int) -> Column:
    """The ``k`` most frequent items, ties by first occurrence."""
    ranked = F.slice(F.sort_array(counted(items)), 1, k)
    return F.coalesce(F.transform(ranked, lambda c: c["item"]), F.array().cast("array<string>"))


def top_keywords(word_array: Column, k: int = 10) -> Column:
    """Most frequent words of more than two characters that are not stop words."""
    kept = F.filter(word_array, lambda w: (F.length(w) > 2) & ~w.isin(V.KEYWORD_STOP_WORDS))
    return top_items(kept, k)


def name_words(name: Column) -> Column:
    """Lower-case pieces of a file name longer than two characters."""
    return F.filter(F.split(F.lower(name), "(?U)" + V.NAME_WORD_SPLIT), lambda w: F.length(w) > 2)


def word_runs(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two duplicate-free arrays."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)
