"""The best folder of each summary, by an index of the folders' letter groups: a term meets only folders that can contain it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import materialize

#: Length of the indexed letter groups; shorter terms are looked up as they are.
GRAM = 3


def _grams(text: Column, length: int) -> Column:
    """The distinct groups of so many letters in a text."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    found = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(length))))
    return F.when(F.length(text) >= length, found).otherwise(F.array().cast("array<string>"))


def folder_index(folders: DataFrame) -> DataFrame:
    """``(gram, pos, lower)``: the groups of one to ``GRAM`` letters of every folder ``(pos, folder)``."""
    lower = folders.select("pos", F.lower("folder").alias("lower"))
    grams = F.concat(*(_grams(F.col("lower"), n) for n in range(1, GRAM + 1)))
    return lower.select(F.explode(grams).alias("gram"), "pos", "lower")


def containing(terms: DataFrame, folders: DataFrame) -> DataFrame:
    """``(term, pos)`` of the folders whose lower-case path contains a term (not empty): those that hold the rarest of the
    term's letter groups are looked through."""
    index = materialize(folder_index(folders), "grams")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    grams = F.when(F.length("term") < GRAM, F.array("term")).otherwise(_grams(F.col("term"), GRAM))
    asked = terms.where("term <> ''").select("term", F.explode(grams).alias("gram")).join(counts, "gram", "left")
    # a group that no folder has rules the term out
    rarest = asked.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    return rarest.select("term", F.col("r.gram").alias("gram")).join(index, "gram").where(F.col("lower").contains(F.col("term"))).select("term", "pos")


def match_folders(summaries: DataFrame, folders: DataFrame) -> DataFrame:
    """``summaries`` with ``folder``: of ``folders`` ``(pos, folder)`` the one with the highest score, the first of equal ones.

    A folder scores 3 for containing the category, 2 for each topic and 4 for the suggested folder (unless empty), all in lower
    case; an empty category or topic is contained in every folder. Without any score it goes by the category (the first
    folder with 'work' or 'personal'), else to Documents. Equal questions are asked once, and any number of folders will do.
    """
    lists = {"category": F.lower("category"), "topics": F.transform("topics", F.lower), "suggested": F.lower("suggested_folder")}
    summaries = summaries.withColumn("_asked", F.struct(*(c.alias(n) for n, c in lists.items())))
    asked = materialize(summaries.select("_asked").distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    one = lambda term, weight: F.struct(term.alias("term"), F.lit(weight).alias("weight"))
    topics = F.coalesce("_asked.topics", F.array().cast("array<string>"))
    parts = F.concat(F.array(one(F.col("_asked.category"), 3), one(F.nullif(F.col("_asked.suggested"), F.lit("")), 4)),
                     F.transform(topics, lambda t: one(t, 2)))
    terms = asked.select("id", F.explode(parts).alias("p")).where("p.term IS NOT NULL").groupBy("id", F.col("p.term").alias("term")).agg(
        F.sum("p.weight").alias("weight"))
    terms = materialize(terms, "terms")
    found = containing(terms.select("term").distinct(), folders)
    scored = terms.join(found, "term").groupBy("id", "pos").agg(F.sum("weight").alias("score"))
    # what every folder contains is worth the first folder, unless another one has more
    everywhere = terms.where("term = ''").select("id", "weight").crossJoin(folders.agg(F.min("pos").alias("pos"))).where("pos IS NOT NULL")
    scored = scored.unionByName(everywhere.select("id", "pos", F.lit(0).cast("bigint").alias("score")))
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("b")).select("id", (-F.col("b.back")).alias("pos"))

    def first_with(word: str) -> Column:
        row = folders.where(F.lower("folder").contains(word)).agg(F.min(F.struct("pos", "folder")).alias("f")).first()  # one row
        return F.lit(row["f"]["folder"] if row["f"] else "Documents")

    named = asked.join(best, "id").join(folders.select("pos", "folder"), "pos").select(F.col("_asked").alias("_known"), F.col("folder").alias("_best"))
    placed = summaries.join(named, summaries["_asked"].eqNullSafe(named["_known"]), "left")
    category = F.col("_asked.category")
    folder = F.coalesce(
        F.col("_best"), F.when(category.isin(V.WORK_CATEGORIES), first_with("work")),
        F.when(category.isin(V.PERSONAL_CATEGORIES), first_with("personal")), F.lit("Documents"))
    return placed.withColumn("folder", folder).drop("_asked", "_known", "_best")
