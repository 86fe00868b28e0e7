"""Licence scan by a positional index of rare words: DataFrame functions only."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A to Z are in lower case (fixed value).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that give a label wherever their words stand one after another (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words that no template is looked up by (fixed values).
COMMON = "a an and are as by for in is it of or that the this to under with without you".split()


@dataclass(frozen=True)
class Template:
    """A licence's wording as lower-case words, and the phrases inside it without which it isn't that licence."""

    label: str
    words: str
    phrases: tuple[str, ...]


#: Public wordings of licences and of lines that grant them (fixed values).
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                    "documentation files the software to deal in the software without restriction",
             ("hereby granted free of charge", "associated documentation files")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
             ("except in compliance with the license",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                    "license as published by the free software foundation",
             ("gnu general public license", "free software foundation")),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
             ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
             ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                    "following conditions are met", ("source and binary forms", "conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("for any purpose with or without fee",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
)


def _position(words: list[str], phrase: str) -> int:
    parts = phrase.split()
    return next(i for i in range(len(words)) if words[i:i + len(parts)] == parts)


def _candidates(templates: tuple[Template, ...]) -> list[tuple[int, str, int]]:
    """(template, word, position) of all words that may be looked up."""
    return [(i, w, at) for i, t in enumerate(templates) for at, w in enumerate(t.words.split()) if w not in COMMON]


def _values(rows: list[tuple], columns: str) -> str:
    """A small constant table in SQL."""
    told = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS t({columns})"


def _required(templates: tuple[Template, ...]) -> list[tuple[int, str, int]]:
    return [(i, p, _position(t.words.split(), p)) for i, t in enumerate(templates) for p in t.phrases]


def read_words(docs: DataFrame, id_column: str, text: str, templates: tuple[Template, ...]) -> DataFrame:
    """One pass over the texts: a numbered row for each with its number of words, the places of base phrases and, where two of
    the templates' words stand, these words' places and those of the templates' phrases."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SEPARATORS, " "))
    rows = docs.select(F.col(id_column).alias("id"), flat.alias("flat"))
    rows = rows.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")))
    rows = rows.withColumn("padded", F.concat(F.lit(" "), "flat", F.lit(" ")))
    known = sorted({w for _, w, _ in _candidates(templates)})
    seen = F.filter(F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(w.alias("word"), i.alias("at")))), lambda h: h.isNotNull())
    rows = rows.withColumn("seen", seen)

    def places(phrase: str) -> Column:
        parts = phrase.split()
        starts = F.sequence(F.lit(0), F.size("words") - len(parts))
        here = lambda i: functools.reduce(lambda a, b: a & b, (F.get("words", i + k) == p for k, p in enumerate(parts)))
        return F.when(F.col("padded").contains(f" {phrase} "), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumns({f"base{i}": places(p) for i, p in enumerate(BASE)})
    phrases = sorted({p for t in templates for p in t.phrases})
    named = lambda phrase: lambda at: F.struct(F.lit(phrase).alias("phrase"), at.alias("at"))
    found = F.flatten(F.array(*(F.transform(places(p), named(p)) for p in phrases)))
    told = "array<struct<phrase:string,at:int>>"
    several = F.size("seen") > 1
    base = F.concat(*(F.col(f"base{i}") for i in range(len(BASE))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values()))))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), base.alias("base"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"),
        F.when(several, F.col("seen")).otherwise(F.array().cast("array<struct<word:string,at:int>>")).alias("seen"),
        F.when(several, found.cast(told)).otherwise(F.array().cast(told)).alias("phrases"))


def index_rows(counts: dict[str, int], templates: tuple[Template, ...], rare: int) -> list[tuple[int, str, int, int]]:
    """The index ``(template, word, position, rank)``: each template's ``rare`` words of highest IDF; ranks go by IDF, words in few
    documents first."""
    order = {w: i for i, w in enumerate(sorted({w for _, w, _ in _candidates(templates)}, key=lambda w: (counts.get(w, 0), w)))}
    chosen = {(i, w) for i in range(len(templates)) for w in sorted({w for j, w, _ in _candidates(templates) if j == i}, key=order.get)[:rare]}
    return [(i, w, at, order[w]) for i, w, at in _candidates(templates) if (i, w) in chosen]


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text: str = "text",
                  rare: int = 6, looked_up: int = 16, share: float = 0.6) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row.

    The rarity of the templates' words is counted over all documents. Each template is indexed by the positions of its ``rare``
    words of highest IDF, each text looks up the ``looked_up`` ones of highest IDF that it holds; hits that agree on where a template
    would begin make a candidate if they are at least ``share`` of its indexed positions (two at least), and a candidate gives its
    label if all its phrases stand in the text where the template has them. Base phrases give their labels wherever they stand.
    The score is 1 with a base phrase, else the largest share of a template found, else 0.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start (null without
    any), both label columns are distinct, sorted and joined by commas (empty without any). Null texts are empty and have no words;
    repeated rows, also with null ids, all come out, equal rows alike; no rows give no rows. Other columns are not read. Texts of any length are read
    whole. Only the counts of the templates' words (some hundred) reach the driver.
    """
    spark = docs.sparkSession
    rows = materialize(read_words(docs, id_column, text, templates), "words")
    counted = rows.select(F.explode(F.array_distinct("seen.word")).alias("word")).groupBy("word").count()
    index = index_rows({r["word"]: r["count"] for r in counted.collect()}, templates, rare)
    positions = {i: sum(1 for j, *_ in index if i == j) for i in range(len(templates))}
    about = [(i, t.label, positions[i], len(t.phrases)) for i, t in enumerate(templates)]
    table = lambda rows, columns: spark.sql(f"SELECT * FROM {_values(rows, columns)}")
    indexed, known = table(index, "template, word, place, rank"), table(about, "template, label, positions, phrases_needed")
    required = table(_required(templates), "template, phrase, place")

    rank = F.create_map(*(F.lit(x) for w, r in sorted({(w, r) for _, w, _, r in index}) for x in (w, r)))
    ranks = F.sort_array(F.array_distinct(F.transform(F.filter("seen", lambda h: rank[h["word"]].isNotNull()), lambda h: rank[h["word"]])))
    limit = F.coalesce(F.get(ranks, F.lit(looked_up - 1)), F.array_max(ranks))
    hits = rows.where(F.size("seen") > 1).withColumn("limit", limit)
    hits = hits.select("row", F.explode(F.filter("seen", lambda h: rank[h["word"]] <= F.col("limit"))).alias("h")).select("row", "h.word", "h.at")
    begins = hits.join(indexed, "word").groupBy("row", "template", (F.col("at") - F.col("place")).alias("begin")).agg(F.count("*").alias("agree"))
    candidates = begins.join(known, "template").where((F.col("agree") >= 2) & (F.col("agree") >= share * F.col("positions")))
    stands = rows.select("row", F.explode("phrases").alias("p")).select("row", "p.phrase", "p.at")
    wanted = candidates.join(required, "template").withColumn("at", F.col("begin") + F.col("place"))
    verified = wanted.join(stands, ["row", "phrase", "at"], "left_semi").groupBy("row", "template", "begin").agg(
        F.count("*").alias("n"), F.first("phrases_needed").alias("needed"), F.first("label").alias("label"),
        F.first(F.col("agree") / F.col("positions")).alias("part")).where("n = needed")
    found = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("part").alias("part"))

    none = F.array().cast("array<string>")
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("found", none)))), ",")
    any_base = F.size("base") > 0
    return rows.drop("seen", "phrases").join(found, "row", "left").select(
        F.col("id").alias(id_column), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"),
        F.when(any_base, 1.0).otherwise(F.coalesce("part", F.lit(0.0))).cast("double").alias("score"))


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES, rare: int = 6, looked_up: int = 16, share: float = 0.6) -> str:
    """The same in DuckDB's SQL."""
    phrases = sorted({p for t in templates for p in t.phrases} | set(BASE))
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
split AS (SELECT row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SEPARATORS[1:-2]}]+') AS ws FROM numbered),
words AS (SELECT row, unnest(ws) AS word, unnest(range(len(ws))) AS "at" FROM split),
phrase AS (SELECT phrase, string_split(phrase, ' ') AS parts FROM {_values([(p,) for p in phrases], 'phrase')}),
stands AS (
  SELECT row, phrase, w."at" FROM words w JOIN phrase ON w.word = parts[1] JOIN split USING (row)
  WHERE ws[w."at" + 1:w."at" + len(parts)] = parts),
candidate AS (SELECT * FROM {_values(_candidates(templates), 'template, word, place')}),
about AS (SELECT * FROM {_values([(i, t.label, len(t.phrases)) for i, t in enumerate(templates)], 'template, label, phrases_needed')}),
required AS (SELECT * FROM {_values(_required(templates), 'template, phrase, place')}),
seen AS (SELECT row, word, "at" FROM words WHERE word IN (SELECT word FROM candidate) QUALIFY count(*) OVER (PARTITION BY row) > 1),
counted AS (SELECT word, count(DISTINCT row) AS n FROM seen GROUP BY word),
ranked AS (SELECT word, row_number() OVER (ORDER BY coalesce(n, 0), word) AS rank FROM (SELECT DISTINCT word FROM candidate) LEFT JOIN counted USING (word)),
chosen AS (
  SELECT template, word, rank FROM (SELECT DISTINCT template, word FROM candidate) JOIN ranked USING (word)
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY rank) <= {rare}),
indexed AS (SELECT template, word, place, rank FROM candidate JOIN chosen USING (template, word)),
sizes AS (SELECT template, count(*) AS positions FROM indexed GROUP BY template),
hits AS (
  SELECT row, word, "at" FROM seen JOIN (SELECT DISTINCT word, rank FROM indexed) USING (word)
  QUALIFY dense_rank() OVER (PARTITION BY row ORDER BY rank) <= {looked_up}),
begins AS (SELECT row, template, "at" - place AS begin_at, count(*) AS agree FROM hits JOIN indexed USING (word) GROUP BY ALL),
candidates AS (
  SELECT row, template, begin_at, label, phrases_needed, agree / positions AS part FROM begins JOIN about USING (template) JOIN sizes USING (template)
  WHERE agree >= 2 AND agree >= {share} * positions),
verified AS (
  SELECT row, template, begin_at, any_value(label) AS label, any_value(part) AS part
  FROM candidates JOIN required USING (template)
  WHERE EXISTS (SELECT 1 FROM stands s WHERE s.row = candidates.row AND s.phrase = required.phrase AND s."at" = begin_at + required.place)
  GROUP BY row, template, begin_at HAVING count(*) = any_value(phrases_needed)),
based AS (
  SELECT row, count(*) AS n_base, min("at") AS first_word, max("at") AS last_word, list(DISTINCT label) AS base
  FROM stands JOIN {_values(list(BASE.items()), 'phrase, label')} USING (phrase) GROUP BY row),
found AS (SELECT row, list(DISTINCT label) AS found, max(part) AS part FROM verified GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END::DOUBLE AS score
FROM split LEFT JOIN based USING (row) LEFT JOIN found USING (row)"""
