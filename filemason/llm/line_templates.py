"""Line dedup by a log-template tree: lines whose template recurs across documents are dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import same

FIELD = "<*>"


@dataclass(frozen=True)
class TemplateTree:
    """How lines are parsed and when a template counts as recurring.

    A line's leaf is its number of words and its first ``depth`` words, words with a digit being variable. A word is
    fixed in its leaf if at least ``fixed_share`` of the leaf's different lines have it at that place; a line with at
    least ``likeness`` fixed words has them as its template, others their own text with variable words.
    A template recurs if it is in ``min_docs`` different texts, and with ``spread`` times as many different
    first lines or different last lines (by leaf): copies and near copies of a document share both.
    Lines of fewer than ``min_words`` words always stay.

    With ``absolute`` a template also recurs if it is in ``min_docs`` different documents whatever their share: a text
    of whose words at least ``own`` stand in lines that open unlike those of ``min_docs`` texts counts as a document of
    its own, others by the most frequent of three sampled line openings, so near copies fall together
    in at most three. Then a leaf also holds any number of templates with one variable word
    after the first ``depth`` ones, in lines of at least twice as many words.
    """

    depth: int = 3
    min_words: int = 3
    fixed_share: float = 0.5
    likeness: float = 0.7
    min_docs: int = 5
    spread: float = 0.5
    absolute: bool = False
    own: float = 0.3


def masked(line: Column) -> Column:
    """The trimmed line with words that hold a digit as variable fields."""
    plain = F.trim(line)
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(plain)


def words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column, tree: TemplateTree) -> Column:
    return F.xxhash64(words(line), F.substring_index(line, " ", tree.depth))


def _lines(docs: DataFrame, tree: TemplateTree) -> DataFrame:
    """A row for each line with enough words: what its document is known by, its place, its leaf and its masked text."""
    text = F.coalesce("text", F.lit(""))
    first, last = (leaf(masked(F.substring_index(text, "\n", n)), tree) for n in (1, -1))
    rows = docs.select("doc", "copy", first.alias("first"), last.alias("last"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    rows = rows.withColumn("line", masked(F.col("line"))).withColumn("words", words(F.col("line"))).where(F.col("words") >= tree.min_words)
    return rows.select("doc", "copy", "first", "last", "place", leaf(F.col("line"), tree).alias("leaf"),
                       F.xxhash64("line").alias("line_id"), "words", "line",
                       *([F.xxhash64(F.substring_index("line", " ", tree.depth)).alias("lead")] if tree.absolute else []))


def documents(narrow: DataFrame, tree: TemplateTree) -> DataFrame:
    """(copy, document) of every text: the same document for what is nearly copied, see ``TemplateTree``."""
    leads = materialize(narrow.groupBy("copy", "lead").agg(F.max("words").alias("words")), "leads")
    often = leads.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") >= tree.min_docs)
    held = leads.join(often, "lead", "left")
    sketches = F.array(*(F.min(F.xxhash64("lead", F.lit(k))) for k in range(3)))
    texts = held.groupBy("copy").agg((F.sum(F.when(F.col("n").isNull(), F.col("words")).otherwise(0)) / F.sum("words")).alias("share"),
                                     sketches.alias("sketches"))
    texts = materialize(texts, "texts")
    alone = texts.where(F.col("share") >= tree.own).select("copy", F.col("copy").alias("document"))
    sampled = texts.where(F.col("share") < tree.own).select("copy", F.posexplode("sketches").alias("k", "sketch"))
    counts = sampled.groupBy("k", "sketch").agg(F.count("*").alias("n"))
    near = sampled.join(counts, ["k", "sketch"]).groupBy("copy").agg(F.max(F.struct("n", "k", "sketch"))["sketch"].alias("document"))
    return alone.unionByName(near)


def recurring_patterns(seen: DataFrame, several: DataFrame, tree: TemplateTree) -> DataFrame:
    """(leaf, line_id) of the lines that differ from those of ``min_docs`` documents in the same word only."""
    split = several.withColumn("parts", F.split("line", " ")).where(F.size("parts") >= 2 * tree.depth)
    hashes = split.select("leaf", "line_id", F.transform("parts", lambda w, i: F.xxhash64(i, w)).alias("hashes"))
    whole = F.aggregate("hashes", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    hashes = hashes.withColumn("whole", whole)
    rest = F.slice(F.transform("hashes", lambda h, i: F.struct(i.alias("at"), F.col("whole").bitwiseXOR(h).alias("pattern"))), tree.depth + 1, 1 << 30)
    patterns = hashes.select("leaf", "line_id", F.explode(rest).alias("p")).select("leaf", "line_id", "p.at", "p.pattern")
    # only patterns of several lines are new, and only these meet the documents
    shared = patterns.groupBy("leaf", "at", "pattern").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    patterns = materialize(patterns.join(shared, ["leaf", "at", "pattern"]), "patterns")
    held = seen.select("leaf", "line_id", "document").distinct().join(patterns, ["leaf", "line_id"])
    counts = held.groupBy("leaf", "at", "pattern").agg(F.count_distinct("document").alias("docs")).where(F.col("docs") >= tree.min_docs)
    return patterns.join(counts, ["leaf", "at", "pattern"], "left_semi").select("leaf", "line_id")


def recurring(lines: DataFrame, narrow: DataFrame, tree: TemplateTree) -> DataFrame:
    """(leaf, line_id) of every masked line whose template recurs."""
    texts = narrow.groupBy("leaf", "line_id").agg(F.max("words").alias("words"))
    busy = narrow.groupBy("leaf").agg(F.count_distinct("copy").alias("docs"), F.count_distinct("line_id").alias("lines"))
    busy = materialize(busy.where((F.col("docs") >= tree.min_docs) & (F.col("lines") > 1)).select("leaf", "lines"), "leaves")
    # the words of each different line in leaves that hold several
    several = lines.select("leaf", "line_id", "line").join(busy.select("leaf"), "leaf", "left_semi")
    several = several.dropDuplicates(["leaf", "line_id"])
    placed = materialize(several.select("leaf", "line_id", F.posexplode(F.split("line", " ")).alias("at", "word")), "words")
    shares = placed.groupBy("leaf", "at", "word").agg(F.count("*").alias("n")).join(busy, "leaf")
    fixed = shares.where((F.col("n") >= tree.fixed_share * F.col("lines")) & (F.col("word") != FIELD)).select("leaf", "at", "word")
    general = placed.join(fixed, ["leaf", "at", "word"]).groupBy("leaf", "line_id").agg(
        F.count("*").alias("n_fixed"), F.bit_xor(F.xxhash64("leaf", "at", "word")).alias("general"))
    known = texts.join(general, ["leaf", "line_id"], "left")
    template = F.when(F.col("n_fixed") >= tree.likeness * F.col("words"), F.col("general")).otherwise(F.col("line_id"))
    known = known.select("leaf", "line_id", template.alias("template"))
    seen = narrow.select("leaf", "line_id", "copy", "first", "last").distinct().join(known, ["leaf", "line_id"])
    counts = seen.groupBy("leaf", "template").agg(
        F.count_distinct("copy").alias("docs"), F.count_distinct("first").alias("firsts"), F.count_distinct("last").alias("lasts"))
    often = counts.where((F.col("docs") >= tree.min_docs) & (F.greatest("firsts", "lasts") >= tree.spread * F.col("docs"))).select("leaf", "template")
    if not tree.absolute:
        return known.join(often, ["leaf", "template"], "left_semi").select("leaf", "line_id")
    seen = materialize(seen.select("leaf", "line_id", "template", "copy").join(documents(narrow, tree), "copy"), "seen")
    spread = seen.groupBy("leaf", "template").agg(F.count_distinct("document").alias("docs")).where(F.col("docs") >= tree.min_docs)
    often = often.unionByName(spread.select("leaf", "template")).distinct()
    gone = known.join(often, ["leaf", "template"], "left_semi").select("leaf", "line_id")
    return gone.unionByName(recurring_patterns(seen, several, tree)).distinct()


def drop_recurring_lines(docs: DataFrame, tree: TemplateTree = TemplateTree(), id_column: str = "doc_id", text: str = "text",
                         count_columns: bool = False) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of the text; with ``count_columns`` also ``n_lines`` and ``n_dropped``.

    Only DataFrame functions. Lines end at newlines; a null text stays null (without lines), an empty one is one empty line. Exact copies of
    a text count as one document, so copying a document makes none of its lines recurring; all rows stay, repeated
    ones too, and equal rows get equal texts. Leaves, templates and counts cover all lines of all documents; hot
    lines and leaves are counted with partial sums before any shuffle. No rows give no rows. Other columns pass through, and
    ``n_lines`` and ``n_dropped`` replace columns of these names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc"), F.xxhash64(body, F.length(body)).alias("copy"), F.col(text).alias("text"))
    lines = _lines(rows, tree)
    narrow = materialize(lines.drop("line"), "lines")
    gone = recurring(lines, narrow, tree)
    places = narrow.join(gone, ["leaf", "line_id"], "left_semi").groupBy("copy", "doc").agg(F.collect_set("place").alias("places"))
    keyed = docs.withColumns({"_doc": F.col(id_column), "_copy": F.xxhash64(body, F.length(body))})
    places = places.select(F.col("copy").alias("_copy"), F.col("doc").alias("_doc"), F.col("places").alias("_places"))
    joined = keyed.join(places, same(keyed, places, ["_copy", "_doc"]), "left")
    split = F.split(F.col(text), "\n")
    left = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("_places", i)), "\n")
    kept = F.when(F.col("_places").isNull(), F.col(text)).otherwise(left)
    counts = {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"),
              "n_dropped": F.coalesce(F.size(F.col("_places")), F.lit(0)).cast("long")}
    out = {**{c: docs[c] for c in docs.columns}, **(counts if count_columns else {}), text: kept}
    return joined.select(*(c.alias(name) for name, c in out.items()))


def oracle_sql(tree: TemplateTree = TemplateTree(), source: str = "documents", id_column: str = "doc_id") -> str:
    """The same in DuckDB's SQL: common table expressions up to ``line_result`` with doc_id, the counts and the kept text."""
    mask = lambda x: f"regexp_replace(trim({x}), '[^ 0-9]*[0-9][^ ]*', '{FIELD}', 'g')"
    count = lambda x: f"(length({x}) - length(replace({x}, ' ', '')) + 1)"
    lead = lambda x: f"array_to_string(string_split({x}, ' ')[1:{tree.depth}], ' ')"
    key = lambda x: f"{{'n': {count(x)}, 'lead': {lead(x)}}}"
    return f"""
    source_docs AS (SELECT row_number() OVER () AS r, {id_column} AS doc, coalesce(text, '') AS text, text IS NULL AS empty FROM {source}),
    split_docs AS (SELECT *, string_split(text, chr(10)) AS ls FROM source_docs),
    all_lines AS (SELECT r, text AS copy, {mask('ls[1]')} AS fl, {mask('ls[-1]')} AS ll, unnest(ls) AS raw, unnest(range(len(ls))) AS place FROM split_docs),
    parsed AS (SELECT r, copy, {key('fl')} AS "first", {key('ll')} AS "last", place, {mask('raw')} AS line FROM all_lines),
    kept_lines AS (SELECT *, {key('line')} AS leaf, {count('line')} AS words FROM parsed WHERE {count('line')} >= {tree.min_words}),
    busy AS (SELECT leaf, count(DISTINCT line) AS lines FROM kept_lines GROUP BY leaf
             HAVING count(DISTINCT copy) >= {tree.min_docs} AND count(DISTINCT line) > 1),
    several AS (SELECT DISTINCT leaf, line, words, lines FROM kept_lines JOIN busy USING (leaf)),
    placed AS (SELECT leaf, line, words, lines, unnest(string_split(line, ' ')) AS word, unnest(range(words)) AS "at" FROM several),
    shared AS (SELECT *, count(*) OVER (PARTITION BY leaf, "at", word) AS n FROM placed),
    general AS (SELECT leaf, line, string_agg("at" || ':' || word, ' ' ORDER BY "at") AS fixed FROM shared
                WHERE n >= {tree.fixed_share} * lines AND word <> '{FIELD}'
                GROUP BY leaf, line, words HAVING count(*) >= {tree.likeness} * words),
    templates AS (SELECT k.*, coalesce('general ' || fixed, 'line ' || k.line) AS template FROM kept_lines k
                  LEFT JOIN general g ON g.leaf = k.leaf AND g.line = k.line),
    often AS (SELECT leaf, template FROM templates GROUP BY leaf, template HAVING count(DISTINCT copy) >= {tree.min_docs}
              AND greatest(count(DISTINCT "first"), count(DISTINCT "last")) >= {tree.spread} * count(DISTINCT copy)),
    gone AS (SELECT r, list(place) AS places FROM templates SEMI JOIN often USING (leaf, template) GROUP BY r),
    line_result AS (SELECT d.r, d.doc AS doc_id, CASE WHEN empty THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(len(places), 0)::BIGINT AS n_dropped,
      CASE WHEN empty THEN NULL WHEN places IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(places, i - 1)), chr(10)), '') END AS text
      FROM split_docs d LEFT JOIN gone USING (r))"""
