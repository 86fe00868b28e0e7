"""Inventory, feature, rule and plan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import paths as P
from ..functions import text as X
from ..operators import features as FE
from ..operators import profile, scan_filters
from ..plans import actions as A
from ..plans import rules as R
from . import views
from .views import FILES_SQL, sql, sql_in

AS_OF_SQL = f"TIMESTAMP '{views.AS_OF}'"
AGE_SQL = f"epoch_us({AS_OF_SQL} - modified_at) / 86400e6"


def _has(column: str, words: list[str]) -> str:
    return f"regexp_matches({column}, '{X.literal_pattern(words)}')"


def file_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.type_mix(views.files(spark, sf_dir))


def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.totals(views.files(spark, sf_dir)).select(
        "n_files", F.round("total_size_mb", 6).alias("total_size_mb"))


def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scan_filters.visible(views.files(spark, sf_dir), "/corpus", max_depth=2, size_limit_mb=0.01)
    files = scan_filters.filtered(files, views.as_of(), extensions=[".TXT", ".pdf", ".md", ".py"],
                                  exclude_extensions=[".md"], min_age_days=30, max_age_days=600)
    return files.select("seq", "path", "extension", "size",
                        F.round(P.days_between(views.as_of(), F.col("modified_at")), 6).alias("age_days"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    return f.select("seq", "name", "extension", P.stem(F.col("name"), F.col("extension")).alias("stem"),
                    "parent_dir", "file_type", F.round(P.size_mb(F.col("size")), 9).alias("size_mb"))


def name_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir).select("seq", FE.metadata_features(views.as_of()).alias("m"))
    return f.select("seq", "m.*").withColumn("size_mb", F.round("size_mb", 9)).withColumn(
        "age_days", F.round("age_days", 6))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    return f.select("seq", FE.digest(F.col("text")).alias("content_hash"),
                    FE.digest(F.col("text"), "md5").alias("content_md5"))


def _text_columns(f: DataFrame) -> DataFrame:
    return f.select(
        "seq", "t.has_content", "t.char_count", "t.word_count", "t.line_count",
        F.round("t.avg_word_length", 6).alias("avg_word_length"), "t.unique_words", "t.has_urls", "t.has_emails",
        "t.content_preview")


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan_filters.text_only(views.files(spark, sf_dir))
    return _text_columns(f.select("seq", FE.text_features(F.col("text"), top_k=None).alias("t")))


def web_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan_filters.text_only(views.web_files(spark, sf_dir))
    return _text_columns(f.select("seq", FE.text_features(F.col("text"), top_k=None).alias("t")))


def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan_filters.text_only(FE.with_keywords(views.files(spark, sf_dir)))
    return f.select("seq", F.array_join("top_keywords", ",").alias("top_keywords"))


def feature_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    shout = FE.Extractor("shout", ["image"], F.struct(F.upper("name").alias("label")))
    f = FE.extract_features(f, [*FE.default_extractors(views.as_of()), shout]).select("seq", "features")
    return f.select(
        "seq", F.col("features.metadata.filename_length").alias("filename_length"),
        F.col("features.contenthash.content_hash").alias("content_hash"),
        F.col("features.textcontent.word_count").alias("word_count"),
        F.array_join("features.textcontent.top_keywords", ",").alias("top_keywords"),
        F.col("features.shout.label").alias("label"))


def gated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.files(spark, sf_dir)
    return f.select("seq", F.sha2(scan_filters.gated_text(max_file_size_kb=5), 256).alias("text_hash"))


def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files and the others as two branches, recombined."""
    f = views.files(spark, sf_dir)
    text = scan_filters.text_only(f).select("seq", F.lit("content").alias("route"))
    other = f.where(~F.col("file_type").isin(V.TEXT_TYPES)).select("seq", F.lit("metadata").alias("route"))
    return text.unionByName(other)


def _classified(spark: SparkSession, sf_dir: str, rules: R.RuleSet) -> DataFrame:
    f = FE.with_keywords(views.files(spark, sf_dir))
    return R.classify(f, rules).select("seq", "target_path")


def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, R.default_rules(views.as_of(), keywords="top_keywords"))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = R.default_rules(views.as_of())
    return views.files(spark, sf_dir).groupBy(rules.rule_name().alias("rule")).agg(F.count("*").alias("n_files"))


def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A big-file rule in front, and no rule for temporary files."""
    rules = R.default_rules(views.as_of()).remove("temp").add(
        "big", lambda: F.when(F.col("size") > 20000, F.lit("Big")), priority=0)
    f = R.classify(views.files(spark, sf_dir), rules)
    return f.select("seq", "target_path")


def age_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age rule moved in front of the rule by type, where it can answer."""
    rules = R.default_rules(views.as_of()).remove("by_age").add("by_age", R.by_age(views.as_of()), priority=15)
    f = R.classify(views.files(spark, sf_dir), rules)
    return f.select("seq", "target_path")


def rules_plan_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rules_plan(views.files(spark, sf_dir), R.default_rules(views.as_of()))


def rules_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_plan_frame(spark, sf_dir).drop("metadata")


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_summary(rules_plan_frame(spark, sf_dir))


def plan_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = A.of_type(rules_plan_frame(spark, sf_dir), "move")
    return moves.groupBy(P.parent_dir(F.col("destination")).alias("target_dir")).agg(F.count("*").alias("n_files"))


def plan_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_sample(rules_plan_frame(spark, sf_dir), 20)


def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).orderBy("seq").limit(10).select("seq", "path", "file_type")


WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"


def text_features_sql(source: str) -> str:
    return f"""
text_words AS (
  SELECT seq, text, {WORDS_SQL} AS w FROM {source} WHERE file_type IN ('document', 'code')
)""", """
SELECT seq, true AS has_content, CAST(length(text) AS BIGINT) AS char_count, CAST(len(w) AS BIGINT) AS word_count,
       CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS line_count,
       round(length(array_to_string(w, '')) / len(w), 6) AS avg_word_length,
       CAST(len(list_distinct(w)) AS BIGINT) AS unique_words,
       contains(lower(text), 'http') AS has_urls,
       contains(text, '@') AND contains(text, '.') AS has_emails,
       CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS content_preview
FROM text_words"""


KEYWORDS_SQL = f"""
doc_words AS (
  SELECT seq, {WORDS_SQL} AS w FROM files WHERE file_type IN ('document', 'code')
), placed AS (
  SELECT seq, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM doc_words
), counted AS (
  SELECT seq, word, count(*) AS n, min(pos) AS first_pos FROM placed
  WHERE length(word) > 2 AND word NOT IN {sql_in(V.KEYWORD_STOP_WORDS)}
  GROUP BY seq, word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY n DESC, first_pos) AS r FROM counted
), keywords AS (
  SELECT seq, string_agg(word, ',' ORDER BY r) AS top_keywords, list(word ORDER BY r) AS words
  FROM ranked WHERE r <= 10 GROUP BY seq
)"""

WEB_SQL = """
web AS (
  SELECT page_id AS seq, html AS text, 'code' AS file_type FROM pages
)"""


def _folders_case(words_column: str, folders: list[tuple[list[str], str]]) -> str:
    whens = " ".join(f"WHEN {_has(words_column, w)} THEN '{f}'" for w, f in folders if w)
    return f"CASE {whens} ELSE '{folders[-1][1]}' END"


def rules_case(skip: tuple[str, ...] = (), first: str = "", age_before_type: bool = False, keywords: bool = False,
               answer: str = "folder") -> str:
    """The rule cascade as a CASE over ``files`` (with ``words`` when keywords count)."""
    name, stem = "lower(name)", "left(lower(name), length(name) - length(extension))"
    financial = _has(name, V.FINANCIAL_WORDS)
    if keywords:
        words = "[" + ", ".join(f"'{w}'" for w in V.FINANCIAL_WORDS) + "]"
        financial = f"({financial} OR coalesce(list_has_any(words, {words}), false))"
    code = "CASE " + " ".join(f"WHEN extension IN {sql_in(e)} THEN '{f}'" for e, f in V.CODE_FOLDERS if e)
    code += " ELSE 'Code/Other' END"
    by_type = "CASE file_type " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in V.TYPE_FOLDERS.items()) + " END"
    shot = _has(name, V.SCREENSHOT_WORDS)
    camera = "|".join(V.CAMERA_PATTERNS)
    system = ", ".join("'" + s.replace("\r", "' || chr(13) || '") + "'" for s in V.SYSTEM_NAMES)
    rules = [
        ("system", f"{name} IN ({system}) OR name LIKE '.%'", "'System_Files'"),
        ("temp", f"{_has(name, V.TEMP_WORDS)} OR extension IN {sql_in(V.TEMP_EXTENSIONS)}", "'System_Files/Temp'"),
        ("duplicate_like", f"regexp_matches({stem}, '{'|'.join(V.DUPLICATE_STEM_PATTERNS)}')",
         "'_Needs_Review/Potential_Duplicates'"),
        ("financial", f"file_type = 'document' AND {financial}", "'Documents/Financial'"),
        ("work", f"file_type = 'document' AND {_has(name, V.WORK_WORDS)}", "'Documents/Work'"),
        ("personal", f"file_type = 'document' AND {_has(name, V.PERSONAL_WORDS)}", "'Documents/Personal'"),
        ("educational", f"file_type = 'document' AND {_has(name, V.EDUCATION_WORDS)}", "'Documents/Educational'"),
        ("screenshots", f"file_type = 'image' AND ({shot} OR regexp_matches({name}, '{V.SCREENSHOT_PATTERN}'))",
         "'Images/Screenshots'"),
        ("camera", f"file_type = 'image' AND regexp_matches({name}, '{camera}')", "'Images/Photos/Camera'"),
        ("social", f"file_type = 'image' AND {_has(name, V.SOCIAL_WORDS)}", "'Images/Photos/Social_Media'"),
        ("video", "file_type = 'video'", _folders_case(name, V.VIDEO_FOLDERS)),
        ("audio", "file_type = 'audio'", _folders_case(name, V.AUDIO_FOLDERS)),
        ("installers", f"extension IN {sql_in(V.INSTALLER_EXTENSIONS)} OR {_has(name, V.INSTALLER_WORDS)}",
         "'Software/Installers'"),
        ("archives", "file_type = 'archive'", _folders_case(name, V.ARCHIVE_FOLDERS)),
        ("code", "file_type = 'code'", code),
    ]
    parts = [first] if first else []
    parts += [f"WHEN {test} THEN " + (folder if answer == "folder" else f"'{rule}'")
              for rule, test, folder in rules if rule not in skip]
    if age_before_type:
        parts.append(f"WHEN {AGE_SQL} > 365 THEN 'Archive/Old_Files/' || year(modified_at)")
        parts.append(f"WHEN {AGE_SQL} > 90 THEN 'Archive/Older'")
    return "CASE " + "\n  ".join(parts) + "\n  ELSE " + (by_type if answer == "folder" else "'by_type'") + " END"


RULES_PLAN_SQL = f"""
classified AS (
  SELECT seq, path, name, modified_at, {rules_case()} || '/' || name AS target_path FROM files
), rules_plan AS (
  SELECT CAST(generate_subscripts(d, 1) - 1 - len(d) AS BIGINT) AS seq, 'create_dir' AS action_type, '' AS source,
         'organized/' || unnest(d) AS destination, '' AS reason, 1.0::DOUBLE AS confidence
  FROM (SELECT [{", ".join(f"'{d}'" for d in V.BASE_DIRECTORIES)}] AS d)
  UNION ALL
  SELECT seq, 'move', path, 'organized/' || target_path, 'Rule-based classification: ' || target_path, 1.0::DOUBLE
  FROM classified
)"""

ACTION_TEXT_SQL = """
CASE action_type WHEN 'move' THEN 'MOVE: ' || regexp_extract(source, '[^/]*$') || ' → ' || destination
     WHEN 'delete' THEN 'DELETE: ' || regexp_extract(source, '[^/]*$') || ' (' || reason || ')'
     WHEN 'create_dir' THEN 'CREATE: ' || destination || '/'
     ELSE upper(action_type) || ': ' || source END"""
PHASE_SQL = "CASE action_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(V.ACTION_ORDER)) + " END"

QUERIES = {
    f.__name__: f for f in (
        file_type_mix, inventory_totals, filtered_scan, path_parts, name_features, content_hash, text_features,
        web_text_features, top_keywords, feature_struct, gated_text, text_split, rule_classify, rule_hits,
        custom_rule, age_rule, rules_plan, plan_summary, plan_by_folder, plan_sample, first_files,
    )
}

SQL = {
    "file_type_mix": sql(FILES_SQL, "SELECT file_type, count(*) AS n_files FROM files GROUP BY file_type"),
    "inventory_totals": sql(FILES_SQL, """
        SELECT count(*) AS n_files, round(sum(size) / 1048576.0, 6) AS total_size_mb FROM files"""),
    "filtered_scan": sql(FILES_SQL, f"""
        SELECT seq, path, extension, size, round({AGE_SQL}, 6) AS age_days FROM files
        WHERE name NOT LIKE '.%' AND size <= 0.01 * 1048576 AND extension IN ('.txt', '.pdf', '.py')
          AND {AGE_SQL} BETWEEN 30 AND 600"""),
    "path_parts": sql(FILES_SQL, """
        SELECT seq, name, extension, left(name, length(name) - length(extension)) AS stem, parent_dir, file_type,
               round(size / 1048576.0, 9) AS size_mb FROM files"""),
    "name_features": sql(FILES_SQL, f"""
        SELECT seq, extension, round(size / 1048576.0, 9) AS size_mb, round({AGE_SQL}, 6) AS age_days,
               CAST(length(name) AS BIGINT) AS filename_length, contains(name, ' ') AS has_spaces,
               regexp_matches(name, '\\d') AS has_numbers,
               upper(name) = name AND lower(name) <> name AS is_uppercase,
               lower(name) = name AND upper(name) <> name AS is_lowercase,
               CAST(len(list_filter(regexp_split_to_array(name, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count,
               {_has("lower(name)", V.DOWNLOAD_HINTS)} AS likely_download,
               {_has("lower(name)", V.SCREENSHOT_HINTS)} AS likely_screenshot,
               {_has("lower(name)", V.BACKUP_HINTS)} AS likely_backup,
               regexp_matches(name, '{"|".join(V.DATE_PATTERNS)}') AS has_date_pattern,
               regexp_matches(name, '{"|".join(V.VERSION_PATTERNS)}') AS has_version_pattern
        FROM files"""),
    "content_hash": sql(FILES_SQL, "SELECT seq, sha256(text) AS content_hash, md5(text) AS content_md5 FROM files"),
    "text_features": sql(FILES_SQL, *text_features_sql("files")),
    "web_text_features": sql(WEB_SQL, *text_features_sql("web")),
    "top_keywords": sql(FILES_SQL, KEYWORDS_SQL, """
        SELECT seq, coalesce(top_keywords, '') AS top_keywords FROM doc_words LEFT JOIN keywords USING (seq)"""),
    "feature_struct": sql(FILES_SQL, KEYWORDS_SQL, """
        SELECT seq, CAST(length(name) AS BIGINT) AS filename_length, sha256(text) AS content_hash,
               CAST(len(w) AS BIGINT) AS word_count,
               CASE WHEN w IS NOT NULL THEN coalesce(top_keywords, '') END AS top_keywords,
               CASE WHEN file_type = 'image' THEN upper(name) END AS label
        FROM files LEFT JOIN doc_words USING (seq) LEFT JOIN keywords USING (seq)"""),
    "gated_text": sql(FILES_SQL, """
        SELECT seq, sha256(CASE WHEN size <= 5120 AND file_type IN ('document', 'code') THEN text ELSE '' END)
               AS text_hash FROM files"""),
    "text_split": sql(FILES_SQL, """
        SELECT seq, CASE WHEN file_type IN ('document', 'code') THEN 'content' ELSE 'metadata' END AS route
        FROM files"""),
    "rule_classify": sql(FILES_SQL, KEYWORDS_SQL, f"""
        SELECT seq, {rules_case(keywords=True)} || '/' || name AS target_path
        FROM files LEFT JOIN keywords USING (seq)"""),
    "rule_hits": sql(FILES_SQL, f"""
        SELECT {rules_case(answer="rule")} AS rule, count(*) AS n_files FROM files GROUP BY 1"""),
    "custom_rule": sql(FILES_SQL, f"""
        SELECT seq, {rules_case(skip=("temp",), first="WHEN size > 20000 THEN 'Big'")} || '/' || name AS target_path
        FROM files"""),
    "age_rule": sql(FILES_SQL, f"""
        SELECT seq, {rules_case(age_before_type=True)} || '/' || name AS target_path FROM files"""),
    "rules_plan": sql(FILES_SQL, RULES_PLAN_SQL, "SELECT * FROM rules_plan"),
    "plan_summary": sql(FILES_SQL, RULES_PLAN_SQL, """
        SELECT count(*) AS total_actions, count(*) FILTER (action_type = 'move') AS files_to_move,
               count(*) FILTER (action_type = 'delete') AS files_to_delete,
               count(*) FILTER (action_type = 'create_dir') AS directories_to_create FROM rules_plan"""),
    "plan_by_folder": sql(FILES_SQL, RULES_PLAN_SQL, """
        SELECT regexp_replace(destination, '/[^/]*$', '') AS target_dir, count(*) AS n_files FROM rules_plan
        WHERE action_type = 'move' GROUP BY 1"""),
    "plan_sample": sql(FILES_SQL, RULES_PLAN_SQL, f"""
        SELECT seq, {ACTION_TEXT_SQL} AS action, confidence,
               (SELECT greatest(count(*) - 20, 0) FROM rules_plan) AS more_actions
        FROM rules_plan ORDER BY seq, {PHASE_SQL} LIMIT 20"""),
    "first_files": sql(FILES_SQL, "SELECT seq, path, file_type FROM files ORDER BY seq LIMIT 10"),
}
