"""Conflict, dry-run, apply and comparison queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster_report as R
from ..operators import duplicates as D
from ..operators import profile
from ..plans import actions as A
from ..plans import apply as AP
from ..plans import conflicts
from ..plans import organize as O
from . import views
from .clustering_queries import PROFILES_SQL
from .duplicate_queries import DUP_SQL, organize_plan_frame
from .enrich_queries import STUB_SQL
from .inventory_queries import FILES_SQL, KEYWORDS_SQL, RULES_PLAN_SQL, rules_case
from .views import CLUSTERED_SQL, sql


def _collected(files: DataFrame) -> DataFrame:
    """Moves that gather files by language under their bare names, so that many want the same one."""
    bare = F.regexp_replace("name", r"_[0-9]+(\.[^.]*)$", "$1")
    return A.action_rows(files, "move", source=F.col("path"),
                         destination=F.concat(F.lit("/collected/"), "lang", F.lit("/"), bare))


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What already lies in the collection: a numbered file for every labelled document."""
    labelled = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    files = _with_lang(spark, sf_dir).join(labelled, "seq", "left_semi")
    return files.select(F.concat(F.lit("/collected/"), "lang", F.lit("/"), "name").alias("path"))


def _with_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang")
    return views.files(spark, sf_dir).join(lang, "seq")


def conflict_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wishes = _collected(_with_lang(spark, sf_dir)).select(F.col("seq").alias("order"), "destination")
    return conflicts.resolve(wishes, _shelf(spark, sf_dir)).select(F.col("order").alias("seq"), "destination", "final")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compose(_collected(_with_lang(spark, sf_dir)), D.keep_newest(views.files(spark, sf_dir)))


def dry_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AP.dry_run_log(organize_plan_frame(spark, sf_dir), views.files(spark, sf_dir)).select("seq", "status", "message")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir).drop("text", "source")


def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = AP.apply_plan(_inventory(spark, sf_dir), AP.drop_moves_of_deleted(_plan(spark, sf_dir)))
    return done.files.select("seq", "path", "parent_dir", "extension", "file_type", "size")


def apply_plan_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = AP.apply_plan(_inventory(spark, sf_dir), D.keep_newest(views.files(spark, sf_dir)), backup=True)
    return done.files.select("seq", "path", "name", "extension")


def apply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AP.apply_plan(_inventory(spark, sf_dir), _plan(spark, sf_dir)).log.select("seq", "action_type", "status", "message")


def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan run on an inventory that lacks the labelled documents: their moves fail."""
    labelled = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    left = _inventory(spark, sf_dir).join(labelled, "seq", "left_anti")
    log = AP.apply_plan(left, _plan(spark, sf_dir)).log
    return AP.execution_summary(log).withColumn("success_rate", F.round("success_rate", 6))


def _exchange(files: DataFrame) -> DataFrame:
    """Every file is copied onto itself and the copy renamed; neighbours (2k and 2k + 1) then change places by way of a third name,
    which is deleted in the end although nothing is left there."""
    spare, own = F.concat("parent_dir", F.lit("/.moving")), conflicts.numbered(F.col("path"), F.lit(1))
    pairs = files.where("seq % 2 = 0").join(files.select((F.col("seq") - 1).alias("seq"), F.col("path").alias("other")), "seq")

    def step(rows: DataFrame, kind: str, source: Column, target: Column | None, at: int) -> DataFrame:
        return A.action_rows(rows, kind, source=source, destination=target, seq=F.col("seq") * 3 + at)

    return A.compose(
        step(files, "copy", F.col("path"), F.col("path"), 0), step(files, "rename", own, F.concat("parent_dir", F.lit("/kept")), 0),
        step(pairs, "move", F.col("path"), spare, 0), step(pairs, "move", F.col("other"), F.col("path"), 1),
        step(pairs, "move", spare, F.col("other"), 2), step(pairs, "delete", spare, None, 0))


def apply_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that need what earlier ones have freed or made."""
    files = _inventory(spark, sf_dir)
    return AP.apply_plan(files, _exchange(files)).files.select("seq", "path")


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus profile before and after its duplicates are deleted and the rest is moved."""
    files = views.files(spark, sf_dir).drop("source")
    after = AP.apply_plan(files, AP.drop_moves_of_deleted(organize_plan_frame(spark, sf_dir))).files
    return profile.compare_profiles(files, after).withColumn("value", F.round("value", 8))


def organize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rules plan with content keywords and duplicate deletions."""
    plan = O.organize(views.files(spark, sf_dir), "rules", views.as_of())
    return plan.select("action_type", "source", "destination", "reason", "confidence")


def organize_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by metadata and name patterns, found by DBSCAN, as a plan."""
    plan = O.organize(views.files(spark, sf_dir), "clustering", views.as_of(), eps=0.2,
                      feature_types=["metadata", "name_similarity"])
    return plan.select("action_type", "source", "destination", "reason", "confidence")


def organize_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by the offline model, fallback folders and duplicate deletions, summarised."""
    return A.plan_summary(O.organize(views.files(spark, sf_dir), "llm", views.as_of()))


def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir)
    return A.compare_strategies({
        "rules": O.rules_strategy(files, views.as_of()),
        "clustering": R.cluster_plan(views.clustered(spark, sf_dir)),
        "enrichment": O.enrichment_strategy(files),
    })


QUERIES = {f.__name__: f for f in (
    organize_rules, organize_clustering, organize_enrichment, strategy_comparison, conflict_names, dry_run_log, apply_plan, apply_plan_backup, apply_log, apply_chained, execution_summary,
    before_after)}

COLLECTED_SQL = """
wishes AS (
  SELECT f.seq, f.path, f.size, '/collected/' || d.lang || '/' || regexp_replace(f.name, '_[0-9]+(\\.[^.]*)$', '\\1')
         AS destination, '/collected/' || d.lang || '/' || f.name AS numbered
  FROM files f JOIN documents d ON d.doc_id = f.seq
)"""


def numbering_sql(wishes: str, existing: str) -> list[str]:
    """Free numbers for wishes when no wished name is a numbered form of another."""
    return [f"""
wish_parts AS (
  SELECT w.*, regexp_extract(destination, '[^/]*$') AS base,
         left(destination, length(destination) - length(regexp_extract(destination, '[^/]*$'))) AS folder,
         regexp_extract(regexp_extract(destination, '[^/]*$'), '.(\\.[^.]+)$', 1) AS ext,
         row_number() OVER (PARTITION BY destination ORDER BY seq)
         - CASE WHEN destination IN (SELECT path FROM {existing}) THEN 0 ELSE 1 END AS index
  FROM {wishes} w
), candidates AS (
  SELECT destination, k, folder || left(base, length(base) - length(ext)) || '_' || k || ext AS name
  FROM (SELECT DISTINCT destination, folder, base, ext FROM wish_parts WHERE index > 0),
       generate_series(1, (SELECT max(index) FROM wish_parts) + (SELECT count(*) FROM {existing})) g(k)
), free_names AS (
  SELECT destination, name, row_number() OVER (PARTITION BY destination ORDER BY k) AS index
  FROM candidates WHERE name NOT IN (SELECT path FROM {existing})
), resolved AS (
  SELECT w.seq, w.path, w.destination, w.size, CASE WHEN w.index = 0 THEN w.destination ELSE f.name END AS final
  FROM wish_parts w LEFT JOIN free_names f ON f.destination = w.destination AND f.index = w.index
)"""]


_TYPED = views._SQL_TYPE
STUB_DIRS_SQL = """
stub_categories AS (
  SELECT DISTINCT CASE WHEN asked THEN asked_category ELSE category END AS category FROM stub
), stub_dirs AS (
  SELECT sum(CASE WHEN category IN ('Work', 'Personal') THEN 2 ELSE 1 END) AS n FROM stub_categories
)"""

SQL = {
    "organize_rules": sql(FILES_SQL, KEYWORDS_SQL, RULES_PLAN_SQL, DUP_SQL, f"""
        keyed AS (
          SELECT path, {rules_case(keywords=True)} || '/' || name AS target_path FROM files LEFT JOIN keywords USING (seq)
        )""", """
        SELECT action_type, source, destination, reason, confidence FROM rules_plan WHERE action_type = 'create_dir'
        UNION ALL
        SELECT 'move', path, 'organized/' || target_path, 'Rule-based classification: ' || target_path, 1.0 FROM keyed
        UNION ALL
        SELECT action_type, source, NULL, reason, confidence FROM deletions"""),
    "organize_enrichment": sql(FILES_SQL, STUB_SQL, STUB_DIRS_SQL, DUP_SQL, """
        counts AS (
          SELECT (SELECT count(*) FROM files) AS moves, (SELECT count(*) FROM deletions) AS deletes,
                 (SELECT CAST(n AS BIGINT) FROM stub_dirs) AS dirs
        )""", """
        SELECT moves + deletes + dirs AS total_actions, moves AS files_to_move, deletes AS files_to_delete,
               dirs AS directories_to_create FROM counts"""),
    "strategy_comparison": sql(CLUSTERED_SQL, PROFILES_SQL, STUB_SQL, STUB_DIRS_SQL, """
        counts AS (
          SELECT 'rules' AS strategy, (SELECT count(*) FROM files) AS moves, 16::BIGINT AS dirs
          UNION ALL SELECT 'clustering', (SELECT count(*) FROM files),
            (SELECT count(DISTINCT name) FROM profiles)
            + (SELECT count(DISTINCT CASE WHEN c.label = -1 THEN 'u' WHEN p.label IS NULL THEN 's' END)
               FROM clustered c LEFT JOIN profiles p USING (label))
          UNION ALL SELECT 'enrichment', (SELECT count(*) FROM files), (SELECT CAST(n AS BIGINT) FROM stub_dirs)
        )""", """
        SELECT strategy, moves + dirs AS total_actions, moves AS files_to_move, 0::BIGINT AS files_to_delete,
               dirs AS directories_to_create FROM counts"""),
    "conflict_names": sql(FILES_SQL, COLLECTED_SQL, """
        shelf AS (SELECT numbered AS path FROM wishes WHERE seq IN (SELECT doc_id FROM labels))""",
        *numbering_sql("wishes", "shelf"), "SELECT seq, destination, final FROM resolved"),
    "dry_run_log": sql(FILES_SQL, RULES_PLAN_SQL, DUP_SQL, """
        SELECT seq, 'executed' AS status,
               CASE action_type WHEN 'create_dir' THEN '[DRY RUN] Would create directory: ' || destination
               ELSE '[DRY RUN] Would move: ' || regexp_extract(source, '[^/]*$') || ' → ' || destination END AS message
        FROM rules_plan
        UNION ALL
        SELECT seq, 'executed', '[DRY RUN] Would delete: ' || regexp_extract(source, '[^/]*$') || ' (' || reason || ')'
        FROM deletions"""),
    "apply_plan": sql(FILES_SQL, COLLECTED_SQL, DUP_SQL, """
        survivors AS (SELECT * FROM wishes WHERE path NOT IN (SELECT source FROM deletions))""",
        *numbering_sql("survivors", "files"), """
        results AS (SELECT seq, final AS path, regexp_replace(final, '/[^/]*$', '') AS parent_dir,
          regexp_extract(lower(regexp_extract(final, '[^/]*$')), '.(\\.[^.]+)$', 1) AS extension, size FROM resolved)""",
        f"SELECT *, {_TYPED} AS file_type FROM results"),
    "apply_plan_backup": sql(FILES_SQL, DUP_SQL, """
        SELECT seq, path, name, extension FROM files WHERE path NOT IN (SELECT source FROM deletions)
        UNION ALL
        SELECT f.seq, f.parent_dir || '/.backups/' || f.name || '.backup', f.name || '.backup', '.backup'
        FROM files f JOIN deletions d ON d.source = f.path"""),
    "apply_log": sql(FILES_SQL, COLLECTED_SQL, DUP_SQL, *numbering_sql("wishes", "files"), """
        SELECT seq, 'move' AS action_type, 'executed' AS status,
               'Moved: ' || regexp_extract(path, '[^/]*$') || ' → ' || final AS message FROM resolved
        UNION ALL SELECT seq, 'delete', 'executed', NULL FROM deletions"""),
    "apply_chained": sql(FILES_SQL, """
        SELECT coalesce(o.seq, f.seq) AS seq, f.path FROM files f LEFT JOIN files o ON o.seq = xor(f.seq, 1)
        UNION ALL SELECT seq, parent_dir || '/kept' FROM files"""),
    "execution_summary": sql(FILES_SQL, DUP_SQL, """
        counts AS (
          SELECT (SELECT count(*) FROM files WHERE seq IN (SELECT doc_id FROM labels)) AS failed,
                 (SELECT count(*) FROM files) + (SELECT count(*) FROM deletions) AS total
        )""", """
        SELECT total - failed AS executed, failed, round((total - failed) / total * 100, 6) AS success_rate
        FROM counts"""),
    "before_after": sql(FILES_SQL, DUP_SQL, """
        inventories AS (
          SELECT 'before' AS label, file_type, size, text FROM files
          UNION ALL
          SELECT 'after', file_type, size, text FROM files WHERE path NOT IN (SELECT source FROM deletions)
        ), groups AS (
          SELECT label, size, count(*) AS n FROM inventories GROUP BY label, size, sha256(text) HAVING count(*) > 1
        ), labels_seen AS (SELECT DISTINCT label FROM inventories)""", """
        SELECT label, 'files' AS metric, count(*)::DOUBLE AS value FROM inventories GROUP BY label
        UNION ALL SELECT label, 'total_mb', round(sum(size) / 1048576.0, 8) FROM inventories GROUP BY label
        UNION ALL SELECT label, 'type_' || file_type, count(*)::DOUBLE FROM inventories GROUP BY label, file_type
        UNION ALL SELECT label, 'duplicate_groups', count(size)::DOUBLE FROM labels_seen LEFT JOIN groups USING (label)
          GROUP BY label
        UNION ALL SELECT label, 'duplicate_files', coalesce(sum(n - 1), 0)::DOUBLE
          FROM labels_seen LEFT JOIN groups USING (label) GROUP BY label
        UNION ALL SELECT label, 'wasted_mb', round(coalesce(sum(size * (n - 1)), 0) / 1048576.0, 8)
          FROM labels_seen LEFT JOIN groups USING (label) GROUP BY label"""),
}
