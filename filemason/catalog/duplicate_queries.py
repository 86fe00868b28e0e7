"""Exact, near and perceptual duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import near_duplicates as N
from ..plans import actions as A
from . import views
from .inventory_queries import PHASE_SQL, RULES_PLAN_SQL, rules_plan_frame
from .views import FILES_SQL, HASHES_SQL, TITLED_SQL, sql


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_duplicates(views.files(spark, sf_dir)).select("group_id", "seq", "path", "size", "content_hash", "n")


def same_size_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.same_size_only(views.files(spark, sf_dir)).select("seq", "size")


def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.duplicate_stats(views.files(spark, sf_dir))
    for c in ("total_size_mb", "wasted_space_mb", "space_savings_percent"):
        d = d.withColumn(c, F.round(c, 6))
    return d


def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.keep_newest(views.files(spark, sf_dir)).select("seq", "action_type", "source", "reason", "confidence")


def organize_plan_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compose(rules_plan_frame(spark, sf_dir), D.keep_newest(views.files(spark, sf_dir)))


def plan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_summary(organize_plan_frame(spark, sf_dir))


def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All actions of the plan with their phase, in execution order."""
    return A.ordered(organize_plan_frame(spark, sf_dir)).select(A.phase().alias("phase"), "seq", "action_type", "source")


def action_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organize_plan_frame(spark, sf_dir).select("seq", A.action_text().alias("action"))


def _titled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.near_duplicate_groups(views.titled(spark, sf_dir), 0.8)


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.near_duplicate_pairs(views.titled(spark, sf_dir), 0.8).withColumn("similarity", F.round("similarity", 6))


def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled_groups(spark, sf_dir).select(
        "seed_seq", "seq", "path", "group_size", F.round("similarity", 6).alias("similarity"))


def near_dup_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.review_actions(_titled_groups(spark, sf_dir)).select(
        "seq", "source", "destination", "reason", "confidence",
        F.array_join(F.element_at("metadata", "similar_group"), ",").alias("similar_group"))


def similar_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.similar_hash_groups(views.hashes(spark, sf_dir), 5)


def similar_hash_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.hashes(spark, sf_dir)
    return N.image_savings(N.similar_hash_groups(files, 5), files).select(
        "seed_seq", "n_images", F.round("avg_size", 6).alias("avg_size"), F.round("wasted_bytes", 6).alias("wasted_bytes"))


def file_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.similar_files(views.titled(spark, sf_dir), 0.9).withColumn("similarity", F.round("similarity", 6))


def file_similarity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other files of each one."""
    return N.most_similar_files(views.titled(spark, sf_dir), 5, 0.85).withColumn("similarity", F.round("similarity", 6))


QUERIES = {
    f.__name__: f for f in (
        exact_duplicates, same_size_files, duplicate_stats, keep_newest, plan_union, plan_order, action_text,
        near_dup_pairs, near_dup_groups, near_dup_review, similar_hash_groups, similar_hash_savings, file_similarity,
        file_similarity_top,
    )
}

DUP_SQL = """
prints AS (
  SELECT seq, path, name, size, modified_at, sha256(text) AS content_hash FROM files
), members AS (
  SELECT *, count(*) OVER g AS n, min(path) OVER g AS group_id,
         row_number() OVER (PARTITION BY size, content_hash ORDER BY modified_at DESC, seq) AS r,
         first_value(name) OVER (PARTITION BY size, content_hash ORDER BY modified_at DESC, seq) AS keep_name,
         max(modified_at) OVER g AS keep_modified
  FROM prints WINDOW g AS (PARTITION BY size, content_hash)
), deletions AS (
  SELECT seq, 'delete' AS action_type, path AS source,
         'Duplicate of ' || keep_name || ' (keeping newer version from '
         || strftime(keep_modified, '%Y-%m-%d %H:%M') || ')' AS reason, 0.95::DOUBLE AS confidence
  FROM members WHERE n > 1 AND r > 1
)"""
UNION_SQL = """
plan AS (
  SELECT seq, action_type, source, destination, reason FROM rules_plan
  UNION ALL SELECT seq, action_type, source, NULL, reason FROM deletions
)"""


def greedy_sql(nodes: str, pairs: str) -> list[str]:
    """Greedy earliest-first grouping over ``pairs(lo, hi)``: nodes are visited in order, and a node is a
    seed unless one of its earlier neighbours is."""
    return [f"""
earlier AS (
  SELECT hi AS seq, list(lo) AS los FROM {pairs} GROUP BY hi
), visited AS (
  SELECT seq, coalesce(los, []) AS los, row_number() OVER (ORDER BY seq) AS i
  FROM (SELECT lo AS seq FROM {pairs} UNION SELECT hi FROM {pairs}) LEFT JOIN earlier USING (seq)
), walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS seeds
  UNION ALL
  SELECT v.i, CASE WHEN list_has_any(w.seeds, v.los) THEN w.seeds ELSE list_append(w.seeds, v.seq) END
  FROM walk w JOIN visited v ON v.i = w.i + 1
), seeds AS (
  SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM walk ORDER BY i DESC LIMIT 1)
), grouped AS (
  SELECT n.seq, coalesce(min(p.lo), n.seq) AS seed_seq
  FROM {nodes} n LEFT JOIN (SELECT lo, hi FROM {pairs} JOIN seeds ON lo = seed) p ON p.hi = n.seq
  GROUP BY n.seq
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY seed_seq) AS group_size FROM grouped
)"""]


RATIO_SQL = """CASE WHEN a.size = 0 AND b.size = 0 THEN 1.0 WHEN a.size = 0 OR b.size = 0 THEN 0.0
               ELSE least(a.size, b.size)::DOUBLE / greatest(a.size, b.size) END"""
JACCARD_SQL = """len(list_intersect(a.words, b.words))::DOUBLE
               / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))"""
NEAR_SQL = f"0.7::DOUBLE * ({JACCARD_SQL}) + 0.3::DOUBLE * ({RATIO_SQL})"
NAMES_SQL = """
names AS (
  SELECT seq, path, name, size, extension, file_type, modified_at,
         list_distinct(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda w: w <> '')) AS words
  FROM titled
)"""
NEAR_GROUPS_SQL = [TITLED_SQL, NAMES_SQL, f"""
near_pairs AS (
  SELECT a.seq AS lo, b.seq AS hi FROM names a JOIN names b
    ON a.seq < b.seq AND {NEAR_SQL} >= 0.8::DOUBLE
)""", *greedy_sql("names", "near_pairs"), f"""
near_groups AS (
  SELECT s.seed_seq, s.seq, b.path, b.name, s.group_size, round({NEAR_SQL}, 6) AS similarity
  FROM sized s JOIN names a ON a.seq = s.seed_seq JOIN names b ON b.seq = s.seq
  WHERE group_size > 1
)"""]
HASH_GROUPS_SQL = [HASHES_SQL, """
hash_pairs AS (
  SELECT a.seq AS lo, b.seq AS hi FROM hashes a JOIN hashes b
    ON a.seq < b.seq AND bit_count(xor(a.hash, b.hash)) <= 5
)""", *greedy_sql("hashes", "hash_pairs")]

SCORED_SQL = ["""
profiles AS (
  SELECT min(seq) AS seq, count(*) AS n, list_sort(words) AS words, size, extension, file_type, modified_at
  FROM names GROUP BY list_sort(words), size, extension, file_type, modified_at
)""", f"""
scored AS (
  SELECT a.seq AS seq_a, b.seq AS seq_b, a.n AS n_a, b.n AS n_b,
         CASE WHEN a.file_type = b.file_type THEN 0.3::DOUBLE ELSE 0 END
         + CASE WHEN a.extension = b.extension THEN 0.2::DOUBLE ELSE 0 END
         + {JACCARD_SQL} * 0.3::DOUBLE
         + CASE WHEN a.size > 0 AND b.size > 0
                THEN least(a.size, b.size)::DOUBLE / greatest(a.size, b.size) ELSE 0 END * 0.1::DOUBLE
         + greatest(0, 1 - abs(epoch_us(a.modified_at) - epoch_us(b.modified_at)) / (30 * 86400e6)) * 0.1::DOUBLE
         AS similarity
  FROM profiles a JOIN profiles b ON a.seq < b.seq
)"""]

SQL = {
    "exact_duplicates": sql(FILES_SQL, DUP_SQL, """
        SELECT group_id, seq, path, size, content_hash, n FROM members WHERE n > 1"""),
    "same_size_files": sql(FILES_SQL, """
        SELECT seq, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)"""),
    "duplicate_stats": sql(FILES_SQL, """
        groups AS (SELECT size, count(*) AS n FROM files GROUP BY size, sha256(text) HAVING count(*) > 1)""", """
        SELECT count(*) AS duplicate_groups, CAST(sum(n) AS BIGINT) AS total_files_in_groups,
               CAST(sum(n) - count(*) AS BIGINT) AS total_duplicates,
               round(sum(size * n) / 1048576.0, 6) AS total_size_mb,
               round(sum(size * (n - 1)) / 1048576.0, 6) AS wasted_space_mb,
               round(sum(size * (n - 1)) / sum(size * n) * 100, 6) AS space_savings_percent
        FROM groups"""),
    "keep_newest": sql(FILES_SQL, DUP_SQL, "SELECT * FROM deletions"),
    "plan_union": sql(FILES_SQL, RULES_PLAN_SQL, DUP_SQL, UNION_SQL, """
        SELECT count(*) AS total_actions, count(*) FILTER (action_type = 'move') AS files_to_move,
               count(*) FILTER (action_type = 'delete') AS files_to_delete,
               count(*) FILTER (action_type = 'create_dir') AS directories_to_create FROM plan"""),
    "plan_order": sql(FILES_SQL, RULES_PLAN_SQL, DUP_SQL, UNION_SQL, f"""
        SELECT {PHASE_SQL} AS phase, seq, action_type, source FROM plan ORDER BY phase, seq"""),
    "action_text": sql(FILES_SQL, RULES_PLAN_SQL, DUP_SQL, UNION_SQL, """
        SELECT seq, CASE action_type
          WHEN 'move' THEN 'MOVE: ' || regexp_extract(source, '[^/]*$') || ' → ' || destination
          WHEN 'delete' THEN 'DELETE: ' || regexp_extract(source, '[^/]*$') || ' (' || reason || ')'
          ELSE 'CREATE: ' || destination || '/' END AS action FROM plan"""),
    "near_dup_pairs": sql(TITLED_SQL, NAMES_SQL, """
        profiles AS (SELECT min(seq) AS seq, count(*) AS n, list_sort(words) AS words, size FROM names GROUP BY list_sort(words), size)""", f"""
        SELECT a.seq AS seq_a, b.seq AS seq_b, a.n AS n_a, b.n AS n_b, round({NEAR_SQL}, 6) AS similarity
        FROM profiles a JOIN profiles b ON a.seq < b.seq AND {NEAR_SQL} >= 0.8::DOUBLE"""),
    "near_dup_groups": sql(*NEAR_GROUPS_SQL, """
        SELECT seed_seq, seq, path, group_size, similarity FROM near_groups""", recursive=True),
    "near_dup_review": sql(*NEAR_GROUPS_SQL, """
        SELECT seed_seq AS seq, arg_min(path, seq) AS source, '_Needs_Review/Similar_Files' AS destination,
               'Similar to: ' || string_agg(name, ', ' ORDER BY seq) AS reason, 0.6::DOUBLE AS confidence,
               string_agg(path, ',' ORDER BY seq) AS similar_group
        FROM near_groups GROUP BY seed_seq""", recursive=True),
    "similar_hash_groups": sql(*HASH_GROUPS_SQL, """
        SELECT seed_seq, group_size, s.seq, bit_count(xor(a.hash, b.hash))::INTEGER AS distance
        FROM sized s JOIN hashes a ON a.seq = s.seq JOIN hashes b ON b.seq = s.seed_seq
        WHERE group_size > 1""", recursive=True),
    "similar_hash_savings": sql(*HASH_GROUPS_SQL, """
        SELECT seed_seq, count(*) AS n_images, round(avg(size), 6) AS avg_size,
               round(avg(size) * (count(*) - 1), 6) AS wasted_bytes
        FROM sized JOIN hashes USING (seq) WHERE group_size > 1 GROUP BY seed_seq""", recursive=True),
    "file_similarity": sql(TITLED_SQL, NAMES_SQL, *SCORED_SQL, """
        SELECT seq_a, seq_b, n_a, n_b, round(similarity, 6) AS similarity FROM scored
        WHERE similarity >= 0.9::DOUBLE"""),
    "file_similarity_top": sql(TITLED_SQL, NAMES_SQL, *SCORED_SQL, """
        sides AS (
          SELECT seq_a AS seq, seq_b AS other, n_b AS n, round(similarity, 9) AS similarity FROM scored
          UNION ALL SELECT seq_b, seq_a, n_a, round(similarity, 9) FROM scored
        )""", """
        SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY similarity DESC, other)::INTEGER AS rank, other, n,
               round(similarity, 6) AS similarity
        FROM sides WHERE similarity >= 0.85::DOUBLE QUALIFY rank <= 5"""),
}
