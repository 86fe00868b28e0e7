"""Vector and clustering queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import cluster_report as R
from ..operators import clustering as C
from ..operators import nearest as NV
from ..operators import neighbours as NB
from ..operators import vectors as VE
from ..operators import ward as W
from . import views
from .inventory_queries import AGE_SQL
from .views import CLUSTERED_SQL, FILES_SQL, sql, sql_in


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))


def _metadata_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    return VE.feature_matrix(views.files(spark, sf_dir), views.as_of(), ["metadata"])


def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = VE.common_name_words(views.files(spark, sf_dir))
    return words.select("word", "n", F.col("first.seq").alias("first_seq"))


def metadata_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VE.long_form(views.files(spark, sf_dir), VE.metadata_columns(views.as_of())).withColumn("value", F.round("value", 6))


def name_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir)
    return VE.long_form(files, VE.name_pattern_columns(files))


def _vector_rows(vectors: DataFrame, names: list[str]) -> DataFrame:
    cells = vectors.select("seq", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    return cells.select("seq", F.get(F.array(*[F.lit(n) for n in names]), F.col("pos")).alias("feature"), "value")


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, names = _metadata_vectors(spark, sf_dir)
    return _vector_rows(VE.standardize(vectors), names).withColumn("value", F.round("value", 6))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero weights of the 1000 most frequent one- and two-word terms of the whole documents."""
    docs = views.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    vectors, names = VE.tfidf(docs, F.col("text"))
    sparse = F.unwrap_udt("tfidf")  # the terms of a document are few of the 1000
    cells = vectors.select("seq", F.explode(F.arrays_zip(sparse["indices"].alias("pos"), sparse["values"].alias("weight"))).alias("c"))
    terms = spark.createDataFrame(list(enumerate(names)), "pos int, term string")
    return cells.select("seq", "c.pos", "c.weight").where("weight > 0").join(F.broadcast(terms), "pos").select("seq", "term", F.round("weight", 6).alias("weight"))


def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = NB.cosine_neighbours(_embeddings(spark, sf_dir), 0.3)
    return pairs.select("seq_a", "seq_b", "n_a", "n_b", F.round("cosine", 6).alias("cosine"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of each one."""
    return NV.nearest_vectors(_embeddings(spark, sf_dir), 10).withColumn("cosine", F.round("cosine", 6))


def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dbscan(_embeddings(spark, sf_dir), eps=0.65, min_samples=2)


def dbscan_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With three samples per core point, so that clusters have border points."""
    return C.dbscan(_embeddings(spark, sf_dir), eps=0.65, min_samples=3)


def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_totals(dbscan(spark, sf_dir))


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kmeans(_embeddings(spark, sf_dir))


def bisecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bisecting(_embeddings(spark, sf_dir), 8)


def ward_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merge of the vectors by Ward's rule."""
    return W.ward_merges(_embeddings(spark, sf_dir)).select("a", "b", F.round("height", 6).alias("height"), "size")


def ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster by Ward's rule, as many clusters as by default."""
    return W.ward(_embeddings(spark, sf_dir)).select("seq", F.col("label").cast("long").alias("label"))


def pca_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = _metadata_vectors(spark, sf_dir)
    points, _ = VE.project_2d(VE.standardize(vectors))
    labels = views.clustered(spark, sf_dir).select("seq", F.col("name").alias("file_name"), "file_type", "label", "size")
    return points.join(labels, "seq")


def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_counts(views.clustered(spark, sf_dir))


def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_profiles(views.clustered(spark, sf_dir)).select(
        "label", "size", "name", "dominant_type", F.array_join("common_patterns", ",").alias("common_patterns"),
        F.round("avg_size", 6).alias("avg_size"), F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
        F.date_format("max_date", "yyyy-MM-dd").alias("max_date"), F.round("span_days", 6).alias("span_days"))


def cluster_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_plan(views.clustered(spark, sf_dir)).select("action_type", "source", "destination", "reason", "confidence")


def fallback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fallback_plan(views.files(spark, sf_dir)).select("action_type", "source", "destination", "reason", "confidence")


def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cluster_samples(views.clustered(spark, sf_dir))


def largest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.largest_cluster(views.clustered(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    common_words, metadata_vector, name_vector, standardised, tfidf, cosine_neighbours, nearest_vectors, dbscan, dbscan_dense,
    cluster_totals, kmeans, bisecting, pca_points, cluster_counts, cluster_profile, cluster_plan, fallback_plan,
    cluster_samples, largest_cluster, ward_merges, ward)}

NAME_WORDS_SQL = "list_filter(regexp_split_to_array(lower(name), '[_\\-\\s\\.]+'), lambda w: length(w) > 2)"
COMMON_WORDS_SQL = f"""
name_pieces AS (
  SELECT seq, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT seq, {NAME_WORDS_SQL} AS w FROM files)
), common_words AS (
  SELECT word, count(*) AS n, min(seq * 1000 + pos) AS first FROM name_pieces GROUP BY word
  HAVING count(*) >= 2 ORDER BY first LIMIT 20
)"""
_FLAG = "CAST({} AS INTEGER)::DOUBLE".format
METADATA_SQL = {
    "log_size": "ln(1 + size)", "age_days": AGE_SQL, "name_length": "length(name)::DOUBLE",
    "underscore_count": "(length(name) - length(replace(name, '_', '')))::DOUBLE",
    "dash_count": "(length(name) - length(replace(name, '-', '')))::DOUBLE",
    "space_count": "(length(name) - length(replace(name, ' ', '')))::DOUBLE",
    "is_upper": _FLAG("upper(name) = name AND lower(name) <> name"),
    "is_lower": _FLAG("lower(name) = name AND upper(name) <> name"),
    "has_digits": _FLAG("regexp_matches(name, '\\d')"),
    **{f"type_{t}": _FLAG(f"file_type = '{t}'") for t in V.FILE_TYPES},
    **{f"ext_{e}": _FLAG(f"extension = '{e}'") for e in V.ONE_HOT_EXTENSIONS},
}
METADATA_LONG_SQL = "metadata_long AS (" + " UNION ALL ".join(
    f"SELECT seq, '{n}' AS feature, {e} AS value FROM files" for n, e in METADATA_SQL.items()) + ")"


def tfidf_sql(stop_words: list[str]) -> str:
    return f"""
tokens AS (
  SELECT doc_id AS seq, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
         lambda w: w NOT IN {sql_in(stop_words)}) AS w
  FROM documents
), term_rows AS (
  SELECT seq, unnest(w) AS term FROM tokens
  UNION ALL
  SELECT seq, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tokens
), tf AS (
  SELECT seq, term, count(*) AS tf FROM term_rows GROUP BY seq, term
), vocab AS (
  SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS n FROM tf GROUP BY term
  HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY sum(tf) DESC, term LIMIT 1000
), weighted AS (
  SELECT seq, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN vocab USING (term)
)"""


def dbscan_sql(eps: float, min_samples: int) -> list[str]:
    return [f"""
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {eps}
), cores AS (
  SELECT vec_id AS seq FROM embeddings
  WHERE (SELECT count(*) FROM near WHERE a = vec_id) + 1 >= {min_samples}
), core_near AS (
  SELECT a, b FROM near WHERE a IN (SELECT seq FROM cores) AND b IN (SELECT seq FROM cores)
), reach AS (
  SELECT seq, seq AS other FROM cores
  UNION
  SELECT r.seq, n.b FROM reach r JOIN core_near n ON n.a = r.other
), core_labels AS (
  SELECT seq, dense_rank() OVER (ORDER BY min(other)) - 1 AS label FROM reach GROUP BY seq
), dbscan_labels AS (
  SELECT vec_id AS seq, CAST(coalesce(
    (SELECT label FROM core_labels c WHERE c.seq = vec_id),
    (SELECT min(label) FROM near JOIN core_labels c ON c.seq = b WHERE a = vec_id), -1) AS INTEGER) AS label
  FROM embeddings
)"""]


TITLE_SQL = """array_to_string(list_transform(regexp_extract_all({0}, '[a-zA-Z]+|[^a-zA-Z]+'),
               lambda r: upper(r[1]) || lower(r[2:])), '')""".format
PROFILES_SQL = f"""
label_words AS (
  SELECT label, word, count(*) AS n, min(seq * 1000 + pos) AS first FROM (
    SELECT label, seq, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT label, seq, {NAME_WORDS_SQL} AS w FROM clustered WHERE label <> -1))
  GROUP BY label, word
), label_top AS (
  SELECT label, list(word ORDER BY r) AS words FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, first) AS r FROM label_words)
  WHERE r <= 3 AND n >= 2 AND word NOT IN {sql_in(V.CLUSTER_NAME_STOP_WORDS)} GROUP BY label
), label_types AS (
  SELECT label, file_type, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(seq)) AS r
  FROM clustered GROUP BY label, file_type
), label_aggs AS (
  SELECT label, count(*) AS size, avg(size) AS avg_size, stddev_pop(size) AS spread,
         count(DISTINCT extension) AS n_ext, min(extension) AS ext, min(modified_at) AS min_date,
         max(modified_at) AS max_date, bool_or(regexp_matches(name, '\\d{{4}}')) AS dated
  FROM clustered WHERE label <> -1 GROUP BY label HAVING count(*) >= 2
), profiles AS (
  SELECT label, size,
         CASE WHEN words IS NOT NULL THEN {TITLE_SQL("array_to_string(words[1:2], '_')")}
              WHEN dated THEN 'Dated' ELSE 'Cluster' END || '_' || {TITLE_SQL("file_type")} AS name,
         file_type AS dominant_type,
         array_to_string(list_filter([
           CASE WHEN n_ext = 1 THEN 'all_' || ext || '_files' END,
           CASE WHEN size > 1 AND avg_size > 0 AND spread / avg_size < 0.5 THEN 'similar_size' END,
           CASE WHEN size > 1 AND max_date - min_date < INTERVAL 7 DAY THEN 'created_recently' END
         ], lambda p: p IS NOT NULL), ',') AS common_patterns,
         round(avg_size, 6) AS avg_size, strftime(min_date, '%Y-%m-%d') AS min_date,
         strftime(max_date, '%Y-%m-%d') AS max_date,
         round(epoch_us(max_date - min_date) / 86400e6, 6) AS span_days
  FROM label_aggs JOIN label_types USING (label) LEFT JOIN label_top USING (label) WHERE r = 1
)"""

SQL = {
    "common_words": sql(FILES_SQL, COMMON_WORDS_SQL, "SELECT word, n, first // 1000 AS first_seq FROM common_words"),
    "metadata_vector": sql(FILES_SQL, METADATA_LONG_SQL, "SELECT seq, feature, round(value, 6) AS value FROM metadata_long"),
    "name_vector": sql(FILES_SQL, COMMON_WORDS_SQL, """
        SELECT seq, 'pattern_' || (row_number() OVER (PARTITION BY seq ORDER BY first) - 1) AS feature,
               CAST(contains(lower(name), word) AS INTEGER)::DOUBLE AS value
        FROM files, common_words UNION ALL """ + " UNION ALL ".join(
        f"SELECT seq, '{n}', CAST(regexp_matches(name, '{p}') AS INTEGER)::DOUBLE FROM files"
        for n, p in V.DATE_FLAGS.items())),
    "standardised": sql(FILES_SQL, METADATA_LONG_SQL, """
        SELECT seq, feature, CASE WHEN s = 0 THEN 0 ELSE round((value - m) / s, 6) END AS value FROM (
          SELECT *, avg(value) OVER (PARTITION BY feature) AS m, stddev_samp(value) OVER (PARTITION BY feature) AS s
          FROM metadata_long)"""),
    "cosine_neighbours": """
        SELECT seq_a, seq_b, 1::BIGINT AS n_a, 1::BIGINT AS n_b, round(cosine, 6) AS cosine FROM (
          SELECT a.vec_id AS seq_a, b.vec_id AS seq_b,
                 list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine
          FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
        WHERE cosine >= 0.3""",
    "nearest_vectors": sql("""
        units AS (
          SELECT min(vec_id) AS seq, count(*) AS n, embedding::DOUBLE[] AS v FROM embeddings
          WHERE list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 GROUP BY embedding
        )""", """
        paired AS (
          SELECT a.seq, b.seq AS neighbour, b.n, list_cosine_similarity(a.v, b.v) AS cosine
          FROM units a JOIN units b ON a.seq <> b.seq
        )""", """
        SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY cosine DESC, neighbour)::INTEGER AS rank, neighbour, n,
               round(cosine, 6) AS cosine
        FROM paired QUALIFY rank <= 10"""),
    "dbscan": sql(*dbscan_sql(0.65, 2), "SELECT seq, label FROM dbscan_labels", recursive=True),
    "dbscan_dense": sql(*dbscan_sql(0.65, 3), "SELECT seq, label FROM dbscan_labels", recursive=True),
    "cluster_totals": sql(*dbscan_sql(0.65, 2), """
        SELECT count(DISTINCT label) FILTER (label <> -1) AS n_clusters, count(*) FILTER (label = -1) AS n_noise
        FROM dbscan_labels""", recursive=True),
    "cluster_counts": sql(CLUSTERED_SQL, "SELECT label, count(*) AS n_files FROM clustered GROUP BY label"),
    "cluster_profile": sql(CLUSTERED_SQL, PROFILES_SQL, "SELECT * FROM profiles"),
    "cluster_plan": sql(CLUSTERED_SQL, PROFILES_SQL, """
        moves AS (
          SELECT path AS source,
                 'Clustered/' || CASE WHEN c.label = -1 THEN 'Uncategorized' ELSE coalesce(p.name, 'Small_Groups') END AS folder,
                 c.name, CASE WHEN c.label = -1 THEN 'ML clustering: outlier file'
                      WHEN p.name IS NULL THEN 'ML clustering: small group'
                      ELSE 'ML clustering: grouped with ' || p.size || ' similar files' END AS reason,
                 CASE WHEN c.label = -1 THEN 0.3 WHEN p.name IS NULL THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence
          FROM clustered c LEFT JOIN profiles p USING (label)
        )""", """
        SELECT 'move' AS action_type, source, folder || '/' || name AS destination, reason, confidence FROM moves
        UNION ALL
        SELECT 'create_dir', '', 'Clustered/' || name,
               'ML cluster: ' || arg_min(size, label) || ' files, type: ' || arg_min(dominant_type, label), 1.0
        FROM profiles GROUP BY name
        UNION ALL
        SELECT DISTINCT 'create_dir', '', folder, 'ML clustering directory', 1.0 FROM moves
        WHERE folder IN ('Clustered/Uncategorized', 'Clustered/Small_Groups')"""),
    "fallback_plan": sql(FILES_SQL, f"""
        typed AS (SELECT *, 'ByType/' || {TITLE_SQL("file_type")} AS folder FROM files)""", """
        SELECT 'move' AS action_type, path AS source, folder || '/' || name AS destination,
               'Fallback: ' || file_type || ' file' AS reason, 0.6::DOUBLE AS confidence FROM typed
        UNION ALL
        SELECT DISTINCT 'create_dir', '', folder, 'Fallback: organize by file type', 1.0 FROM typed"""),
    "cluster_samples": sql(CLUSTERED_SQL, """
        SELECT label, rank, name, file_type, greatest(n - 3, 0) AS more_files FROM (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq) AS rank, count(*) OVER (PARTITION BY label) AS n
          FROM clustered WHERE label <> -1)
        WHERE rank <= 3"""),
    "largest_cluster": sql(CLUSTERED_SQL, """
        best AS (SELECT label, count(*) AS n_files FROM clustered WHERE label <> -1 GROUP BY label
                 ORDER BY n_files DESC, min(seq) LIMIT 1)""", """
        SELECT label, n_files, seq, name, file_type FROM clustered JOIN best USING (label) ORDER BY seq LIMIT 3"""),
}


SQL["tfidf"] = sql(tfidf_sql(V.ENGLISH_STOP_WORDS), """
    SELECT seq, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY seq)), 6) AS weight FROM weighted""")

#: All pairs of mutual nearest clusters merge in a round, until one is left.
WARD_SQL = ["""
ward_points AS (
  SELECT embedding::DOUBLE[] AS c, min(vec_id)::BIGINT AS id, count(*)::DOUBLE AS n FROM embeddings GROUP BY embedding
)""", """
ward_rounds AS (
  SELECT false AS merge, id, NULL::BIGINT AS b, n, c, NULL::DOUBLE AS height FROM ward_points
  UNION ALL
  (WITH live AS (SELECT id, n, c FROM ward_rounds WHERE NOT merge),
   near AS (
     SELECT x.id, min({'d': 2 * x.n * y.n / (x.n + y.n) * list_distance(x.c, y.c) ** 2, 'other': y.id}) AS best
     FROM live x JOIN live y ON x.id <> y.id GROUP BY x.id),
   pairs AS (
     SELECT x.id AS a, y.id AS b, x.best.d AS d FROM near x JOIN near y ON x.best.other = y.id AND y.best.other = x.id WHERE x.id < y.id),
   merged AS (
     SELECT a, b, d, l.n + r.n AS n, list_transform(list_zip(l.c, r.c), lambda z: (z[1] * l.n + z[2] * r.n) / (l.n + r.n)) AS c
     FROM pairs JOIN live l ON l.id = a JOIN live r ON r.id = b)
   SELECT false, id, NULL, n, c, NULL FROM live
   WHERE id NOT IN (SELECT a FROM pairs) AND id NOT IN (SELECT b FROM pairs) AND EXISTS (SELECT 1 FROM pairs)
   UNION ALL SELECT false, a, NULL, n, c, NULL FROM merged
   UNION ALL SELECT true, a, b, n, NULL, sqrt(d) FROM merged)
)"""]
SQL["ward_merges"] = sql(*WARD_SQL, """
    SELECT id AS a, b, round(height, 6) AS height, n::BIGINT AS size FROM ward_rounds WHERE merge""", recursive=True)
SQL["ward"] = sql(*WARD_SQL, """
    wanted AS (SELECT least(8, greatest(2, count(*) // 4)) AS k FROM embeddings)""", """
    kept AS (
      SELECT a, b FROM (SELECT id AS a, b, row_number() OVER (ORDER BY height DESC, id DESC, b DESC) AS n FROM ward_rounds WHERE merge), wanted
      WHERE n >= k)""", """
    climbs AS (
      SELECT id AS first, id AS root FROM ward_points
      UNION ALL SELECT first, a FROM climbs JOIN kept ON b = root)""", """
    roots AS (SELECT first, min(root) AS root FROM climbs GROUP BY first)""", """
    SELECT e.vec_id AS seq, dense_rank() OVER (ORDER BY root) - 1 AS label
    FROM embeddings e JOIN ward_points p ON p.c = e.embedding::DOUBLE[] JOIN roots r ON r.first = p.id""", recursive=True)
