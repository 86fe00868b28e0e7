import datetime
import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import file_rows
from filemason import fixed_values as V
from filemason.functions import paths as P
from filemason.functions import text as X
from filemason.operators import cluster_report, features, scan_filters, vectors

from filemason.catalog.views import as_of


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_paths(spark):
    names = {".bashrc": "", "a.TXT": ".txt", "a.tar.gz": ".gz", "noext": "", "trailing.": "", ".x.py": ".py"}
    files = file_rows(spark, list(names)).collect()
    assert {r["name"]: r["extension"] for r in files} == names
    assert one(spark, P.parent_dir(F.col("p")), p="/top") == "/"


def test_title_case(spark):
    assert one(spark, X.title_case(F.col("t")), t="q3_2024a über-plan") == "q3_2024a über-plan".title()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("aa bb the cc dd ee ff on ab abc abd xyz".split()), max_size=60))
def test_keywords_match_a_counter(spark, words):
    kept = [w for w in words if len(w) > 2 and w not in V.KEYWORD_STOP_WORDS]
    wanted = [w for w, _ in Counter(kept).most_common(3)]
    got = one(spark, X.top_keywords(X.words(F.col("t")), 3), t=" ".join(words) + " ")
    assert got == wanted


def test_text_features(spark):
    text = "Hello world\r\nsee http://x.y a@b.c\n" + "word " * 100
    plain = text.replace("\r\n", "\n")
    t = one(spark, features.text_features(F.col("t")), t=text)
    words = plain.lower().split()
    assert t["char_count"] == len(plain) and t["word_count"] == len(words) and t["line_count"] == plain.count("\n")
    assert abs(t["avg_word_length"] - sum(map(len, words)) / len(words)) < 1e-12
    assert t["unique_words"] == len(set(words)) and t["has_urls"] and t["has_emails"]
    assert t["content_preview"] == plain[:200] + "..."
    bounded = one(spark, features.text_features(F.col("t"), max_chars=5), t=text)
    assert bounded["char_count"] == 5
    assert one(spark, features.text_features(F.col("t")), t="")["has_content"] is False


def test_metadata_flags(spark):
    names = ["My File (2).txt", "report_v2.PDF", "SHOUT.TXT", "backup_2024-01-02", "scan_7", "screen shot.png"]
    got = {r["name"]: r["m"] for r in file_rows(spark, names).select("name", features.metadata_features(as_of()).alias("m")).collect()}
    assert got["My File (2).txt"]["has_version_pattern"] and got["My File (2).txt"]["word_count"] == 3
    assert got["report_v2.PDF"]["has_version_pattern"] and not got["report_v2.PDF"]["is_lowercase"]
    assert got["SHOUT.TXT"]["is_uppercase"]
    assert got["backup_2024-01-02"]["likely_backup"] and got["backup_2024-01-02"]["has_date_pattern"]
    assert got["scan_7"]["has_version_pattern"]
    assert got["screen shot.png"]["likely_screenshot"] and got["screen shot.png"]["has_spaces"]


def test_extractors_apply_by_type(spark):
    files = file_rows(spark, ["a.txt", "b.png"], text="some words here")
    out = features.extract_features(files, features.default_extractors(as_of())).orderBy("seq").collect()
    assert out[0]["features"]["textcontent"]["word_count"] == 3
    assert out[1]["features"]["textcontent"] is None and out[1]["features"]["contenthash"]["hash_algorithm"] == "sha256"


def test_filters(spark):
    files = file_rows(spark, ["a.txt", ".h.txt", "b.py", "c.md"], size=[1, 1, 5 << 20, 1],
                      modified_at=[datetime.datetime(2025, 11, d) for d in (1, 1, 30, 21)])
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(scan_filters.visible(files, "/in")) == ["a.txt", "b.py", "c.md"]
    assert names(scan_filters.visible(files, "/in", size_limit_mb=0)) == ["a.txt", "b.py", "c.md"]
    assert names(scan_filters.visible(files, "/in", include_hidden=True, size_limit_mb=5)) == [".h.txt", "a.txt", "b.py", "c.md"]
    assert names(scan_filters.visible(files, "/in", max_depth=0)) == []
    assert names(scan_filters.filtered(files, as_of(), min_age_days=10, max_age_days=0)) == [".h.txt", "a.txt", "c.md"]
    texts = files.withColumn("text", F.lit("t"))
    gated = lambda **bound: {r["name"]: r["g"] for r in texts.select("name", scan_filters.gated_text(**bound).alias("g")).collect()}
    assert gated(max_file_size_kb=50) == {"a.txt": "t", ".h.txt": "t", "b.py": "", "c.md": "t"}
    assert gated() == dict.fromkeys(["a.txt", ".h.txt", "b.py", "c.md"], "t")


def test_feature_matrix_and_projection(spark):
    files = file_rows(spark, [f"report_{i} notes.txt" for i in range(6)] + ["a.png", "b.zip"], text="alpha beta gamma alpha", size=list(range(8)))
    matrix, names = vectors.feature_matrix(files, as_of())
    assert len(matrix.first()["features"]) == len(names) and "log_size" in names and "date_dash" in names
    points, variance = vectors.project_2d(vectors.standardize(matrix))
    assert points.count() == 8 and 0 < sum(variance) <= 1.0 + 1e-9
    embedded = vectors.hashed_embeddings(files, F.col("text"), 16)
    assert len(embedded.first()["embedding"]) == 16
    lengths = vectors.model_embeddings(files, F.col("name"), lambda: (lambda t: __import__("numpy").array([[len(x)] for x in t], dtype="float32")))
    assert lengths.orderBy("seq").first()["embedding"] == [18.0]


def test_cluster_names(spark):
    cases = {
        0: (["budget_plan_a.txt", "budget_plan_b.txt"], "Budget_Plan_Document"),
        1: (["x1.png", "y2019.jpg"], "Dated_Image"),
        2: (["abcde1q.zip", "abcde2w.rar"], "Abcde_Archive"),
        3: (["qq.py", "zz.py"], "Cluster_Code"),
    }
    names = [n for ns, _ in cases.values() for n in ns]
    labels = [label for label, (ns, _) in cases.items() for _ in ns]
    files = file_rows(spark, names)
    tags = spark.createDataFrame(list(enumerate(labels)), "seq bigint, label int")
    got = {r["label"]: r["name"] for r in cluster_report.cluster_profiles(files.join(tags, "seq")).collect()}
    assert got == {label: name for label, (_, name) in cases.items()}


def test_cluster_plan_folders(spark):
    files = file_rows(spark, ["a1.txt", "a2.txt", "b.txt", "c.txt"])
    tags = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, -1)], "seq bigint, label int")
    plan = cluster_report.cluster_plan(files.join(tags, "seq")).collect()
    moves = {r["source"].split("/")[-1]: (r["destination"], r["confidence"]) for r in plan if r["action_type"] == "move"}
    assert moves["b.txt"] == ("Clustered/Small_Groups/b.txt", 0.5) and moves["c.txt"] == ("Clustered/Uncategorized/c.txt", 0.3)
    assert sum(r["action_type"] == "create_dir" for r in plan) == 3


def test_scan_filters_reach_the_parquet_scan(spark, tmp_path):
    file_rows(spark, ["a.txt", "b.py"]).write.parquet(str(tmp_path / "inventory"))
    stored = spark.read.parquet(str(tmp_path / "inventory"))
    df = scan_filters.filtered(stored, as_of(), extensions=[".txt", ".py"], min_age_days=30).where("size < 100").select("path")
    plan = df._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "In(extension" in pushed and "LessThanOrEqual(modified_at" in pushed
    assert "text" not in plan[plan.rindex("ReadSchema"):]


def test_first_rows_of_a_group_are_limited_before_the_shuffle(spark):
    df = cluster_report.cluster_samples(file_rows(spark, ["a.txt", "b.py"]).withColumn("label", F.col("seq") % 2))
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("flat", [False, True])
def test_tfidf_reads_each_text_two_or_three_times(spark, flat):
    rng = random.Random(4)
    word = lambda i, k: f"word{i}x{k}" if flat else rng.choice("abcdefghij") * 2 + str(rng.randint(0, 30))
    texts = [" ".join(word(i, k) for k in range(60 if flat else rng.randint(0, 60))) + " every" for i in range(80)]
    texts += ["", None, "every"]
    read = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(3)
    seen = F.udf(lambda t: (read.add(1), t)[1])(F.col("text"))
    found, names = vectors.tfidf(rows, seen, max_features=60)
    weights = {r["seq"]: {names[i]: w for i, w in zip(r["v"]["indices"], r["v"]["values"])} for r in found.select("seq", F.unwrap_udt("tfidf").alias("v")).collect()}
    assert read.value == (3 if flat else 2) * len(texts)
    words = [(t or "").split() for t in texts]
    terms = [Counter(w + [" ".join(p) for p in zip(w, w[1:])]) for w in words]
    total, held = sum(terms, Counter()), Counter(t for c in terms for t in c)
    best = sorted((t for t in total if held[t] <= 0.95 * len(texts)), key=lambda t: (-total[t], t))[:60]
    assert names == best and "every" not in best
    for i, c in enumerate(terms):
        w = {t: c[t] * (math.log((len(texts) + 1) / (held[t] + 1)) + 1) for t in best if t in c}
        norm = math.sqrt(sum(v * v for v in w.values()))
        assert weights[i].keys() == w.keys() and all(abs(weights[i][t] - v / norm) < 1e-9 for t, v in w.items())
