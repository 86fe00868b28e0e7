"""The quality classifier and the neighbour search, and the pipeline over a small corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filemason.llm import neighbour_search, quality

from .test_dedup_operators import docs, prose

RNG = random.Random(3)


def corpus(n=240):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = prose(60).split()
        kind = i % 2
        text = " ".join(words) if not bad else " | ".join(words) if kind else " ".join(w for w in words[:9] for _ in range(9))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_labels_are_found(spark):
    rows, labels = corpus()
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    scored = quality.score_quality(docs(spark, rows), known, quality.learnt_from)
    held = scored.where(~quality.learnt_from(F.col("doc_id"))).collect()
    assert len(held) > 20
    right = sum((r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held)
    assert right >= 0.95 * len(held)
    # labels that may not be learnt change nothing
    flipped = known.withColumn("quality", F.when(quality.learnt_from(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    again = quality.score_quality(docs(spark, rows), flipped, quality.learnt_from)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))


def test_scores_of_messy_documents(spark, messy, nothing):
    rows, labels = corpus(60)
    known = spark.createDataFrame([*labels, (1, None), (None, 1), (999, 0), (2, 0), (2, 1)], "doc_id long, quality int")
    scored = quality.score_quality(messy, known, quality.learnt_from)
    found = scored.collect()
    assert scored.columns == [c for c in messy.columns if c != "score"] + ["score"]
    assert len(found) == messy.count() and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 5)}) == 1 and len({r["score"] for r in found if r["doc_id"] in (2, 3)}) == 1
    assert quality.score_quality(nothing, known, quality.learnt_from).count() == 0
    assert {r["score"] for r in quality.score_quality(messy, known.limit(0), quality.learnt_from).collect()} == {0.5}


def test_the_driver_fits_no_sample(spark, monkeypatch):
    def refuse(*_):
        raise MemoryError("the latent space is fitted on the driver")
    rows, labels = corpus(60)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    monkeypatch.setattr(np.linalg, "eigh", refuse)  # the tasks run in processes of their own
    assert quality.score_quality(docs(spark, rows), known, quality.learnt_from).where("score between 0 and 1").count() == 60


def test_bounded_voters_keep_the_ratio_of_labels(spark):
    rows = [(i, prose(30)) for i in range(700)]  # the texts tell nothing of the labels, which are 6 to 1
    known = spark.createDataFrame([(i, int(i % 7 > 0)) for i, _ in rows], "doc_id long, quality int")
    mean = [quality.score_quality(docs(spark, rows), known, quality.learnt_from, labelled_rows=n).agg(F.avg("score")).first()[0] for n in (4096, 60)]
    assert abs(mean[0] - 6 / 7) < 0.05 and abs(mean[0] - mean[1]) < 0.1


def brute(vectors, asks, k):
    out = {}
    for i in asks:
        scores = sorted((-float(np.dot(np.float64(vectors[i]), np.float64(v))), j) for j, v in vectors.items() if j != i)
        out[i] = [j for _, j in scores[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(neighbour_search, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbour_search, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 32)) * (rng.uniform(0.2, 3, (1500, 1)) if scale else 1)
    vectors = dict(enumerate(x.astype(np.float32).tolist()))
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    rows = neighbour_search.search(frame, F.col("vec_id") % 20 == 0, 10).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float(np.dot(np.float64(vectors[r["query_id"]]), np.float64(vectors[r["vec_id"]])))) < 1e-9
    want = brute(vectors, range(0, 1500, 20), 10)
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    assert np.mean([len(set(found[i]) & set(want[i])) / 10 for i in want]) >= 0.9


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [0.5, 2.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (20, [-1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    found = sorted(tuple(r) for r in neighbour_search.search(frame, F.col("vec_id") % 20 == 0, 3).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5), (20, 1, 8, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    assert neighbour_search.search(frame.limit(0), F.lit(True)).count() == 0
    assert neighbour_search.search(frame.where("vec_id = 0"), F.lit(True)).count() == 0


def test_different_vectors_with_equal_scores(spark):
    rng = np.random.default_rng(8)
    vectors = {i: rng.integers(0, 2, 10).astype(float).tolist() for i in range(400)}
    vectors = {i: v for i, v in vectors.items() if any(v)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    rows = neighbour_search.search(frame, F.col("vec_id") % 20 == 0, 5, margin=50.0).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == brute(vectors, [i for i in vectors if i % 20 == 0], 5)


def test_pipeline_over_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(150)
    passage = prose(70)
    rows = [(i, t + ("\n" + f"Issue {i} of the weekly paper\n" + prose(3) if i % 3 else "")) for i, t in rows]
    rows += [(500, rows[1][1]), (501, prose(40) + " " + passage + " " + prose(40)), (502, prose(50) + " " + passage + " " + prose(30)),
             (503, None), (504, ""), (None, prose(30))]
    frame = docs(spark, rows).withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit(1), "kept": F.lit("k")})
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in at.collect()}
        if name != "packing":
            assert at.columns == frame.columns
            assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in at.collect())
    good = {i for i, q in labels if q}
    assert good | {500, 501, 502, None} <= seen["quality classifier"].keys() and len(seen["quality classifier"].keys() & {i for i, q in labels if not q}) <= 2
    assert not any("weekly paper" in (r["text"] or "") for r in seen["line dedup"].values())
    assert 500 not in seen["near copies"] and good <= seen["near copies"].keys()
    assert passage in seen["substring dedup"][501]["text"] and passage[5:] not in seen["substring dedup"][502]["text"]
    assert seen["packing"].keys() == seen["substring dedup"].keys()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
