"""Greedy grouping, conflict numbering and clustering against small sequential models."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import file_rows
from filemason.catalog import views
from filemason.operators import block_pairs, clustering, near_duplicates, neighbours, pairing, ranking
from filemason.plans import conflicts


def greedy(items, alike):
    """seed of each item, the earliest ungrouped one taking all later ungrouped items alike."""
    seed = {}
    for i, a in enumerate(items):
        if i in seed:
            continue
        seed[i] = i
        for j in range(i + 1, len(items)):
            if j not in seed and alike(a, items[j]):
                seed[j] = i
    return seed


def near(a, b):
    (na, sa), (nb, sb) = a, b
    wa, wb = set(na.lower().split()), set(nb.lower().split())
    jac = 1.0 if not wa and not wb else len(wa & wb) / len(wa | wb)
    ratio = 1.0 if sa == sb == 0 else 0.0 if 0 in (sa, sb) else min(sa, sb) / max(sa, sb)
    return 0.7 * jac + 0.3 * ratio >= 0.8


def groups_of(seed):
    out = {}
    for i, s in seed.items():
        out.setdefault(s, set()).add(i)
    return {s: g for s, g in out.items() if len(g) > 1}


@pytest.mark.parametrize("peel,block", [(20_000, 4096), (3, 4)])
@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicate_groups(spark, monkeypatch, peel, block, seed):
    monkeypatch.setattr(pairing, "PEEL_ABOVE", peel)
    monkeypatch.setattr(pairing, "BLOCK_ROWS", block)
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "hot"]
    items = [(" ".join(rng.sample(words, rng.randint(1, 5))) + ".txt" * rng.randint(0, 1), rng.choice([0, 1, 5, 10, 12, 40]))
             for _ in range(70)]
    files = file_rows(spark, [n for n, _ in items], size=[s for _, s in items]).withColumn("file_type", F.lit("document"))
    got = near_duplicates.near_duplicate_groups(files).collect()
    found = {}
    for r in got:
        found.setdefault(r["seed_seq"], set()).add(r["seq"])
    assert found == groups_of(greedy(items, near))
    assert all(r["group_size"] == len(found[r["seed_seq"]]) for r in got)


@pytest.mark.parametrize("peel,block,threshold", [(20_000, 4096, 5), (3, 4, 5), (3, 4, 12)])
def test_similar_hashes(spark, monkeypatch, peel, block, threshold):
    monkeypatch.setattr(pairing, "PEEL_ABOVE", peel)
    monkeypatch.setattr(pairing, "BLOCK_ROWS", block)
    rng = random.Random(7)
    bases = [rng.getrandbits(64) for _ in range(4)]
    values = []
    for _ in range(60):
        h = rng.choice(bases)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randrange(64)
        values.append(h - (1 << 64) if h >= 1 << 63 else h)
    df = spark.createDataFrame(list(enumerate(values)), "seq bigint, hash bigint")
    got = {}
    for r in near_duplicates.similar_hash_groups(df, threshold).collect():
        got.setdefault(r["seed_seq"], set()).add(r["seq"])
    alike = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= threshold
    assert got == groups_of(greedy(values, alike))


def test_postings_are_never_broadcast(spark):
    keys = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(F.xxhash64(i, F.col("id") % 5).alias("key"), F.lit(0).alias("side")))
    nodes = spark.range(40).select(F.col("id").alias("seq"), F.struct("id").alias("item"), keys.alias("keys"))
    pairs = pairing.similar_pairs(nodes, lambda a, b: a["id"] % 5 == b["id"] % 5)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 5 * 28
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [4096, 4])
def test_most_similar_files(spark, monkeypatch, block):
    monkeypatch.setattr(pairing, "BLOCK_ROWS", block)
    rng = random.Random(block)
    words = ["a", "b", "c", "d", "hot"]
    names = [" ".join(["hot", *rng.sample(words, rng.randint(1, 4))]) + rng.choice([".txt", ".md"]) for _ in range(60)]
    files = file_rows(spark, names + names[:9], size=[rng.choice([0, 5, 6, 40]) for _ in names] + [7] * 9)
    pairs = near_duplicates.similar_files(files, 0.72).collect()
    wanted = {}
    for p in pairs:
        for a, b, n in ((p["seq_a"], p["seq_b"], p["n_b"]), (p["seq_b"], p["seq_a"], p["n_a"])):
            wanted.setdefault(a, []).append((-round(p["similarity"], 9), b, n))
    found = {}
    for r in near_duplicates.most_similar_files(files, 3, 0.72).orderBy("seq", "rank").collect():
        found.setdefault(r["seq"], []).append((-r["similarity"], r["other"], r["n"]))
        assert r["rank"] == len(found[r["seq"]])
    assert found == {a: sorted(x)[:3] for a, x in wanted.items()}
    assert near_duplicates.most_similar_files(files.limit(0), 3).count() == 0


def sequential_covered(edges):
    """Nodes under a seed when nodes are visited in order."""
    later, covered = {}, set()
    for lo, hi in edges:
        later.setdefault(lo, set()).add(hi)
    for node in sorted({x for e in edges for x in e}):
        if node not in covered:
            covered |= later.get(node, set())
    return covered


@pytest.mark.parametrize("seed", range(6))
def test_covered_equals_visiting_in_order(spark, monkeypatch, seed):
    monkeypatch.setattr(pairing, "PLAIN_ROUNDS", seed % 3)
    rng = random.Random(seed)
    edges = {(i, i + 1) for i in range(40)} | {tuple(sorted(rng.sample(range(60), 2))) for _ in range(5 + 20 * (seed % 2))}
    df = spark.createDataFrame(sorted(edges), "lo bigint, hi bigint")
    assert {r["seq"] for r in pairing._covered(df).collect()} == sequential_covered(edges)


def test_long_chain_settles_in_few_rounds(spark, monkeypatch):
    written = []
    keep = pairing.materialize
    monkeypatch.setattr(pairing, "materialize", lambda df, label: written.append(label) or keep(df, label))
    n = 10_000
    edges = spark.range(n - 1).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"))
    assert {r["seq"] for r in pairing._covered(edges).collect()} == set(range(1, n, 2))
    assert len(written) <= 30


@pytest.mark.parametrize("n", [10, 5000, 10**9])
def test_masks_cover_every_pair(n):
    rng = random.Random(n)
    masks = [m % (1 << 64) for m in near_duplicates.hash_masks(n, 5)]
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 5))
        assert any(m & flips == 0 for m in masks)


def test_thresholds_are_guarded(spark):
    files = file_rows(spark, ["a.txt"])
    with pytest.raises(ValueError):
        near_duplicates.near_duplicate_groups(files, 0.3)
    with pytest.raises(ValueError):
        near_duplicates.similar_files(files, 0.7)


def test_review_lists_name_every_member(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "REVIEW_LIST", 3)
    files = file_rows(spark, ["same name.txt"] * 5)
    groups = near_duplicates.near_duplicate_groups(files)
    assert groups.count() == 5
    first, second = near_duplicates.review_actions(groups).orderBy("seq").collect()
    assert first["reason"] == "Similar to: same name.txt, same name.txt, same name.txt"
    assert second["reason"] == "Similar to (part 2): same name.txt, same name.txt"
    assert {a["destination"] for a in (first, second)} == {"_Needs_Review/Similar_Files"}
    assert len(first["metadata"]["similar_group"]) == 3 and len(second["metadata"]["similar_group"]) == 2


def test_pair_joins_are_equi_joins(spark):
    files = file_rows(spark, ["a b.txt", "a b.txt", "c d.txt"], size=[1, 2, 3])
    for df in (near_duplicates.similar_files(files), near_duplicates.near_duplicate_groups(files)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_running_sums_cross_chunks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xxxy"), i * 3, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, at bigint, v bigint")
    got = {(r["g"], r["at"]): r["s"] for r in ranking.running_sum(df, ["g"], "at", F.col("v"), "s", chunk=16).collect()}
    sums = {"x": 0, "y": 0}
    for g, at, v in rows:
        sums[g] += v
        assert got[(g, at)] == sums[g]


def split(path):
    folder, _, name = path.rpartition("/")
    dot = name.rfind(".")
    stem, ext = (name, "") if dot <= 0 or dot == len(name) - 1 else (name[:dot], name[dot:])
    return folder, stem, ext


def numbered_in_turn(wishes, existing):
    taken, out = set(existing), []
    for w in wishes:
        path, k = w, 0
        folder, stem, ext = split(w)
        while path in taken:
            k += 1
            path = f"{folder}/{stem}_{k}{ext}"
        taken.add(path)
        out.append(path)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_conflict_numbers(spark, seed):
    rng = random.Random(seed)
    names = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "a_3_2.txt", "b", "b_1", "b_10", "_5.x", "c_01.md", "c.md", "c_2.md", ".h", "d.tar.gz"]
    wishes = ["/t/" + rng.choice(names) for _ in range(rng.choice([5, 40, 80]))]
    existing = ["/t/" + n for n in rng.sample(names + ["a_4.txt", "b_2", "b_3", "c_1.md", "d.tar_1.gz", "d.tar_3.gz"], 6)]
    w = spark.createDataFrame([(i * 2, d) for i, d in enumerate(wishes)], "order bigint, destination string")
    e = spark.createDataFrame([(p,) for p in existing], "path string")
    got = [r["final"] for r in conflicts.resolve(w, e, chunk=8).orderBy("order").collect()]
    assert got == numbered_in_turn(wishes, existing)


def test_many_wishes_for_one_name(spark):
    wishes = ["/t/x.txt"] * 300 + ["/t/x_7.txt", "/t/x.txt", "/t/y.txt"] + ["/t/y.txt"] * 50
    existing = ["/t/y_1.txt", "/t/y_2.txt", "/t/y_40.txt", "/t/x_9.txt"]
    w = spark.createDataFrame(list(enumerate(wishes)), "order bigint, destination string")
    e = spark.createDataFrame([(p,) for p in existing], "path string")
    got = [r["final"] for r in conflicts.resolve(w, e, chunk=16).orderBy("order").collect()]
    assert got == numbered_in_turn(wishes, existing)


def brute_dbscan(vectors, eps, min_samples):
    v = np.array(vectors, float)
    norm = np.linalg.norm(v, axis=1)
    unit = v / np.where(norm, norm, 1)[:, None]
    near = (1 - unit @ unit.T <= eps) & (norm > 0)[:, None] & (norm > 0)
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= min_samples
    labels, k = np.full(len(v), -1), 0
    for i in range(len(v)):
        if labels[i] != -1 or not core[i]:
            continue
        todo, labels[i] = [i], k
        while todo:
            p = todo.pop()
            for q in np.nonzero(near[p])[0]:
                if labels[q] == -1:
                    labels[q] = k
                    if core[q]:
                        todo.append(q)
        k += 1
    return labels.tolist()


@pytest.mark.parametrize("eps,min_samples,block", [(0.05, 3, 2048), (0.05, 3, 7), (0.4, 4, 9)])
def test_dbscan(spark, monkeypatch, eps, min_samples, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    rows = [(centres[rng.integers(5)] + rng.normal(size=6) * 0.25).tolist() for _ in range(80)]
    rows += [rows[0]] * 3 + [[0.0] * 6]
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, vector array<double>")
    got = [r["label"] for r in clustering.dbscan(df, eps, min_samples).orderBy("seq").collect()]
    assert got == brute_dbscan(rows, eps, min_samples)


@pytest.mark.parametrize("eps,min_samples,block,spots", [(0.3, 2, 4, 1024), (0.1, 5, 16, 2), (0.02, 3, 8, 1024)])
def test_spots_of_a_sample_leave_dbscan_exact(spark, monkeypatch, eps, min_samples, block, spots):
    """Vectors are never copied for the cells they meet: no table that is written has more of them than there are points."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "MAX_SPOTS", spots)
    written = {}

    def keep(df, label, write=neighbours.materialize):
        kept = write(df, label)
        if "vector" in kept.columns and label != "units":
            rows = F.octet_length("seq") / 8 if dict(kept.dtypes)["seq"] == "binary" else F.lit(1)
            written[label] = kept.agg(F.sum(rows)).first()[0]
        return kept

    for module in (neighbours, clustering, block_pairs):
        monkeypatch.setattr(module, "materialize", keep)
    rng = np.random.default_rng(7)
    rows = (rng.normal(size=(8, 6))[rng.integers(0, 8, 150)] + rng.normal(size=(150, 6)) * 0.2).tolist() + rng.normal(size=(60, 6)).tolist()
    rows += rows[:10] * 2
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, vector array<double>")
    got = [r["label"] for r in clustering.dbscan(df, eps, min_samples).orderBy("seq").collect()]
    assert got == brute_dbscan(rows, eps, min_samples)
    neighbours.cosine_neighbours(df, 0.2).count()
    assert len(written) > 1 and max(n for n in written.values() if n) <= 210


def test_cosine_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "seq bigint, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cos = unit @ unit.T
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60) if cos[i, j] >= 0.9}
    got = [(r["seq_a"], r["seq_b"]) for r in neighbours.cosine_neighbours(df, 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 8), (20, 21), (21, 20), (5, 6), (6, 7)]
    got = {r["seq"]: r["root"] for r in clustering.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 8)}, 8: 8, 9: 8, 10: 8, 20: 20, 21: 20}


def test_kmeans_and_bisecting_find_clear_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(3)[i % 3] * 10 + rng.normal(size=3) * 0.1).tolist()) for i in range(45)]
    df = spark.createDataFrame(rows, "seq bigint, vector array<double>")
    for labels in (clustering.cluster(df, "hierarchical", n_clusters=3), clustering.cluster(df, "kmeans", n_clusters=3)):
        found = {}
        for r in labels.collect():
            found.setdefault(r["label"], set()).add(r["seq"] % 3)
        assert len(found) == 3 and all(len(v) == 1 for v in found.values())
    with pytest.raises(ValueError):
        clustering.cluster(df, "other")


def test_dbscan_with_dense_spots(spark, monkeypatch):
    """A third of all points in one tight spot: they are never compared with each other."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    spot = rng.normal(size=5)
    rows = [(spot + rng.normal(size=5) * 0.01).tolist() for _ in range(60)] + rng.normal(size=(100, 5)).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, vector array<double>")
    points = neighbours.distinct_vectors(neighbours.unit_vectors(df))
    visited = neighbours.visits(points, 0.1)
    assert visited.where("dense").count() >= 60

    def compared(rows):
        sides = rows.groupBy("cell", "a", "b").agg(F.count_if(~F.col("probe")).alias("l"), F.count_if("probe").alias("r"))
        pairs = F.when(F.col("a") == F.col("b"), F.col("l") * (F.col("l") - 1) / 2).otherwise(F.col("l") * F.col("r"))
        return sides.agg(F.sum(pairs)).first()[0]

    assert compared(neighbours.blocks(visited)) - compared(neighbours.blocks(visited, skip_dense=True)) >= 60 * 59 / 2
    got = [r["label"] for r in clustering.dbscan(df, 0.1, 4).orderBy("seq").collect()]
    assert got == brute_dbscan(rows, 0.1, 4)


def test_one_name_with_many_sizes(spark, monkeypatch):
    """A key that holds most rows is thinned by its leaders instead of being paired."""
    monkeypatch.setattr(pairing, "PEEL_ABOVE", 20)
    sizes = [int(1.02 ** i * 10) for i in range(400)]
    random.Random(4).shuffle(sizes)
    items = [("hot name.txt", s) for s in sizes] + [("other thing.txt", s) for s in (1, 2, 3)]
    got = near_duplicates.near_duplicate_groups(file_rows(spark, [n for n, _ in items], size=[s for _, s in items]))
    found = {}
    for r in got.collect():
        found.setdefault(r["seed_seq"], set()).add(r["seq"])
    assert found == groups_of(greedy(items, near))


def test_rows_sent_to_cells_are_bounded():
    batches = [pd.DataFrame({"seq": range(n)}) for n in (10_000, 0, 3)]
    for copies in (1, 100, 10 * neighbours.SENT_ROWS):
        parts = list(neighbours.slices(iter(batches), copies))
        assert max(len(p) for p in parts) <= max(1, neighbours.SENT_ROWS // copies)
        assert [s for p in parts for s in p["seq"]] == [*range(10_000), 0, 1, 2]


def test_hashes_count_letters_of_whole_texts(spark, tmp_path, monkeypatch):
    """Bits by segments of characters, not bytes, and each text is read once however many letters are counted."""
    monkeypatch.setattr(views, "COUNTED_BYTES", 40)
    rng = random.Random(3)
    texts = ["", None, "a", "Straße naïve ÄÖÜ ß", "a" * 63, "İstanbul ainorstu " * 9, "日本 sort 語 unit"]
    texts += ["".join(rng.choice("ainorstu xyzé日🙂QA") for _ in range(rng.randrange(200))) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def hashed(text):
        text = (text or "").lower()
        width = max(1, -(-len(text) // 8))
        counts = [text[i * width:(i + 1) * width].count(c) for i in range(8) for c in "ainorstu"]
        bits = sum(1 << i for i, n in enumerate(counts) if n * 64 > sum(counts))
        return bits - (1 << 64) if bits >> 63 else bits

    rows = views.hashes(spark, str(tmp_path)).orderBy("seq")
    assert [tuple(r) for r in rows.collect()] == [(i, None if t is None else len(t.encode()), hashed(t)) for i, t in enumerate(texts)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
