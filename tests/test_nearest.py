"""The k nearest vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filemason.operators import block_pairs, nearest


def table(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "seq bigint, vector array<double>")


def brute_force(vectors, k):
    first, number = {}, {}
    for i, v in enumerate(vectors):
        norm = np.linalg.norm(v)
        if norm > 0:
            key = tuple(v)
            first.setdefault(key, i)
            number[first[key]] = number.get(first[key], 0) + 1
    ids = sorted(number)
    units = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    found = {}
    for row, i in enumerate(ids):
        others = sorted((-round(float(c), 9), j) for c, j in zip(units @ units[row], ids) if j != i)[:k]
        found[i] = [(j, number[j], -c) for c, j in others]
    return found


def as_found(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["seq"], r["rank"])):
        found.setdefault(r["seq"], []).append((r["neighbour"], r["n"], round(r["cosine"], 9)))
        assert r["rank"] == len(found[r["seq"]])
    return found


def clouds(n, dims, centres, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return middle[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("block,pivots,slices", [(2048, 256, 32768), (16, 3, 20), (8, 256, 1000)])
def test_equals_all_pairs(spark, monkeypatch, block, pivots, slices):
    for name, value in (("BLOCK_ROWS", block), ("MAX_PIVOTS", pivots), ("SLICE_ROWS", slices)):
        monkeypatch.setattr(nearest, name, value)
    vectors = list(clouds(150, 6, 9, 1)) + list(np.random.default_rng(2).normal(size=(40, 6)))
    vectors += [vectors[3]] * 30 + [np.zeros(6)]
    assert as_found(nearest.nearest_vectors(table(spark, vectors), 5).collect()) == brute_force(vectors, 5)


def test_vectors_are_not_copied_for_the_cells_they_visit(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    written = {}

    def keep(df, label, write=nearest.materialize):
        kept = write(df, label)
        if label != "second" and "vector" in kept.columns:
            rows = F.octet_length("seq") / 8 if dict(kept.dtypes)["seq"] == "binary" else F.lit(1)
            written[label] = kept.agg(F.sum(rows)).first()[0]
        return kept

    for module in (nearest, block_pairs):
        monkeypatch.setattr(module, "materialize", keep)
    vectors = np.random.default_rng(4).normal(size=(300, 5))
    assert as_found(nearest.nearest_vectors(table(spark, vectors), 4).collect()) == brute_force(vectors, 4)
    assert len(written) > 2 and max(written.values()) <= 300


def test_ties_few_rows_and_none(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 2)
    axes = [np.eye(4)[i] for i in (0, 1, 2, 3)]  # all equally far apart
    assert as_found(nearest.nearest_vectors(table(spark, axes), 2).collect()) == brute_force(axes, 2)
    assert as_found(nearest.nearest_vectors(table(spark, axes), 9).collect()) == brute_force(axes, 9)
    assert nearest.nearest_vectors(table(spark, axes).limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        nearest.nearest_vectors(table(spark, axes), 0)


def test_cells_visited_grow_less_than_the_data(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 32)
    monkeypatch.setattr(nearest, "MAX_PIVOTS", 8)
    kept = {}
    keep = nearest.materialize
    monkeypatch.setattr(nearest, "materialize", lambda df, label: kept.setdefault(label, keep(df, label)))
    share = []
    for n in (1000, 4000):
        kept.clear()
        assert nearest.nearest_vectors(table(spark, clouds(n, 3, n // 20, 5)), 5).count() == 5 * n
        share.append(kept["visits"].count() / n / kept["cells"].count())
    assert share[1] < share[0] / 2
