"""Whitening against a plain eigendecomposition, and rank-one updates against numpy."""

import numpy as np
import pytest

from filemason.llm import whitening

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("kind", ["plain", "equal", "zeros", "tiny", "wide"])
def test_rank_one_updates(kind):
    for _ in range(60):
        d = int(RNG.integers(1, 40))
        values = np.sort(RNG.random(d) * 10)
        z = RNG.standard_normal(d)
        if kind == "equal":
            values[: d // 2] = values[0]
        if kind == "zeros":
            values[:], z[::3] = 0, 0
        if kind == "tiny":
            z *= 10.0 ** RNG.integers(-14, 1, d)
        if kind == "wide":
            values = np.sort(10.0 ** RNG.uniform(-12, 6, d))
        got, vectors = whitening.rank_one(values, z)
        whole = np.diag(values) + np.outer(z, z)
        size = max(1e-300, np.abs(np.linalg.eigvalsh(whole)).max())
        assert np.abs(got - np.linalg.eigvalsh(whole)).max() <= 1e-13 * size * d
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() <= 1e-12
        assert np.abs(whole @ vectors - vectors * got).max() <= 1e-13 * size * d


def test_spectra_of_parts_combine():
    rows = RNG.standard_normal((500, 12)) @ RNG.standard_normal((12, 12)) + 50
    whole = whitening.Spectrum(12)
    for part in np.array_split(rows, 7):
        s = whitening.Spectrum(12)
        for few in np.array_split(part, 3):
            s.add(few)
        whole.merge(s)
    centred = rows - rows.mean(axis=0)
    assert np.allclose(whole.values, np.linalg.eigvalsh(centred.T @ centred), rtol=1e-11, atol=1e-9) and whole.n == 500
    assert np.allclose(whole.mean, rows.mean(axis=0))
    assert np.allclose(whole.vectors * whole.values @ whole.vectors.T, centred.T @ centred)


def brute(rows, components=16):
    """For each row that takes part: (id, its deviation, its whitened entries up to their signs), and what is equal for all rows."""
    good = [(i, np.floor(64 * np.array(v, float)).astype(int) + 1_000_000) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in good]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    y = fit - total / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return [(i, int(((n * x - total) ** 2).sum()), (x - total / n) @ q / np.sqrt(e)) for i, x in good], n, e / np.trace(cov)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1.0, 2) for i, v in rows],
                                 "vec_id long, embedding array<float>, whitened double, n int").repartition(9)


def check(found, rows, components=16):
    want, n, explained = brute(rows, components)
    got = {}
    for r in found.collect():
        got.setdefault((r["vec_id"], r["deviation"], r["n"], r["identity_error"] < 1e-9), []).append((r["component"], r["whitened"], r["explained"]))
    repeats = max(1, len([1 for i, _, _ in want]) // max(1, len({(i, dev) for i, dev, _ in want})))
    assert repeats and set(got) == {(i, dev, n, True) for i, dev, _ in want}
    for i, dev, w in want:
        parts = sorted(set(got[i, dev, n, True]))
        assert [c for c, _, _ in parts] == list(range(1, len(w) + 1))
        assert np.allclose([abs(x) for _, x, _ in parts], np.abs(w), rtol=1e-9, atol=1e-9)
        assert np.allclose([x for _, _, x in parts], explained, rtol=1e-10)


def test_equals_a_plain_decomposition(spark):
    base = (RNG.standard_normal((700, 24)) @ np.diag(np.linspace(3, 0.4, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[5].tolist()) for i in range(300)]  # a third are copies
    rows += [(2000, None), (2001, [*base[0][:-1].tolist(), None]), (2002, [*base[0][:-1].tolist(), float("nan")]),
             (2003, [*base[0][:-1].tolist(), float("inf")]), (None, base[1].tolist()), (7, base[7].tolist()), (2004, [1.0, 2.0]), (2005, [])]
    plain = [r for r in rows if r[0] is None or r[0] < 2004]
    found = whitening.whiten(table(spark, rows))
    check(found, plain)
    assert found.count() == (700 + 300 + 2) * 16


def test_fewer_axes_and_no_rows(spark):
    flat = [(i, [float(i % 7), float(i % 3), 0.0, 5.0]) for i in range(60)]
    found = whitening.whiten(table(spark, flat))
    assert {r["component"] for r in found.collect()} == {1, 2}
    check(found, flat, components=2)
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, [(0, None), *few])).count() == 0


def test_query_on_given_vectors(spark):
    from filemason.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, sf), rows)
