"""Ranked lexical search against brute force and its SQL."""

import math
import random
import re
from collections import Counter

import pytest

from filemason.llm import lexical_search

from .conftest import TEXTS

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RNG = random.Random(5)
VOCABULARY = ["the", "a", *("".join(RNG.choice("abcdeé日") for _ in range(RNG.randint(1, 4))) for _ in range(60))]


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        wanted = Counter(t for text in {t for i, t in items if i == item} for t in terms(text))
        found = []
        for doc, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, n in wanted.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def text(n):
    return RNG.choice([" ", "-", "\n", "/"]).join(RNG.choice(VOCABULARY if RNG.random() < 0.7 else VOCABULARY[:3]) for _ in range(n))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("shape", [{}, {"owners": 1, "block": 1, "bundle": 3}, {"owners": 7, "block": 50, "bundle": 1}])
def test_equals_brute_force(spark, shape):
    docs = [(i, text(RNG.randint(0, 40))) for i in range(300)] + [(300 + i, "the same text in all of these") for i in range(80)]
    docs += [(None, "the same text in all of these"), (5, "The SAME text"), (5, "The SAME text"), (900, None), (901, ""), (902, text(5000))]
    items = [(i, text(RNG.randint(1, 12))) for i in range(12)] + [(50, "the the same TEXT"), (50, "the the same TEXT"), (51, None), (52, "unheard-of"),
                                                                 (53, "a"), (53, "the b"), (None, "text of a c")]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                                  spark.createDataFrame(items, "item_id long, text string"), k=20, **shape)
    assert rows(found) == sorted(brute(docs, items, 20), key=repr)


def test_messy_rows_and_other_ids(spark, messy, nothing):
    items = spark.createDataFrame([("x", "fox lazy text one", 3), ("y", "日本語 ΟΔΟΣ", 4)], "name string, text string, rank int")
    names = messy.selectExpr("'d' || doc_id as key", "text as body", "score", "id as rank")
    found = lexical_search.search(names, items, id_column="key", text="body", item_column="name")
    docs = [(None if i is None else f"d{i}", t) for i, t in TEXTS]
    assert rows(found) == sorted(brute(docs, [("x", "fox lazy text one"), ("y", "日本語 ΟΔΟΣ")], 20), key=repr)
    assert found.columns == ["name", "rank", "key", "score"]
    assert lexical_search.search(nothing, items, item_column="name").count() == 0
    assert lexical_search.search(messy, items.limit(0), item_column="name").count() == 0


def test_sql_and_query_agree(spark, tmp_path):
    import duckdb

    from filemason.llm import queries

    docs = [(i, text(RNG.randint(0, 30)) if i % 11 else None) for i in range(200)]
    items = [(i, text(6)) for i in range(20)]
    for name, table, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        spark.createDataFrame(table, f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(queries.SQL["op11_lexical_search"]).fetchall(), key=repr)
    assert want and rows(queries.op11_lexical_search(spark, str(tmp_path))) == want == sorted(brute(docs, items, 20), key=repr)
