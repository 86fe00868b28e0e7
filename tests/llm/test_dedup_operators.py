"""Line templates, near copies and repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from filemason.llm import line_templates, near_copies, substrings

from .conftest import TEXTS

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("aeioustrnl") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(words):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(words))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_recurring_templates_go(spark):
    notice = [f"Printed on page {n} of the yearly report" for n in range(40)]
    rows = [(i, "\n".join([prose(9), prose(12), notice[i], prose(7)])) for i in range(40)]
    copies = [(100 + i, rows[0][1]) for i in range(20)]  # copies of a document make none of its lines recurring
    owner = "{} holds all rights in this text and its parts"
    named = [(200 + i, "\n".join([prose(8), "Nobody else but " + owner.format(VOCABULARY[i]), prose(8)])) for i in range(12)]
    left = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs(spark, rows + copies + named), count_columns=True).collect()}
    for i, text in rows + copies:
        assert left[i]["text"] == "\n".join(x for x in text.split("\n") if not x.startswith("Printed")) and left[i]["n_dropped"] == 1
    for i, text in named:  # the varying word is no fixed part of the template
        assert left[i]["text"] == "\n".join(x for x in text.split("\n") if not x.startswith("Nobody"))


ABSOLUTE = line_templates.TemplateTree(absolute=True)


def test_frequent_lines_go_whatever_their_share(spark):
    header, footer, opening = "Welcome to the pages of our town", "Contact the office for more on this", "It was a dark and stormy night"
    site = [(i, "\n".join([header, "Home and news and people", prose(20), prose(15), footer])) for i in range(60)]
    half = [(100 + i, "\n".join(([opening] if i % 2 else [prose(9), opening]) + [prose(12), "Set in type by the old press"])) for i in range(60)]
    base = [prose(12) for _ in range(20)]
    near = [(200 + i, "\n".join(base[:i % 20] + [edited(base[i % 20], 2)] + base[i % 20 + 1:])) for i in range(60)]
    left = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, site + half + near), ABSOLUTE).collect()}
    for i, text in site:
        assert left[i] == "\n".join(text.split("\n")[2:4])
    for i, text in half:
        assert left[i] == "\n".join(x for x in text.split("\n") if x != opening and not x.startswith("Set in"))
    assert all(left[i] == text for i, text in near)  # near copies are no documents of their own


def test_leaf_with_several_templates(spark):
    forms = ["This page was made by {} for all readers here", "This page was last seen {} on some other day"]
    rows = [(i, "\n".join([prose(9), forms[i % 2].format(VOCABULARY[i]), prose(9)])) for i in range(40)]
    rows += [(100 + i, "\n".join([prose(9), "This page was " + prose(6), prose(9)])) for i in range(60)]
    left = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, rows), ABSOLUTE).collect()}
    assert all(left[i] == ("\n".join(text.split("\n")[::2]) if i < 100 else text) for i, text in rows)


def test_lines_of_messy_documents(spark, messy, nothing):
    left = line_templates.drop_recurring_lines(messy)
    assert left.columns == messy.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, messy.collect()))
    assert line_templates.drop_recurring_lines(nothing).count() == 0


def test_lines_equal_their_sql(spark, tmp_path):
    import duckdb

    rows = []
    for i in range(120):
        lines = [RNG.choice(VOCABULARY[:3]) + " " + prose(RNG.randint(1, 4)) for _ in range(RNG.randint(0, 4))]
        lines += [f"see {RNG.choice(VOCABULARY[:2])} number {RNG.randrange(99)} of the {RNG.choice(VOCABULARY[:9])} index"] * RNG.randrange(2)
        rows.append((i, "\n".join(lines) if RNG.random() < 0.95 else None))
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    tree = line_templates.TemplateTree(min_docs=3)
    got = line_templates.drop_recurring_lines(spark.read.parquet(str(tmp_path / "d")), tree, count_columns=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute("WITH " + line_templates.oracle_sql(tree) + " SELECT doc_id, n_lines, n_dropped, text FROM line_result").fetchall()
    found = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect())
    assert found == sorted(want) and sum(r[2] for r in found) > 20


def plain_classes(texts, least=0.8):
    shingles = near_copies.Shingles(np.zeros(near_copies.FREQUENCIES))
    words, counts = shingles.hashes(texts)
    bucket = (words & np.uint64(near_copies.FREQUENCIES - 1)).astype(np.int64)
    n_docs = np.bincount(np.unique(np.repeat(np.arange(len(counts)), counts) * near_copies.FREQUENCIES + bucket) % near_copies.FREQUENCIES,
                         minlength=near_copies.FREQUENCIES)
    shingles.rarity = 1 + np.log((1 + len(texts)) / (1 + n_docs)) / np.log(2 + len(texts))
    owner, h, w = shingles(texts)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [(h[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = len(sets[i][0]) and len(sets[j][0]) and near_copies.similarity(sets[i], sets[j]) >= least
            if root[i] != root[j] and (texts[i] == texts[j] or near):
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if x == b else x for x in root]
    return root


def edited(text, changes):
    words = text.split()
    for _ in range(changes):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY)
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 8, 16])
def test_near_copies_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = []
    for size in (1, 3, 2, 40):  # a group of many near copies at all similarities, chains among them
        base = prose(150)
        texts += [edited(base, RNG.randint(0, 6)) for _ in range(size)]
    texts += [prose(60) for _ in range(10)] + [texts[5], texts[5], "", "", " ", "a b", "a b c"]
    root = plain_classes(texts)
    rows = near_copies.near_copies(docs(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(root))
    assert all(r["n_copies"] == root.count(r["class_id"]) for r in rows)
    kept = near_copies.drop_near_copies(docs(spark, list(enumerate(texts)))).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(1, 2**63, 400, dtype=np.uint64), rng.integers(1, 2**63, (2, 100), dtype=np.uint64)
    weight = {int(h): rng.uniform(0.5, 6) for h in np.concatenate([shared, own.ravel()])}
    sets = []
    for k in range(2):
        h = np.sort(np.concatenate([shared, own[k]]))
        sets.append((h, np.array([weight[int(x)] for x in h]) * (1 if k else rng.uniform(0.8, 1.2, len(h)))))
    sampler = near_copies.Sampler(4000)
    a, b = (sampler(np.zeros(len(h), np.int64), h, w, 1)[0] for h, w in sets)
    assert abs((a == b).mean() - near_copies.similarity(*sets)) < 0.04


def test_near_copies_of_messy_documents(messy, nothing):
    rows = {(r["doc_id"], r["class_id"], r["n_copies"]) for r in near_copies.near_copies(messy).collect()}
    assert {(1, 1, 2), (5, 1, 2), (2, 2, 2), (3, 2, 2), (8, 8, 3), (9, 8, 3), (6, 6, 2), (10, 6, 2), (None, None, 1)} <= rows
    kept = near_copies.drop_near_copies(messy)
    assert kept.columns == messy.columns and kept.count() == 7
    assert near_copies.near_copies(nothing).count() == 0 and near_copies.drop_near_copies(nothing).count() == 0


def test_a_row_for_each_class_whatever_its_ids(spark):
    a, b, c, d, e = (prose(60) for _ in range(5))
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(None, b), (None, c), (None, b), (7, d), (7, e), (3, a), (5, near), (5, "z " + prose(60))]
    kept = [tuple(r) for r in near_copies.drop_near_copies(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, b), (None, c), (7, d), (7, e), (3, a), rows[-1]], key=str)


def plain_repeats(rows, length):
    seen, out = {}, []
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            key = raw[k:k + length]
            seen[key] = min(seen.get(key, i), i)
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1 << 18, 120])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    passages = [prose(n) for n in (8, 10, 20, 60)]
    rows = [(0, "ab" * 300), (1, "x" + "ab" * 200 + "y"), (2, "é" * 90), (3, "é" * 80), (3, "é" * 80)]
    for i in range(4, 60):
        parts = [prose(RNG.randint(0, 12)) for _ in range(3)]
        for _ in range(RNG.randrange(3)):
            p = RNG.choice(passages)
            a = RNG.randrange(len(p) // 2)
            parts.insert(RNG.randrange(4), p[a:a + RNG.randint(40, 300)])
        rows.append((i, " ".join(parts) if RNG.random() < 0.95 else None))
    rows.append((70, rows[10][1]))
    got = substrings.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == \
        plain_repeats(rows, 50)


def test_deep_shallow_order():
    for _ in range(40):
        width, base = RNG.choice([20, 40]), [bytes(RNG.choice(b"ab") for _ in range(40)) for _ in range(5)]
        strings = []
        for _ in range(RNG.randint(1, 200)):
            s = bytearray(RNG.choice(base)[:width])
            for _ in range(RNG.randint(0, 2)):
                s[RNG.randrange(width)] = RNG.choice(b"abc")
            strings.append(bytes(s))
        group = np.array([RNG.randint(0, 2) for _ in strings])
        order, classes = substrings.deep_shallow_classes(np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width), group)
        found = [(group[i], strings[i]) for i in order]
        assert found == sorted(found)
        assert all((a == b) == (x == y) for a, b, x, y in zip(found, found[1:], classes, classes[1:]))


def test_repeats_in_messy_documents(messy, nothing):
    rows = substrings.remove_repeats(messy, as_text=True).collect()
    byte_rows = {r["doc_id"]: r for r in rows}
    assert byte_rows[5]["kept"] == "" and byte_rows[1]["kept"] == TEXTS[0][1] and byte_rows[2]["n_bytes"] == 0
    assert byte_rows[10]["n_removed"] >= len(TEXTS[5][1]) and len(rows) == len(TEXTS)
    assert [c for c in rows[0].__fields__ if c not in ("n_bytes", "n_removed", "n_spans", "kept")] == [c for c in messy.columns if c != "kept"]
    assert substrings.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(messy, length=20)
