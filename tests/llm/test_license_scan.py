"""Licence scan against its SQL, plain counting of base phrases, and planted licences."""

import random
import re

import duckdb
import pytest

from filemason.llm import license_scan, queries

from .conftest import TEXTS

RNG = random.Random(3)
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FILL = "stone river über light 日本 charge copy version house free nine".split()


def prose(n):
    return " ".join(RNG.choice(FILL) for _ in range(n))


def base(text):
    """Words, places of base phrases and their labels, one word at a time."""
    words = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def documents():
    rows = []
    for t in license_scan.TEMPLATES:  # whole, within prose, without its beginning, in other signs, cut, and shuffled
        words = t.words.split()
        shuffled = words[:]
        RNG.shuffle(shuffled)
        rows += [t.words, f"{prose(9)}. {t.words.title()}! {prose(30)}", " ".join(words[2:]) + " " + prose(5), "-".join(words).upper(),
                 " ".join(words[:len(words) // 2]), " ".join(shuffled)]
    rows += ["MIT License MIT license\nMIT\tLicense", "mit licenses", "the MIT. License; Apache, License: General Public License", None, "",
             " - ", prose(4000) + " mit license " + prose(4000), prose(50) + "\0MIT\x7fLicense", "MİT license K license", " ".join(["mit license"] * 3000)]
    return list(enumerate(rows)) + [(None, "a mit license"), (None, "a mit license"), (7, "Apache License")]


def test_equals_sql_and_plain_counts(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_license_scan(spark, str(tmp_path))
    got = sorted(map(tuple, found.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.SQL["op13_license_scan"]).fetchall(), key=repr)
    assert sorted((r[0], *r[1:6]) for r in got if r[0] is not None) == sorted((i, *base(t)) for i, t in rows if i is not None)


def test_planted_licences_and_clean_texts(spark):
    rows = [(10 * i + k, text) for i, t in enumerate(license_scan.TEMPLATES)
            for k, text in enumerate((f"{prose(40)} {t.words} {prose(7)}", prose(20) + " " + " ".join(t.words.split()[::-1])))]
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(license_scan.TEMPLATES):
        assert t.label in found[10 * i]["labels"].split(",") and found[10 * i]["score"] > 0.6
        assert found[10 * i + 1]["labels"] == "" and found[10 * i + 1]["score"] == 0
    two = " ".join(license_scan.TEMPLATES[i].words for i in (0, 8))
    row = license_scan.scan_licenses(spark.createDataFrame([(1, two)], "doc_id long, text string")).first()
    assert row["labels"] == "bsd,mit" and row["base_labels"] == "" and row["n_base"] == 0 and row["first_word"] is None


def test_phrases_decide(spark):
    template = license_scan.TEMPLATES[0]
    without = template.words.replace("free of charge", "for a charge")
    found = license_scan.scan_licenses(spark.createDataFrame([(1, without)], "doc_id long, text string")).first()
    assert found["labels"] == "" and found["score"] == 0


def test_messy_rows_and_no_python(spark, messy, nothing):
    found = license_scan.scan_licenses(messy)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"]) for r in found.collect()) == sorted((str(i), *base(t)[:2]) for i, t in TEXTS)
    assert license_scan.scan_licenses(nothing).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_ids_of_any_type(spark, kind):
    rows = spark.createDataFrame([("x1", "the MIT license")], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    assert license_scan.scan_licenses(rows).first()["n_base"] == 1
