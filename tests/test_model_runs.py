"""Model runs: kept results, cost limits while running, and the ledger of calls."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import file_rows
from filemason.operators import budget, enrich, usage
from filemason.operators.budget import Budget, LimitReached
from filemason.plans.organize import organize
from filemason.sources import cache_store, ledger
from filemason.sources.result_store import ResultStore



def now(day=1):
    return F.lit(f"2025-06-0{day}").cast("timestamp")


def counting(log):
    """A model that notes each prompt's file and answers with as many tokens as the file's text has letters."""
    def make_model():
        def model(prompts):
            with open(log, "a") as f:
                f.writelines(p.split("\n")[1] + "\n" for p in prompts)
            return [('{"summary": "s", "category": "Work", "topics": ["t"], "importance": "low", "suggested_folder": "Work", "confidence": 0.9}'
                     if "fails" not in p else "[]", p.split("\n")[2].count("x"), 10) for p in prompts]
        return model
    return make_model


def calls(log):
    try:
        with open(log) as f:
            return sorted(line.strip() for line in f)
    except FileNotFoundError:
        return []


def some_files(spark, n, lengths=None, modified=1):
    return file_rows(spark, [f"f{i}.txt" for i in range(n)], text=["x" * (lengths[i] if lengths else 5) for i in range(n)],
                     size=lengths or 5, modified_at=[datetime.datetime(2025, 1, modified if i == 0 else 1) for i in range(n)])


def test_second_run_calls_nothing(spark, tmp_path):
    log, store = str(tmp_path / "calls"), ResultStore(spark, str(tmp_path / "store"), buckets=8)
    run = lambda day=1: enrich.ModelRun(now(day), store, salt="m1", ttl_seconds=86400, ledger=str(tmp_path / "ledger"))
    go = lambda files, **o: organize(files, "llm", as_of=now(), find_duplicates=False, make_model=counting(log), **o)
    files = some_files(spark, 12)
    first = go(files, run=run()).where("action_type = 'move'").select("source", "destination", "confidence").collect()
    assert len(calls(log)) == 12
    again = go(files, run=run()).where("action_type = 'move'").select("source", "destination", "confidence").collect()
    assert len(calls(log)) == 12 and sorted(again) == sorted(first)
    go(some_files(spark, 12, modified=2), run=run()).count()  # one file has changed
    assert len(calls(log)) == 13
    go(files, run=run(3)).count()  # all results have expired
    assert len(calls(log)) == 25
    go(files, run=enrich.ModelRun(now(3), store, salt="m2")).count()  # another model
    assert len(calls(log)) == 37
    kept = ledger.read(spark, str(tmp_path / "ledger"))
    assert kept.count() == 25 and usage.totals(kept).first()["tokens"] == 25 * 15


def test_failures_are_not_kept(spark, tmp_path):
    log, store = str(tmp_path / "calls"), ResultStore(spark, str(tmp_path / "store"))
    files = file_rows(spark, ["a.txt", "b.txt", "c.png"], text=["fails", "x", "x"], size=1)
    for expected in (2, 3):
        got = {r["file_name"]: r["origin"] for r in enrich.summarize(files, counting(log), run=enrich.ModelRun(now(), store)).collect()}
        assert len(calls(log)) == expected and got["a.txt"] == got["c.png"] == "metadata"
    assert got["b.txt"] == "cache"


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=16)
    rows = lambda keys, value: spark.createDataFrame([(k, value, None, None) for k in keys], "key string, value string, timestamp timestamp, expires_at timestamp").withColumn("timestamp", now())
    assert store.read().count() == 0 and store.upsert(rows([], "x")) == 0
    keys = [f"k{i}" for i in range(300)]
    assert store.upsert(rows(keys, "1")) == 1
    before = store.manifest()["paths"]
    assert store.upsert(rows(["k7", "k7", "new"], "2")) == 2
    after = store.manifest()["paths"]
    assert len(before) == 16 and 1 <= sum(before[b] != after[b] for b in before) <= 2
    found = {r["key"]: r["value"] for r in store.read().collect()}
    assert len(found) == 301 and found["k7"] == found["new"] == "2" and found["k8"] == "1"
    assert store.read(1).where("key = 'new'").count() == 0  # the old version is still there
    assert ResultStore(spark, str(tmp_path / "store"), buckets=4).buckets == 16
    assert store.clear_old(keep=1) == 0 and store.versions() == [2]  # untouched buckets still use the first folder


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (ResultStore(spark, str(tmp_path / "store"), buckets=2) for _ in range(2))
    rows = lambda key: spark.createDataFrame([(key, "v", None, None)], "key string, value string, timestamp timestamp, expires_at timestamp")
    publish, raced = one._publish, []

    def late(version, paths):
        if not raced:
            raced.append(two.upsert(rows("b")))
        return publish(version, paths)

    one._publish = late
    assert one.upsert(rows("a")) == 2 and raced == [1]
    assert {r["key"] for r in one.read().collect()} == {"a", "b"}
    (tmp_path / "store" / "versions" / "v0000000003.json").write_text('{"version": 3')  # a writer that was lost
    assert one.manifest()["version"] == 2 and one.upsert(rows("c")) == 4
    assert {r["key"] for r in one.read().collect()} == {"a", "b", "c"}


LENGTHS = [40, 900, 5, 300, 300, 2000, 1, 70, 800, 60] * 4


@pytest.mark.parametrize("limit", [0.001, 0.02, 0.1, 0.25, 0.5])
def test_limit_stops_where_one_after_another_would(spark, tmp_path, limit):
    files = some_files(spark, len(LENGTHS), LENGTHS)
    spent, admitted = Decimal(0), []
    for i, n in enumerate(LENGTHS):
        if spent < Decimal(repr(limit)):
            admitted.append(i)
            spent += Decimal(n) / 1000 * Decimal("0.03") + Decimal(10) / 1000 * Decimal("0.06")
    budget = Budget(limit, "openai", "gpt-4", first_wave=4)
    found = enrich.summarize(files, counting(str(tmp_path / "calls")), run=enrich.ModelRun(now(), budget=budget, ledger=str(tmp_path / "ledger"))).collect()
    assert sorted(r["seq"] for r in found if r["origin"] == "model") == admitted and len(found) == len(LENGTHS)
    paid = usage.totals(ledger.read(spark, str(tmp_path / "ledger"))).first()
    assert abs(paid["cost_usd"] - budget.paid_usd) < 1e-9 and paid["calls"] == sum(budget.waves) == len(calls(str(tmp_path / "calls")))
    assert paid["calls"] <= len(admitted) + 4


def test_a_reached_limit_refuses_the_run(spark, tmp_path):
    files, log = some_files(spark, 3), str(tmp_path / "calls")
    run = lambda limit: enrich.ModelRun(now(), budget=Budget(limit, "openai", "gpt-4"), ledger=str(tmp_path / "ledger"))
    go = lambda limit: organize(files, "llm", as_of=now(), find_duplicates=False, make_model=counting(log), run=run(limit))
    with pytest.raises(LimitReached):
        go(0.0)
    assert go(0.0005).where("action_type = 'move'").count() == 3 and len(calls(log)) == 3
    with pytest.raises(LimitReached):
        go(0.0005)
    assert len(calls(log)) == 3
    none = some_files(spark, 3).withColumn("text", F.lit(""))
    assert organize(none, "llm", as_of=now(), find_duplicates=False, run=run(1.0)).where("action_type = 'move'").count() == 3


def test_folder_calls_are_metered(spark, tmp_path):
    folders = lambda: lambda ps: [('{"directories":["A"],"reasoning":"r"}', 100, 7) for _ in ps]
    run = enrich.ModelRun(now(), ledger=str(tmp_path / "ledger"))
    plan = organize(some_files(spark, 2), "llm", as_of=now(), find_duplicates=False, make_model=counting(str(tmp_path / "c")), folder_model=folders, run=run)
    assert plan.where("action_type = 'create_dir'").count() == 1
    assert sorted(r["prompt_tokens"] for r in ledger.read(spark, str(tmp_path / "ledger")).collect()) == [5, 5, 100]
    assert cache_store.statistics(ResultStore(spark, str(tmp_path / "s")).read(), now()).first()["total_entries"] == 0


def test_prompts_are_ranked_in_small_ranges(spark, monkeypatch):
    """One task must not read the prompts of a million files."""
    ranges = []
    for name in ("rank_in_group", "running_sum"):
        f = getattr(budget, name)
        monkeypatch.setattr(budget, name, lambda *a, f=f: ranges.append(a[5] if len(a) > 5 else a[4] if isinstance(a[4], int) else None) or f(*a))
    asked = spark.createDataFrame([(i * budget.CHUNK // 2, "x" * 4) for i in range(6)], "seq bigint, prompt string")
    paid = lambda rows: rows.withColumns({"prompt_tokens": F.lit(1000), "completion_tokens": F.lit(0)})
    admitted, _ = budget.answered_within(asked, Budget(0.0025, "openai", "gpt-3.5-turbo", first_wave=6), paid)
    found = sorted(r["seq"] for r in admitted.collect())
    assert found == [i * budget.CHUNK // 2 for i in range(len(found))] and 0 < len(found) < 6
    assert len(ranges) == 2 and all(r is not None and r <= 4096 for r in ranges)


def test_workers_hold_few_prompts(spark):
    rows = spark.range(4).select(F.col("id").alias("seq"), F.lit("File: a").alias("prompt"))
    answered = enrich.infer(rows, keep_prompt=False)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= enrich.PROMPTS_AT_ONCE
    assert answered.columns == ["seq", "answer", "prompt_tokens", "completion_tokens", "error"] and answered.count() == 4
    assert enrich.infer(rows).columns[:2] == ["seq", "prompt"]
