import datetime

import pytest
from pyspark.sql import functions as F

from conftest import file_rows
from filemason.catalog.views import as_of
from filemason.operators import duplicates, enrich
from filemason.operators.folder_match import match_folders
from filemason.plans import actions as A
from filemason.plans import apply as AP
from filemason.plans import organize
from filemason.schemas import ACTIONS
from filemason.sources import cache_store


def plan_of(spark, *rows):
    return spark.createDataFrame([(i, *r, "why", 1.0, None) for i, r in enumerate(rows)], ACTIONS)


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_apply_orders_fails_and_numbers(spark):
    files = file_rows(spark, ["a.txt", "b.txt", "c.txt", "d.txt"])
    plan = plan_of(
        spark, ("delete", "/in/0/a.txt", None), ("move", "/in/0/a.txt", "/t/x.txt"), ("move", "/in/1/b.txt", "/t/x.txt"),
        ("move", "/in/1/b.txt", "/t/again.txt"), ("copy", "/in/2/c.txt", "/t/x.txt"), ("rename", "/in/2/c.txt", "/in/2/cc.txt"),
        ("move", "/none", "/t/none"), ("create_dir", "", "/t/dir"), ("move", "/in/3/d.txt", "/t/dir"))
    done = AP.apply_plan(files, plan)
    assert paths(done.files) == ["/in/2/cc.txt", "/t/dir/d.txt", "/t/x.txt", "/t/x_1.txt", "/t/x_2.txt"]
    log = done.log.orderBy("order").collect()
    assert [r["action_type"] for r in log] == ["create_dir", "copy"] + ["move"] * 5 + ["rename", "delete"]
    assert [r["status"] for r in log] == ["executed"] * 4 + ["failed", "failed"] + ["executed"] * 3
    assert log[2]["message"] == "Moved: a.txt → /t/x_1.txt" and log[-1]["message"] is None
    assert log[5]["message"] == "ERROR: Failed to execute MOVE: none → /t/none: Source file does not exist: /none"
    s = AP.execution_summary(done.log).first()
    assert (s["executed"], s["failed"]) == (7, 2) and abs(s["success_rate"] - 700 / 9) < 1e-9


def test_backups_and_dedupe_first(spark):
    files = file_rows(spark, ["same.txt", "same.txt", "other.txt"], text=["x", "x", "y"], size=1,
                      modified_at=[datetime.datetime(2025, 1, d) for d in (1, 2, 3)])
    plan = organize.organize(files, "rules", as_of())
    first = AP.apply_plan(files, AP.drop_moves_of_deleted(plan), backup=True)
    assert paths(first.files) == ["/in/0/.backups/same.txt.backup", "organized/Documents/General/other.txt", "organized/Documents/General/same.txt"]
    kept = AP.apply_plan(files, plan)
    assert paths(kept.files) == ["organized/Documents/General/other.txt", "organized/Documents/General/same.txt", "organized/Documents/General/same_1.txt"]


def test_dry_run_changes_nothing_and_reports(spark):
    files = file_rows(spark, ["a.txt"])
    plan = plan_of(spark, ("create_dir", "", "/t"), ("copy", "/in/0/a.txt", "/t/b"), ("rename", "/in/0/a.txt", "/in/0/z"),
                   ("delete", "/gone", None), ("delete", "/in/0/a.txt", None), ("move", "/gone", "/t/g"))
    log = AP.dry_run_log(plan, files).collect()
    assert [r["message"] for r in log if r["action_type"] in ("create_dir", "copy", "rename")] == [
        "[DRY RUN] Would create directory: /t", "[DRY RUN] Would copy: a.txt → /t/b", "[DRY RUN] Would rename: a.txt → z"]
    assert [r["message"] for r in log if r["action_type"] == "delete"] == [None, "[DRY RUN] Would delete: a.txt (why)"]
    assert [r["status"] for r in log if r["action_type"] == "move"] == ["failed"]


def test_empty_plan_succeeds(spark):
    log = spark.createDataFrame([], "status string")
    assert AP.execution_summary(log).first()["success_rate"] == 100.0


def test_exact_duplicates(spark):
    files = file_rows(spark, list("abcdefg"), size=[1, 1, 1, 0, 0, 2, 2], text=["x", "x", "y", "", "", "zz", None],
                      modified_at=[datetime.datetime(2025, 1, d) for d in (1, 1, 1, 5, 4, 1, 1)])
    groups = {}
    for r in duplicates.exact_duplicates(files).collect():
        groups.setdefault(r["group_id"], set()).add(r["name"])
    assert groups == {"/in/0/a": {"a", "b"}, "/in/3/d": {"d", "e"}}
    gone = duplicates.keep_newest(files).collect()
    assert {r["source"]: r["reason"] for r in gone} == {
        "/in/1/b": "Duplicate of a (keeping newer version from 2025-01-01 00:00)",
        "/in/4/e": "Duplicate of d (keeping newer version from 2025-01-05 00:00)"}
    s = duplicates.duplicate_stats(files).first()
    assert (s["duplicate_groups"], s["total_files_in_groups"], s["total_duplicates"], s["space_savings_percent"]) == (2, 4, 2, 50.0)
    assert duplicates.duplicate_stats(files.where("seq = 0")).first()["space_savings_percent"] == 0.0


def test_strategies(spark):
    files = file_rows(spark, ["meeting plan.txt", "family trip.txt", "x.py", "y.zip"], text="words", size=5)
    for strategy in ("rules", "ml", "llm"):
        plan = organize.organize(files, strategy, as_of(), find_duplicates=False)
        assert A.plan_summary(plan).first()["files_to_move"] == 4
    with pytest.raises(ValueError):
        organize.organize(files, "none", as_of())
    few = organize.organize(files.limit(1), "clustering", as_of(), find_duplicates=False).collect()
    assert {r["destination"] for r in few} == {"ByType/Document", "ByType/Document/meeting plan.txt"}
    none = organize.clustering_strategy(files, as_of(), feature_types=[])
    assert none.where("destination = 'ByType/Code/x.py'").count() == 1


@pytest.mark.parametrize("text,form,category,summary,confidence", [
    ('{"summary":"s","category":"Work","topics":["a"],"importance":"high","suggested_folder":"Work/Meetings","confidence":0.9}', "object", "Work", "s", 0.9),
    ('Sure: {"category":"Work"} done', "rescued", "Work", "", 0.7),
    ("no json here" * 20, "text", "General", ("no json here" * 20)[:100], 0.5),
    ("[1,2]", "not an object", "General", "", 0.7),
    ('a {broken} b', "text", "General", "a {broken} b", 0.5),
])
def test_answers(spark, text, form, category, summary, confidence):
    p = spark.createDataFrame([(text,)], "t string").select(enrich.parsed_answer(F.col("t"), summary_chars=100).alias("p")).first()["p"]
    assert (p["form"], p["category"], p["summary"], p["confidence"]) == (form, category, summary, confidence)


def test_model_calls(spark):
    def factory():
        def model(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("refused")
            return [("[1]" if "list" in p else '{"summary":"ok"}', 7, 3) for p in prompts]
        return model

    files = file_rows(spark, ["bad.txt", "fine.txt", "list.txt", "pic.png", "empty.txt"], text=["t", "t", "t", "t", ""], size=1)
    got = {r["file_name"]: r for r in enrich.summarize(files.coalesce(1), factory).collect()}
    assert got["fine.txt"]["summary"] == "ok" and got["fine.txt"]["prompt_tokens"] == 7
    assert got["bad.txt"]["summary"] == "document file: bad.txt" and got["bad.txt"]["confidence"] == 0.6
    assert got["list.txt"]["summary"] == "document file: list.txt"
    assert got["pic.png"]["suggested_folder"] == "Images" and got["empty.txt"]["prompt_tokens"] == 0


def test_prompts_can_be_bounded(spark):
    files = file_rows(spark, ["a.txt"], text="x" * 2001)
    whole, cut = files.select(enrich.analysis_prompt(F.col("text")).alias("w"),
                              enrich.analysis_prompt(F.col("text"), "by year", enrich.BOUNDED_PROMPT_CHARS).alias("c")).first()
    assert "x" * 2001 in whole and "x" * 2000 + "... [truncated]" in cut and "by year" in cut


def test_folder_matching(spark):
    rows = [(0, "work", ["budget"], "", "a"), (1, "family", [], "zzz", "b"), (2, "odd", ["none"], "", "c"), (3, "", [], "", "d")]
    s = spark.createDataFrame(rows, "seq bigint, category string, topics array<string>, suggested_folder string, file_name string")
    folders = ["Archive/Work", "Work/Budget", "Personal/Home"]
    listed = lambda fs: spark.createDataFrame(list(enumerate(fs)), "pos bigint, folder string")
    match = lambda fs: [r["folder"] for r in match_folders(s, listed(fs)).orderBy("seq").collect()]
    assert match(folders) == ["Work/Budget", "Personal/Home", "Documents", "Archive/Work"]
    assert match([]) == ["Documents"] * 4


def test_folder_matching_equals_scoring_every_folder(spark):
    """12 000 folders, and terms of any length, empty and repeated ones."""
    import random

    rng = random.Random(2)
    words = ["work", "home", "tax", "a", "be", "project", "Über", "archiv", "2024", "x_y", ""]
    folders = [f"{rng.choice(words)}{i}/{rng.choice(words)} {rng.choice(words)}" for i in range(12_000)]
    rows = [(i, rng.choice([*words, "Business", "family", "odd"]), [rng.choice(words).upper() for _ in range(rng.randrange(4))],
             rng.choice(["", "zzz", "77/", rng.choice(folders), *words]), "n") for i in range(300)]
    rows += [(900, None, None, None, "n")]
    s = spark.createDataFrame(rows, "seq bigint, category string, topics array<string>, suggested_folder string, file_name string")
    found = {r["seq"]: r["folder"] for r in match_folders(s, spark.createDataFrame(list(enumerate(folders)), "pos bigint, folder string")).collect()}
    lower = [f.lower() for f in folders]
    for seq, category, topics, suggested, _ in rows:
        c, t, g = "\0" if category is None else category.lower(), [x.lower() for x in topics or []], (suggested or "").lower()
        scores = [3 * (c in f) + 2 * sum(x in f for x in t) + 4 * (bool(g) and g in f) for f in lower]
        best = max(scores)
        by_name = "work" if c in ("work", "business", "professional") else "personal" if c in ("personal", "family", "home") else None
        want = folders[scores.index(best)] if best else next((f for f, x in zip(folders, lower) if by_name and by_name in x), "Documents")
        assert found[seq] == want


def test_folders_from_a_model(spark):
    rows = [(0, "Work", ["a"], "x", "n")]
    s = spark.createDataFrame(rows, "seq bigint, category string, topics array<string>, suggested_folder string, file_name string")
    good = lambda: lambda ps: [('{"directories":["A","B/C"],"reasoning":"r"}', 1, 1) for _ in ps]
    wrapped = lambda: lambda ps: [('Here: {"directories":["A"]}', 1, 1) for _ in ps]
    told = lambda model: [r["folder"] for r in enrich.propose_folders(s, model).orderBy("pos").collect()]
    assert told(good) == ["A", "B/C"] and told(wrapped) == ["Work/Projects", "Work/Documents"]


def test_folder_prompts_have_pages(spark, tmp_path):
    rows = [(i, f"Category {i}", ["t"], "x", f"n{i}") for i in range(5)]
    s = spark.createDataFrame(rows, "seq bigint, category string, topics array<string>, suggested_folder string, file_name string")
    pages = enrich.folder_prompt(s, per_page=2).orderBy("page").collect()
    assert [r["prompt"].count("Category") for r in pages] == [2, 2, 1] and "Category 4" in pages[2]["prompt"]

    def by_category():
        return lambda prompts: [('{"directories":["All",%s],"reasoning":"r"}' % ",".join(
            f'"{line[:-1]}"' for line in p.split("\n") if line.startswith("Category")), 1, 1) for p in prompts]

    found = enrich.propose_folders(s, by_category).orderBy("pos").collect()
    assert [r["folder"] for r in found] == ["All"] + [f"Category {i}" for i in range(5)]


def test_cache_split_routes(spark):
    files = file_rows(spark, ["a.txt", "b.txt"])
    now = as_of()
    cache = cache_store.entries(files.where("seq = 0"), cache_store.cache_key(), F.lit("{}"), now)
    hits, misses = cache_store.split(files, cache, now)
    assert [r["seq"] for r in hits.collect()] == [0] and [r["seq"] for r in misses.collect()] == [1]
    salted = cache_store.split(files, cache, now, cache_store.cache_key("other prompt"))
    assert salted[0].count() == 0
