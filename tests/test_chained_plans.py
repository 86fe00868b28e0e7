"""Plans whose actions depend on each other, against running them one after another."""

import random
import re

import pytest
from pyspark.sql import functions as F

from filemason.functions import paths as P
from filemason.plans import apply as AP
from filemason.plans import chains
from filemason.schemas import ACTIONS

PHASES = ["create_dir", "copy", "move", "rename", "delete"]


def one_after_another(existing, actions):
    """(path -> origin at the end, status of each action by its number)."""
    held, status = {p: p for p in existing}, {}
    for seq, kind, source, target in sorted(actions, key=lambda a: (PHASES.index(a[1]), a[0])):
        if source not in held:
            status[seq] = "executed" if kind == "delete" else "failed"
            continue
        status[seq] = "executed"
        if kind == "delete":
            del held[source]
            continue
        final, number = target, 0
        folder, name = target.rsplit("/", 1)
        ext = (re.search(r".(\.[^.]+)$", name) or [None, ""])[1]
        while final in held:
            number += 1
            final = f"{folder}/{name[:len(name) - len(ext)]}_{number}{ext}"
        origin = held[source] if kind == "copy" else held.pop(source)
        held[final] = origin
    return held, status


def inventory(spark, paths):
    rows = [(i, p, p, 1) for i, p in enumerate(paths)]
    return P.with_path_columns(spark.createDataFrame(rows, "seq bigint, path string, was string, size bigint"))


def plan_of(spark, actions):
    return spark.createDataFrame([(seq, kind, source, target, "why", 1.0, None) for seq, kind, source, target in actions], ACTIONS)


def test_components_of_names_are_found_by_hashes_that_may_collide(spark, monkeypatch):
    """Paths don't travel through the rounds, and families that share a hash come out as they do apart."""
    types, plain = [], chains.components
    monkeypatch.setattr(chains, "components", lambda links: types.extend(t for _, t in links.dtypes) or plain(links))
    monkeypatch.setattr(chains, "_hashed", lambda name: F.xxhash64(name) % 3, raising=False)
    existing, actions = [], []
    for i in range(30):
        existing += [f"/p{i}/{n}" for n in ("a", "b", "b_1")]
        swap = [("a", "c"), ("b", "a"), ("c", "b"), ("b_1", "b"), ("a", "a")]
        actions += [(5 * i + k, "move", f"/p{i}/{x}", f"/p{i}/{y}") for k, (x, y) in enumerate(swap)]
    held, _ = one_after_another(existing, actions)
    done = AP.apply_plan(inventory(spark, existing), plan_of(spark, actions))
    assert {r["path"]: r["was"] for r in done.files.collect()} == held
    assert types == ["bigint", "bigint"]


def test_random_plans(spark):
    """200 plans, each among names of its own folder, in one run."""
    rng = random.Random(12)
    names = ["a", "a_1", "a_2", "a_3", "a_1_1", "a_1_2", "b", "b_1", "x.txt", "x_1.txt", "x_2.txt", "x_1_1.txt", "c", "d"]
    existing, actions = [], []
    for i in range(200):
        pick = lambda: f"/p{i}/{rng.choice(names)}"  # noqa: E731, B023
        existing += sorted({pick() for _ in range(rng.randint(1, 8))})
        for _ in range(rng.randint(1, 9)):
            kind = rng.choice(["copy", "move", "move", "move", "rename", "delete"])
            actions.append((len(actions), kind, pick(), None if kind == "delete" else pick()))
    held, status = one_after_another(existing, actions)
    done = AP.apply_plan(inventory(spark, existing), plan_of(spark, actions))
    assert {r["path"]: r["was"] for r in done.files.collect()} == held
    assert done.files.count() == len(held)
    assert {r["seq"]: r["status"] for r in done.log.collect()} == status


def test_the_freed_name_is_taken(spark):
    files = inventory(spark, ["/t/a", "/t/b", "/t/x/a1"])
    plan = plan_of(spark, [(0, "move", "/t/a", "/t/x/a1"), (1, "move", "/t/b", "/t/a"), (2, "move", "/t/x/a1", "/t/y/a")])
    done = AP.apply_plan(files, plan)
    assert {r["path"]: r["was"] for r in done.files.collect()} == {"/t/a": "/t/b", "/t/x/a1_1": "/t/a", "/t/y/a": "/t/x/a1"}


@pytest.mark.parametrize("wishes", [3000])
def test_one_name_wished_by_most(spark, wishes):
    """A third of the files leaves numbered places that the others come for."""
    existing = ["/t/f.txt"] + [f"/t/f_{i}.txt" for i in range(1, wishes // 3)] + [f"/in/{i}.txt" for i in range(wishes)]
    actions = [(i, "move", f"/in/{i}.txt", "/t/f.txt") if i % 3 else (i, "move", f"/t/f_{i // 3 + 1}.txt", f"/out/{i}.txt") for i in range(wishes)]
    held, status = one_after_another(existing, actions)
    done = AP.apply_plan(inventory(spark, existing), plan_of(spark, actions))
    assert {r["path"]: r["was"] for r in done.files.collect()} == held
    assert done.log.where("status = 'failed'").count() == sum(s == "failed" for s in status.values())


def test_backup_of_a_moved_file(spark):
    files = inventory(spark, ["/t/a"])
    plan = plan_of(spark, [(0, "move", "/t/a", "/t/b"), (1, "delete", "/t/b", None)])
    done = AP.apply_plan(files, plan, backup=True)
    assert [(r["path"], r["was"]) for r in done.files.collect()] == [("/t/.backups/b.backup", "/t/a")]
    assert done.log.where(F.col("message") == "Deleted: b (why)").count() == 1
