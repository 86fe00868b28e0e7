import datetime
import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filemason.operators import usage, vectors
from filemason.sources import cache_store, content, inventory, ledger, organized


def png(path, pixels):
    """Write an H × W × 3 array as PNG."""
    h, w, _ = pixels.shape

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "a.txt": b"one\r\ntwo \xff three", "sub/b.txt": b"one\r\ntwo \xff three", "sub/deep/er/c.py": b"print(1)\n",
        "_under/d.md": b"# d", ".hidden/e.txt": b"e", ".f": b"f", "empty.txt": b"", "sub/big.bin": b"x" * 3000,
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def names(df):
    return sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())


def test_inventory(spark, tree):
    assert names(inventory.scan_inventory(spark, str(tree))) == ["a.txt", "b.txt", "big.bin", "c.py", "d.md", "empty.txt"]
    assert names(inventory.scan_inventory(spark, str(tree), include_hidden=True)) == [
        ".f", "a.txt", "b.txt", "big.bin", "c.py", "d.md", "e.txt", "empty.txt"]
    assert names(inventory.scan_inventory(spark, str(tree), max_depth=0)) == ["a.txt", "empty.txt"]
    assert names(inventory.scan_inventory(spark, str(tree), max_depth=2)) == ["a.txt", "b.txt", "big.bin", "d.md", "empty.txt"]
    assert "big.bin" not in names(inventory.scan_inventory(spark, str(tree), size_limit_mb=0.001))
    with pytest.raises(FileNotFoundError):
        inventory.scan_tree(spark, str(tree / "none"))
    with pytest.raises(NotADirectoryError):
        inventory.scan_tree(spark, str(tree / "a.txt"))


def test_inventory_rows(spark, tree):
    os.utime(tree / "a.txt", (1700000000.5, 1700000000.5))
    rows = inventory.scan_inventory(spark, str(tree)).orderBy("seq").collect()
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)
    a = next(r for r in rows if r["name"] == "a.txt")
    assert (a["size"], a["extension"], a["file_type"], a["parent_dir"]) == (16, ".txt", "document", str(tree))
    assert a["modified_at"] == datetime.datetime(2023, 11, 14, 22, 13, 20, 500000)


def test_scan_errors(spark, tree):
    gone = list(inventory.list_folder(str(tree / "missing"), False))
    assert gone[0][0] == "error" and gone[0][2].startswith(f"Cannot access {tree / 'missing'}")
    assert inventory.scan_errors(inventory.scan_tree(spark, str(tree))).count() == 0


def test_links_are_followed_but_not_in_circles(spark, tree):
    (tree / "other").symlink_to(tree / "sub")
    (tree / "sub/back").symlink_to(tree)
    (tree / "sub/deep/self").symlink_to(tree / "sub/deep")
    (tree / "broken").symlink_to(tree / "nowhere")
    scanned = inventory.scan_tree(spark, str(tree))
    assert names(inventory.as_files(scanned)) == sorted(["a.txt", "b.txt", "big.bin", "c.py", "d.md", "empty.txt", "b.txt", "big.bin", "c.py"])
    loops = [r["path"].removeprefix(str(tree)) for r in inventory.scan_errors(scanned).collect()]
    assert sorted(loops) == ["/other/back", "/other/deep/self", "/sub/back", "/sub/deep/self"]


def test_wide_and_deep_folders_are_shared_out(spark, tmp_path, monkeypatch):
    (tmp_path / "wide").mkdir()
    for i in range(3000):
        (tmp_path / f"wide/{i}.txt").touch()
    deep = tmp_path / "deep"
    for i in range(120):
        deep = deep / "d"
        deep.mkdir(parents=True)
        (deep / "f.txt").touch()
    monkeypatch.setattr(os, "scandir", lambda *_: pytest.fail("the driver lists nothing"))
    found = inventory.scan_tree(spark, str(tmp_path), tasks=4)
    assert found.count() == 3120 and found.where("error IS NOT NULL").count() == 0
    sizes = [r["n"] for r in found.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)


def test_texts_and_digests(spark, tree):
    files = inventory.scan_inventory(spark, str(tree))
    texts = {r["name"]: r["text"] for r in content.read_texts(files).collect()}
    assert texts["a.txt"] == "one\ntwo  three" and texts["big.bin"] is None and texts["c.py"] == "print(1)\n"
    assert {r["text"] for r in content.read_texts(files, max_chars=3).where("name = 'a.txt'").collect()} == {"one"}
    assert all(r["text"] in ("", None) for r in content.read_texts(files, max_file_size_kb=0).collect())
    digests = {r["name"]: r["content_hash"] for r in content.hash_files(files, chunk_size=4).collect()}
    assert digests["a.txt"] == digests["b.txt"] == hashlib.sha256((tree / "a.txt").read_bytes()).hexdigest()
    (tree / "a.txt").unlink()
    assert content.hash_files(files, "md5").where("name = 'a.txt'").first()["content_hash"] is None


def test_images(spark, tmp_path):
    grid = np.arange(64).reshape(8, 8) * 3
    wide = np.repeat(np.repeat(grid, 2, 0), 4, 1)[..., None].repeat(3, 2)
    png(tmp_path / "a+b c.png", wide)
    png(tmp_path / "small.png", grid[..., None].repeat(3, 2))
    png(tmp_path / "inverse.png", 200 - wide)
    (tmp_path / "empty.jpg").write_bytes(b"")
    files = inventory.scan_inventory(spark, str(tmp_path))
    images = content.read_images(spark, str(tmp_path))
    meta = {r["name"]: r["imagemetadata"] for r in content.image_features(files, images).collect()}
    m = meta["a+b c.png"]
    assert (m["width"], m["height"], m["mode"], m["format"], m["aspect_ratio"]) == (32, 16, "RGB", "PNG", 2.0)
    assert m["is_landscape"] and not m["is_portrait"] and not m["is_square"] and not m["has_exif"]
    assert meta["small.png"]["is_square"] and meta["empty.jpg"]["extraction_error"]
    hashes = {r["seq"]: r["hash"] for r in content.image_hashes(files, images).collect()}
    by_name = {r["name"]: hashes.get(r["seq"]) for r in files.collect()}
    assert by_name["a+b c.png"] == by_name["small.png"] and by_name["empty.jpg"] is None
    row = spark.createDataFrame([(by_name["small.png"],)], "h bigint").select(content.hash_text(F.col("h")).alias("t")).first()
    assert row["t"] == "00000000ffffffff"
    assert bin((by_name["small.png"] ^ by_name["inverse.png"]) & (2**64 - 1)).count("1") == 64
    vector = content.image_features(files, images).select("name", vectors.image_vector(F.col("imagemetadata")).alias("v"))
    v = {r["name"]: r["v"] for r in vector.collect()}
    assert v["a+b c.png"] == [32.0, 16.0, 2.0, 512.0, 1.0, 0.0, 0.0, 0.0] and v["empty.jpg"][2] == 1.0


def test_ledger(spark, tmp_path):
    export = {"usage_records": [
        {"timestamp": 1700000000.25, "provider": "openai", "model": "gpt-4", "prompt_tokens": 1000, "completion_tokens": 500,
         "cost_usd": 0.06, "operation": "organization"}], "last_updated": 1.0}
    (tmp_path / "l.json").write_text(json.dumps(export, indent=2))
    (tmp_path / "bad.json").write_text("{broken")
    rows = ledger.read_export(spark, str(tmp_path / "l.json"))
    assert rows.count() == 1 and ledger.read_export(spark, str(tmp_path / "bad.json")).count() == 0
    assert ledger.read_export(spark, str(tmp_path / "none.json")).count() == 0
    assert abs(usage.with_cost(rows.drop("cost_usd")).first()["cost_usd"] - 0.06) < 1e-12
    table = str(tmp_path / "table")
    ledger.append(rows, table)
    ledger.append(rows, table)
    assert ledger.read(spark, table).count() == 2
    recent = ledger.read_recent(spark, table, "2023-11-15")
    assert recent.count() == 0 and "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().toString()


def test_usage_guards(spark):
    empty = spark.createDataFrame([], "timestamp timestamp, provider string, model string, prompt_tokens bigint, completion_tokens bigint, cost_usd double")
    at = F.lit("2024-01-01").cast("timestamp")
    assert usage.within_limit(empty, 10.0) and usage.totals(empty).first()["calls"] == 0
    assert usage.report_text(empty, at).first()["line"] == "No model usage recorded yet."
    full = spark.createDataFrame([(datetime.datetime(2023, 12, 31), "openai", "gpt-4", 1000, 234, 10.0)], empty.schema)
    assert not usage.within_limit(full, 10.0)
    lines = [r["line"] for r in usage.report_text(full, at).orderBy("detail").collect()]
    assert lines == ["Total: $10.0000, 1,234 tokens, 1 calls; last 7 days: $10.0000, 1 calls", "openai gpt-4: $10.0000 (1,234 tokens, 1 calls)"]


def test_cache_versions(spark, tmp_path):
    t = lambda d: datetime.datetime(2024, 1, d)
    old = spark.createDataFrame([("k1", "a", t(1), None), ("k2", "b", t(1), t(2))], cache_store.CACHE)
    new = spark.createDataFrame([("k2", "B", t(1), None), ("k3", "c", t(3), t(4))], cache_store.CACHE)
    merged = cache_store.upsert(old, new)
    assert {r["key"]: r["value"] for r in merged.collect()} == {"k1": "a", "k2": "B", "k3": "c"}
    path = cache_store.write_version(merged, str(tmp_path / "cache"), 2)
    stored = spark.read.parquet(path)
    assert {r["key"] for r in cache_store.valid(stored, F.lit("2024-01-04").cast("timestamp")).collect()} == {"k1", "k2", "k3"}
    assert {r["key"] for r in cache_store.valid(stored, F.lit("2024-01-05").cast("timestamp")).collect()} == {"k1", "k2"}


def test_organized_sink(spark, tmp_path):
    rows = [("Documents/Work/a.txt", "x"), ("Documents/Work/b.txt", "y"), ("Other/c", "z")] + [(f"Hot/{i}.txt", "h") for i in range(400)]
    frame = spark.createDataFrame(rows, "target_path string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put these few rows together
    try:
        organized.write_organized(frame, str(tmp_path / "out"), rows_per_file=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["target_dir"], r["target_path"], r["text"]) for r in back.collect()) == sorted((p.rsplit("/", 1)[0], p, t) for p, t in rows)
    files = {d.name: len(list(d.glob("part-*"))) for d in (tmp_path / "out").iterdir() if d.is_dir()}
    hot = files.pop("target_dir=Hot")
    assert set(files.values()) == {1} and 2 <= hot <= 8  # a folder's writers follow its size

def test_unrelated_binaries_are_no_duplicates(spark, tmp_path):
    """Files of one size whose content is no text, or can't be read, are only duplicates if their bytes are equal."""
    from filemason.plans.organize import organize
    from filemason.sources.inventory import scan_inventory

    for name, byte in (("a.jpg", b"a"), ("b.jpg", b"b"), ("c.zip", b"c"), ("d.zip", b"c")):
        (tmp_path / name).write_bytes(byte * 100)
    files = content.with_content_hash(content.read_texts(scan_inventory(spark, str(tmp_path))))
    plan = organize(files, "rules", as_of=F.current_timestamp())
    gone = [r["source"].rsplit("/", 1)[1] for r in plan.where("action_type = 'delete'").collect()]
    assert len(gone) == 1 and gone[0] in ("c.zip", "d.zip")
    without = organize(content.read_texts(scan_inventory(spark, str(tmp_path))), "rules", as_of=F.current_timestamp())
    assert without.where("action_type = 'delete'").count() == 0
