"""Directory trees as inventories: folders are listed in rounds of jobs, and files are looked at by as many tasks as there are."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..schemas import FILES, SCANNED
from ..session import materialize

#: Folders that a task lists for each folder it was given, in the first round and at most; the rest is dealt out anew.
FIRST_BURST, LAST_BURST = 8, 512
_LISTED = "kind string, path string, depth int, error string"


def _is_loop(path: str) -> bool:
    """Whether a linked folder is one of the folders on the way to it, by device and inode."""
    own = os.stat(path)
    above = os.path.dirname(path)
    while True:
        there = os.stat(above)
        if (there.st_dev, there.st_ino) == (own.st_dev, own.st_ino):
            return True
        if above == os.path.dirname(above):
            return False
        above = os.path.dirname(above)


def list_folder(folder: str, hidden: bool) -> Iterator[tuple[str, str, str | None]]:
    """``(kind, path, error)`` of what a folder holds: files, folders (through links too) and what can't be read."""
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                if not hidden and entry.name.startswith("."):
                    continue
                try:
                    if entry.is_file():
                        yield "file", entry.path, None
                    elif entry.is_dir():
                        if entry.is_symlink() and _is_loop(entry.path):
                            yield "error", entry.path, f"Loop of links: {entry.path}"
                        else:
                            yield "folder", entry.path, None
                except OSError as e:
                    yield "error", entry.path, f"Cannot access {entry.path}: {e}"
    except OSError as e:
        yield "error", folder, f"Cannot access {folder}: {e}"


def _expand(folders: DataFrame, hidden: bool, max_depth: int | None, burst: int) -> DataFrame:
    """Files, errors and folders still to list, after each given folder and up to ``burst`` folders below it were listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, depth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                todo = [(path, depth)]
                listed = 0
                while todo and listed < burst:
                    folder, at = todo.pop()
                    listed += 1
                    for kind, found, error in list_folder(folder, hidden):
                        if kind == "folder":
                            if max_depth is None or at < max_depth:
                                todo.append((found, at + 1))
                            continue
                        rows.append((kind, found, at, error))
                        if len(rows) >= 10_000:
                            yield told(rows)
                            rows = []
                rows += [("folder", p, d, None) for p, d in todo]
        yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "path", "depth", "error"])

    return folders.mapInArrow(run, _LISTED)


def _looked_at(files: DataFrame, limit_bytes: float) -> DataFrame:
    """The files' sizes and times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    s = os.stat(path)
                    if not limit_bytes or s.st_size <= limit_bytes:
                        rows.append((path, s.st_size, s.st_ctime, s.st_mtime, s.st_atime, None))
                except OSError as e:
                    rows.append((path, None, None, None, None, f"Cannot access {path}: {e}"))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=SCANNED.fieldNames())

    return files.mapInArrow(run, SCANNED)


def scan_tree(spark: SparkSession, root: str, include_hidden: bool = False, max_depth: int | None = None,
              size_limit_mb: float | None = None, tasks: int | None = None) -> DataFrame:
    """Files and unreadable paths (``error`` set) under a folder that every executor can reach.

    Folders are listed in rounds: each task lists the folders it was given and some below them, and what is left is dealt out
    to all tasks again, so neither a wide nor a deep branch stays with one of them. Each round is written. Files are dealt
    out by their paths before they are looked at, those of one folder too. Linked folders are followed unless that
    would lead back to a folder on the way; such loops are errors. The driver lists nothing.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(f"Directory does not exist: {root}")
    if not os.path.isdir(root):
        raise NotADirectoryError(f"Path is not a directory: {root}")
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    todo = spark.createDataFrame([(os.path.abspath(root), 0)], "path string, depth int")
    if max_depth is not None and max_depth < 0:
        todo = todo.limit(0)
    rounds, burst = [], FIRST_BURST
    while not todo.isEmpty():
        found = materialize(_expand(todo.repartition(tasks, "path"), include_hidden, max_depth, burst), "listed")
        rounds.append(found.where("kind <> 'folder'"))
        todo = found.where("kind = 'folder'").select("path", "depth")
        burst = min(LAST_BURST, burst * 2)
    listed = reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], _LISTED)
    files = listed.where("kind = 'file'").select("path").repartition(tasks, "path")
    errors = listed.where("kind = 'error'").select("path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in SCANNED.fields[1:-1]), "error")
    return materialize(_looked_at(files, float(size_limit_mb or 0) * 1048576).unionByName(errors), "scanned")


def as_files(scanned: DataFrame) -> DataFrame:
    """The inventory of a scan, with ``seq`` by path. It is written once: numbers must not change when a
    lost task runs again."""
    rows = scanned.where("error IS NULL").drop("error")
    for c in ("created_at", "modified_at", "accessed_at"):
        rows = rows.withColumn(c, F.timestamp_micros(F.floor(F.col(c) * 1000000).cast("bigint")))
    numbered = rows.orderBy("path").withColumn("seq", F.monotonically_increasing_id())
    return materialize(P.with_path_columns(numbered).select(*FILES.fieldNames()), "inventory")


def scan_errors(scanned: DataFrame) -> DataFrame:
    return scanned.where("error IS NOT NULL").select("path", "error")


def scan_inventory(spark: SparkSession, root: str, **options) -> DataFrame:
    return as_files(scan_tree(spark, root, **options))
