"""A stored cache of model results: buckets by key range, of which an upsert rewrites only those it touches.

A version is a small manifest that names the folder of each bucket. It is created by number, which only one writer can do, and
counts once it is whole, so readers go from one version to the next in one step and old ones stay readable until they are cleared away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.captured import convert_exception
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from ..schemas import CACHE
from ..session import materialize
from . import cache_store

_END = "\n"


class ResultStore:
    """Keyed results below ``root``, a folder that all executors reach. ``buckets`` is fixed when the store is first written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        if not 0 < buckets <= 4096:
            raise ValueError("a store has between 1 and 4096 buckets")
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        manifest = self.manifest()
        if manifest is not None:
            self.buckets = manifest["buckets"]

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _listed(self, folder: str) -> list[str]:
        fs, place = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def _version_path(self, version: int) -> str:
        return f"{self.root}/versions/v{version:010d}.json"

    def versions(self) -> list[int]:
        return [int(n[1:11]) for n in self._listed("versions") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """The latest whole manifest up to ``version``; None for a store without any."""
        for number in reversed([v for v in self.versions() if version is None or v <= version]):
            fs, place = self._fs(self._version_path(number))
            stream = fs.open(place)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith(_END):  # else its writer is still at it, or was lost
                return json.loads(text)
        return None

    def _publish(self, version: int, paths: dict[int, str]) -> bool:
        """Create the manifest of a version; False if another writer has it already."""
        fs, place = self._fs(self._version_path(version))
        try:
            stream = fs.create(place, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in type(convert_exception(e.java_exception)).__name__ + e.java_exception.getClass().getName():
                return False
            raise
        told = {"version": version, "buckets": self.buckets, "paths": {str(b): p for b, p in sorted(paths.items())}}
        stream.write(bytearray((json.dumps(told) + _END).encode()))
        stream.close()
        return True

    def _paths(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        manifest = self.manifest(version)
        return (0, {}) if manifest is None else (manifest["version"], {int(b): f"{self.root}/{p}" for b, p in manifest["paths"].items()})

    def _bucket(self, key: Column) -> Column:
        """The range of the key's digest that a key belongs to."""
        first = F.conv(F.left(F.md5(key), F.lit(4)), 16, 10).cast("int")
        return F.floor(first * self.buckets / 65536).cast("int")

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(CACHE).parquet(*paths) if paths else self.spark.createDataFrame([], CACHE)

    def read(self, version: int | None = None) -> DataFrame:
        """The results of the latest version, or of an earlier one."""
        return self._rows([p for _, p in sorted(self._paths(version)[1].items())])

    def split(self, files: DataFrame, as_of: Column, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits with ``value``, misses) among the files, by the latest version and without expired results."""
        return cache_store.split(files, self.read(), as_of, key)

    def upsert(self, rows: DataFrame, files_per_bucket: int = 4, attempts: int = 20) -> int:
        """Store results (new ones replace old ones of their key) as the next version and return its number.

        Only buckets that hold a new key are written; all others keep their folders. If another writer publishes first, the
        merge is made again on top of its version, so no result is lost. Without new rows nothing changes.
        """
        new = materialize(rows.select(*CACHE.fieldNames()), "results")
        touched = sorted(r["b"] for r in new.select(self._bucket(F.col("key")).alias("b")).distinct().collect() if r["b"] is not None)
        if not touched:
            return self._paths()[0]
        for _ in range(attempts):
            version, paths = self._paths()
            merged = cache_store.upsert(self._rows([paths[b] for b in touched if b in paths]), new.where("key IS NOT NULL"))
            folder = f"data/{uuid.uuid4().hex}"
            dealt = merged.withColumn("bucket", self._bucket(F.col("key"))).repartition(
                "bucket", F.pmod(F.xxhash64("key"), F.lit(files_per_bucket)))
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            kept = {b: p.removeprefix(f"{self.root}/") for b, p in paths.items()}
            number = max([version, *self.versions()]) + 1  # a lost writer's number stays unused
            if self._publish(number, kept | {b: f"{folder}/bucket={b}" for b in touched}):
                return number
        raise RuntimeError(f"other writers published first {attempts} times")

    def clear_old(self, keep: int = 2) -> int:
        """Delete all but the latest ``keep`` versions and the folders that none of these names; the number of folders deleted.
        Only for times without readers of old versions and without writers."""
        versions = self.versions()
        used = {p.removeprefix(f"{self.root}/").split("/")[1] for v in versions[-keep:] for p in self._paths(v)[1].values()}
        gone = [n for n in self._listed("data") if n not in used]
        for path in [self._version_path(v) for v in versions[:-keep]] + [f"{self.root}/data/{n}" for n in gone]:
            fs, place = self._fs(path)
            fs.delete(place, True)
        return len(gone)
