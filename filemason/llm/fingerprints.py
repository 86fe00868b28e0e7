"""Document fingerprints: a digest of byte-triplet bucket quartiles, and a bounded difference of two digests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, per_text, small_batches

BUCKETS, WINDOW = 128, 5
#: The triplets of a window: its first byte with each two of the four bytes behind it, each with a salt.
TRIPLETS = [(a, b) for a in range(1, WINDOW) for b in range(a + 1, WINDOW)]
#: Bytes that are counted at a time.
CHUNK = 1 << 21
#: Differences from here on count as no likeness.
FARTHEST = 300
HEAD, SIZE = 3, 3 + BUCKETS // 4


def _counts(texts: Sequence[bytes]) -> np.ndarray:
    """How many triplets of each text fall into each bucket; a long text is counted piece by piece."""
    total = np.zeros((len(texts), BUCKETS), np.int64)
    step = CHUNK - WINDOW
    pieces = [(i, t[at:at + CHUNK]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - WINDOW + 1), step + 1)]
    at = 0
    while at < len(pieces):
        upto, size = at, 0
        while upto < len(pieces) and (upto == at or size + len(pieces[upto][1]) <= CHUNK):
            size += len(pieces[upto][1])
            upto += 1
        _count_into(total, pieces[at:upto])
        at = upto
    return total


def _count_into(total: np.ndarray, pieces: Sequence[tuple[int, bytes]]) -> None:
    lengths = np.array([len(p) for _, p in pieces])
    text = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(text), bool)  # windows that begin here don't run into the next text
    for k in range(1, WINDOW):
        ends = (starts + lengths - k)[lengths >= k]
        inside[ends] = False
    if len(text) < WINDOW or not inside.any():
        return
    first = np.flatnonzero(inside)
    base = np.repeat(np.arange(len(pieces)), np.maximum(lengths - WINDOW + 1, 0)) * BUCKETS
    near = [text[first + k].astype(np.uint32) for k in range(WINDOW)]
    found = np.zeros(len(pieces) * BUCKETS, np.int64)
    for salt, (a, b) in enumerate(TRIPLETS):
        mixed = near[0] | near[a] << np.uint32(8) | near[b] << np.uint32(16)
        mixed *= np.uint32(0x9E3779B1 + 2 * salt * 0x01000193 & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
        found += np.bincount(base + (mixed >> np.uint32(25)), minlength=len(found))
    np.add.at(total, [i for i, _ in pieces], found.reshape(len(pieces), BUCKETS))


def digests(texts: Sequence[str]) -> list[str]:
    """Hexadecimal digests: checksum, logarithm of the length, quartile ratios, and two bits for each bucket: the
    quartile of its count among all buckets. Equal texts have equal digests; texts under five bytes have only the head."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = _counts(raw)
    q1, q2, q3 = (np.partition(counts, k, axis=1)[:, k:k + 1] for k in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, BUCKETS // 4, 4)
    body = code[:, :, 0] << 6 | code[:, :, 1] << 4 | code[:, :, 2] << 2 | code[:, :, 3]
    lengths = np.array([len(r) for r in raw])
    head = np.zeros((len(raw), HEAD), np.uint8)
    head[:, 0] = [zlib.crc32(r) & 255 for r in raw]
    head[:, 1] = np.minimum(255, np.floor(np.log(np.maximum(lengths, 1)) / np.log(1.1)))
    share = np.maximum(q3, 1)
    head[:, 2] = ((15 * q1 // share) << 4 | 15 * q2 // share)[:, 0]
    joined = np.hstack([head, body]).astype(np.uint8).tobytes().hex()
    return [joined[i:i + 2 * SIZE] for i in range(0, len(joined), 2 * SIZE)]


def differences(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Difference of each two digests, 0 for equal ones: one for a bucket a quartile away, two for two, six for
    opposite ends; and for length and quartile ratios that differ, at most a quarter of ``FARTHEST`` together."""
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(-1, SIZE).astype(np.int32) for x in (left, right))
    apart = np.zeros(len(a), np.int64)
    for shift in (0, 2, 4, 6):
        step = np.abs((a[:, HEAD:] >> shift & 3) - (b[:, HEAD:] >> shift & 3))
        apart += (step + 3 * (step == 3)).sum(axis=1)
    length = np.abs(a[:, 1] - b[:, 1])
    ratios = np.abs((a[:, 2] >> 4) - (b[:, 2] >> 4)) + np.abs((a[:, 2] & 15) - (b[:, 2] & 15))
    head = np.where(length <= 1, length, 2 * length) + 2 * ratios + (a[:, 0] != b[:, 0])
    return apart + np.minimum(head, FARTHEST // 4)


def likeness(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """1 for equal digests, 0 for a difference of ``FARTHEST`` or more."""
    return 1 - np.minimum(differences(left, right), FARTHEST) / FARTHEST


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fingerprint)`` for every row, from whole texts (null: empty); equal texts have equal fingerprints. No shuffle."""
    return per_text(docs, id_column, text, lambda: lambda texts: [digests(texts) if texts else []], "fingerprint string")


def compare_with_next(docs: DataFrame, edit: Callable[[str, str], str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text with its edited form and its neighbour: the row with the next larger id, for the last row the first.

    ``edit`` gets a text and the next one. Returns the id, ``text`` and ``edited_text`` lengths and digests as
    ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null texts are empty, a null id comes
    first, rows with the same id are in the order of their texts; a single row is its own neighbour.

    One shuffle: rows are dealt into ranges of ids and sorted there; the first row of each range also goes to
    the range before it (the very first to the last), where it only serves as a neighbour.
    """
    import hashlib

    spark = docs.sparkSession
    small_batches(spark)
    least = -(1 << 63)
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(least))
    rows = docs.select(F.col(id_column).alias("id"), key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 50 * n).alias("cuts"), F.min("key").alias("first")).first()
    bounds = sorted({*(cuts["cuts"] or [])} - {cuts["first"]})
    known = F.lit(bounds) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(known, lambda b: b <= F.col("key")))
    place = lambda b, ahead: F.struct(b.cast("int").alias("bucket"), F.lit(ahead).alias("ahead"))
    copies = F.array_compact(F.array(
        place(bucket, 0), F.when(F.array_contains(known, F.col("key")), place(bucket - 1, 1)),
        F.when(F.col("key") == F.lit(cuts["first"]), place(F.lit(len(bounds)), 1))))
    dealt = rows.select(F.explode(copies).alias("p"), "id", "key", "text").select("p.bucket", "p.ahead", "key", "id", "text")
    sorted_rows = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "ahead", "key", "text")
    names = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(names).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            batch = pa.Table.from_batches([*([waiting] if waiting else []), batch]).combine_chunks().to_batches()[0] \
                if batch.num_rows else waiting
            if batch is None:
                continue
            ahead, texts = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            own = [i for i in range(batch.num_rows - 1) if not ahead[i]]
            waiting = batch.slice(batch.num_rows - 1)
            if not own:
                continue
            edited = [edit(texts[i], texts[i + 1]) for i in own]
            prints, changed = digests(texts), digests(edited)
            mine = [prints[i] for i in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(3).take(pa.array(own, pa.int64())), pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited]),
                pa.array(mine), pa.array(changed), pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, [prints[i + 1] for i in own]))], names=schema.names)

    return sorted_rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
