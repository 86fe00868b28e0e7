"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import small_batches

#: Hashed features, latent dimensions, voters, and bytes that are hashed at a time.
FEATURES, LATENT, VOTERS, CHUNK = 4096, 64, 15, 1 << 21
#: Symbols that running text rarely holds, and how strongly the two shares of ``shapes`` count.
SYMBOLS, SHAPE_SCALE = b"|#$%&*+<=>@[]^_`{}~\\/", 4.0
#: Bounds of what the classifier is fitted on: half the labelled rows, and rows for the latent space.
LABELLED_ROWS, LATENT_ROWS = 4096, 2048


def term_counts(texts: Sequence[bytes]) -> np.ndarray:
    """Counts of hashed byte trigrams of whole texts, a row for each."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    pieces = [(i, t[at:at + CHUNK + 2]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - 2), CHUNK)]
    at = 0
    while at < len(pieces):
        upto, size = at, 0
        while upto < len(pieces) and upto - at < 256 and (upto == at or size + len(pieces[upto][1]) <= CHUNK):
            size += len(pieces[upto][1])
            upto += 1
        part = pieces[at:upto]
        lengths = np.array([len(p) for _, p in part])
        text = np.frombuffer(b"".join(p for _, p in part), np.uint8)
        starts, inside = np.cumsum(lengths) - lengths, np.ones(len(text), bool)
        for k in (1, 2):
            inside[(starts + lengths - k)[lengths >= k]] = False
        first = np.flatnonzero(inside)
        if len(first):
            mixed = text[first].astype(np.uint32) | text[first + 1].astype(np.uint32) << 8 | text[first + 2].astype(np.uint32) << 16
            mixed *= np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77)
            key = np.repeat(np.arange(len(part)) * FEATURES, np.maximum(lengths - 2, 0)) + (mixed >> np.uint32(20))
            found = np.bincount(key, minlength=len(part) * FEATURES).reshape(len(part), FEATURES)
            np.add.at(out, [i for i, _ in part], found)
        at = upto
    return out


def shapes(texts: Sequence[str]) -> np.ndarray:
    """What the latent dimensions can't see: shares of words that repeat the word before, and of symbols, each up to 1."""
    found = np.zeros((len(texts), 2), np.float32)
    for i, t in enumerate(texts):
        words, raw = t.split(), t.encode("utf-8", "replace")
        if words:
            found[i] = sum(map(eq, words, words[1:])) / len(words), (len(raw) - len(raw.translate(None, SYMBOLS))) / len(raw)
    return np.minimum(1, SHAPE_SCALE * found)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log counts by rarity; a row of zeros stays so."""
    weights = np.log1p(counts) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t or "" for t in part.column(text).to_pylist()]
            yield part, texts, term_counts([t.encode("utf-8", "replace") for t in texts])


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rarity of each hashed feature over all documents: each task sends one row of counts."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for part, _, counts in _blocks(batches, 0):
            total += (counts > 0).sum(axis=0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1)), pa.array([*total.tolist(), n])], names=["f", "n"])

    sums = docs.select(text).mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(FEATURES + 1)
    for r in sums:
        counts[r["f"]] = r["n"]
    return (np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1).astype(np.float32)


def latent_axes(sample: np.ndarray) -> np.ndarray:
    """Unit columns that span the sample's leading latent dimensions, at most ``LATENT``; rows are in half precision, widened some features
    at a time. Without rows there is one column of zeros."""
    if not len(sample):
        return np.zeros((FEATURES, 1), np.float32)
    some = [slice(at, at + 512) for at in range(0, FEATURES, 512)]
    products = np.zeros((len(sample), len(sample)))
    for part in some:
        wide = sample[:, part].astype(np.float32)
        products += wide @ wide.T
    _, vectors = np.linalg.eigh(products)
    first = vectors[:, ::-1][:, :LATENT].astype(np.float32)
    axes = np.vstack([sample[:, part].astype(np.float32).T @ first for part in some])
    return axes / np.maximum(np.linalg.norm(axes, axis=0), 1e-6)


def votes(latent: np.ndarray, labelled: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Scores between 0 and 1: labels of the most similar labelled vectors, weighted by similarity; ``prior`` where nothing is similar."""
    if not len(labelled):
        return np.full(len(latent), prior)
    products = latent @ labelled.T
    k = min(VOTERS, len(labelled))
    best = np.argpartition(-products, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(products, best, axis=1), 0).astype(np.float64)
    total = weight.sum(axis=1)
    return np.where(total > 1e-9, (weight * labels[best]).sum(axis=1) / np.maximum(total, 1e-9), prior)


def score_quality(docs: DataFrame, labelled: DataFrame, learns: Callable[[Column], Column], id_column: str = "doc_id", text: str = "text",
                  label: str = "quality", labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """All columns of ``docs`` and ``score``, the likeliness of label 1 between 0 and 1 for every whole text.

    ``labelled`` has ids with labels 0 and 1 (null ones, and ids without a document, count for nothing; repeated ids with their mean);
    ``learns``, a condition on the id, says which of them may be learnt from. At most twice ``labelled_rows`` ids,
    chosen by a hash of the id whatever their label, are the voters, so that labels keep their ratio and what is broadcast has a
    fixed bound; feature rarities come
    from all documents. Labels, and columns other than the text, are no input of a score. Null texts are empty;
    an empty text, or any where there are no labels, gets the share of label 1 (0.5 without labels). Equal texts get equal
    scores; a column named ``score`` is replaced. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score")
    usable = labelled.select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("label")).where("label is not null and id is not null")
    usable = usable.groupBy("id").agg(F.avg("label").alias("label")).where(learns(F.col("id")))
    share = usable.agg(F.avg("label").alias("share")).first()["share"]
    prior = 0.5 if share is None else float(share)
    voters = F.broadcast(usable.orderBy(F.xxhash64("id"), "id").limit(2 * labelled_rows))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(voters, "id")
    texts = materialize(texts.select("id", "label", "text"), "labelled")
    idf = inverse_frequencies(docs, text)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [weigh(counts, idf).astype("<f2") for _, _, counts in _blocks(batches, 0)]
        found = latent_axes(np.vstack(blocks) if blocks else np.zeros((0, FEATURES), "<f2"))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["axes"])

    chosen = texts.orderBy(F.xxhash64("id"), "id").limit(LATENT_ROWS).select("text")
    fitted = chosen.coalesce(1).mapInArrow(fit, "axes binary").collect()  # at most LATENT_ROWS rows in a task; only the axes reach the driver
    axes = np.frombuffer(fitted[0]["axes"], "<f4").reshape(FEATURES, -1) if fitted else np.zeros((FEATURES, 1), np.float32)

    def latent(texts: list[str], counts: np.ndarray) -> np.ndarray:
        found = weigh(counts, idf) @ axes
        found = np.hstack([found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12), shapes(texts)])
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, counts in _blocks(batches, 1):
            rows = latent(texts, counts).astype("<f4")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "v"])

    known = texts.select("label", "text").mapInArrow(project, "label double, v binary").collect()
    vectors = np.frombuffer(b"".join(r["v"] for r in known), "<f4").reshape(len(known), axes.shape[1] + 2)
    shared = spark.sparkContext.broadcast((vectors, np.array([r["label"] for r in known])))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled_vectors, labels = shared.value
        for part, texts, counts in _blocks(batches, at):
            found = votes(latent(texts, counts), labelled_vectors, labels, prior)
            found[~counts.any(axis=1)] = prior
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=schema.names)

    return docs.mapInArrow(score, schema)


def learnt_from(doc_id: Column) -> Column:
    """Ids whose labels may be learnt: all but those whose text form has a checksum divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0
