"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded, and verified exactly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clustering import components
from ..session import materialize
from .common import kept, partitions, same, small_batches

#: Words of a shingle, bands of a signature and samples of a band, similarity from which documents are near copies.
WORDS, BANDS, ROWS, SIMILARITY = 5, 12, 3, 0.8
#: Hashed word frequencies, and distinct words whose hashes a task keeps.
FREQUENCIES, KEPT_WORDS = 1 << 16, 800_000
#: Texts of a candidate group that are compared in one task with as many others.
BLOCK = 512
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX
    h ^= h >> np.uint64(32)
    h *= TURN
    return h ^ h >> np.uint64(29)


class Shingles:
    """Weighted shingles of whole texts.

    A shingle is five successive words (a shorter text is one shingle of all its words); its weight is how often it
    occurs times the mean rarity of its words. Rarities lie between 1 and 2, so that a rare word counts more, but a changed
    word can't outweigh the shingles around it.
    """

    def __init__(self, rarity: np.ndarray) -> None:
        self.rarity, self.words = rarity, {}

    def hashes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, one after the other, and how many each has."""
        import xxhash

        split = [t.split() for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        words = self.words
        for w in [w for w in set().union(*split) if w not in words]:
            words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        counts = np.array([len(s) for s in split], np.int64)
        found = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
        return found, counts

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, weight) of the distinct shingles, sorted by text and hash."""
        word, counts = self.hashes(texts)
        if not len(word):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
        padded = np.where(counts > 0, np.maximum(counts, WORDS), 0)
        begin = np.cumsum(padded) - padded
        place = np.arange(len(word)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
        row, rare = np.zeros(padded.sum(), np.uint64), np.zeros(padded.sum())
        row[place], rare[place] = word, self.rarity[(word & np.uint64(FREQUENCIES - 1)).astype(np.int64)]
        n = len(row) - WORDS + 1
        shingle, weight = np.zeros(n, np.uint64), np.zeros(n)
        for i in range(WORDS):
            shingle = (shingle + row[i:i + n]) * MIX
            weight += rare[i:i + n]
        owner = np.repeat(np.arange(len(texts)), padded)[:n]
        inside = np.arange(n) <= np.repeat(begin + padded - WORDS, padded)[:n]
        shingle, weight, owner = _mixed(shingle[inside]), weight[inside] / WORDS, owner[inside]
        order = np.lexsort((shingle, owner))
        shingle, weight, owner = shingle[order], weight[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])]))
        times = np.diff(np.append(first, len(shingle)))
        return owner[first], shingle[first], weight[first] * times


class Sampler:
    """Improved consistent weighted sampling: of each weighted set, samples (shingle, t) that two sets have in common with the
    probability of their weighted Jaccard similarity.

    For a shingle of weight S: r and c from Gamma(2, 1), b from U(0, 1), t = floor(ln S / r + b); the shingle with the
    smallest ln c - r (t - b + 1) is the sample. r, b and c are looked up by hashed bits of the shingle and the sample's number.
    """

    def __init__(self, samples: int = BANDS * ROWS) -> None:
        rng = np.random.default_rng(20)
        self.r = rng.gamma(2, 1, 1 << 12).astype(np.float32)
        self.b = rng.random(1 << 12).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.salts = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """A row of sample hashes for each of n texts; zeros for a text without shingles."""
        out = np.zeros((n, len(self.salts)), np.uint64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        bounds, at = np.append(first, len(owner)), 0
        while at < len(first):
            upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 16), side="right")) - 1)
            part = slice(bounds[at], bounds[upto])
            self._sample(shingle[part], np.log(weight[part]).astype(np.float32), first[at:upto] - first[at], out, owner[first[at:upto]])
            at = upto
        return out

    def _sample(self, shingle: np.ndarray, log: np.ndarray, first: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        place = np.arange(len(shingle), dtype=np.int64)
        for k, salt in enumerate(self.salts):
            z = shingle * salt
            z ^= z >> np.uint64(32)
            z *= MIX
            i = (z >> np.uint64(52)).astype(np.int64)
            r, b = self.r[i], self.b[i]
            t = np.floor(log / r + b)
            y = self.c[(z >> np.uint64(30)).astype(np.int64) & 0xFFFF] - r * (t - b + 1)
            bits = y.view(np.int32)
            bits = bits ^ (bits >> 31 & 0x7FFFFFFF)
            best = np.minimum.reduceat((bits.astype(np.int64) << 32) | place, first) & 0xFFFFFFFF
            out[rows, k] = _mixed(shingle[best] + t[best].astype(np.int64).astype(np.uint64) * TURN)


def word_rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rarity, between 1 and 2, of each hashed word, from the number of documents that have it; counted over all documents."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FREQUENCIES, np.int64), 0
        shingles = kept("shingle words", lambda: Shingles(np.zeros(0)))
        for batch in batches:
            word, counts = shingles.hashes([t or "" for t in batch.column(0).to_pylist()])
            key = np.repeat(np.arange(len(counts)), counts) * FREQUENCIES + (word & np.uint64(FREQUENCIES - 1)).astype(np.int64)
            total += np.bincount(np.unique(key) % FREQUENCIES, minlength=FREQUENCIES)
            n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*range(FREQUENCIES), -1]), pa.array([*total.tolist(), n])], names=["f", "n"])

    sums = docs.select(text).mapInArrow(count, "f long, n long").where("n > 0").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FREQUENCIES)
    own = sums[sums["f"] >= 0]
    counts[own["f"].to_numpy()] = own["n"].to_numpy()
    n = float(sums.loc[sums["f"] < 0, "n"].sum())
    return 1 + np.log((1 + n) / (1 + counts)) / np.log(2 + n)


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes, weights), hashes sorted."""
    _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    shared = np.minimum(left[1][i], right[1][j]).sum()
    total = left[1].sum() + right[1].sum() - shared
    return float(shared / total) if total > 0 else 1.0


def _signatures(rows: DataFrame, rarity) -> DataFrame:
    schema = T._parse_datatype_string("node binary, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept("shingle words", lambda: Shingles(np.zeros(0)))
        shingles.rarity, sampler = rarity.value, Sampler()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            samples = sampler(*shingles(texts), len(texts))
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for b in range(BANDS):
                for k in range(b * ROWS, (b + 1) * ROWS):
                    bands[:, b] = _mixed(bands[:, b] + samples[:, k])
                bands[:, b] = _mixed(bands[:, b] + np.uint64(b))
            some = samples.any(axis=1)
            ends = np.cumsum([0, *np.where(some, BANDS, 0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[some].ravel().view(np.int64)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest of the places joined to each place by pairs."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs.tolist():
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(n)])


def _alike(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Pairs of a place in ``left`` and one in ``right`` whose sets are at least so similar.

    For few sets each pair is compared; for more, the weights that each shingle contributes are added up in a
    matrix of all pairs, whose size is bounded by the blocks."""
    if len(left) * len(right) <= 64:
        once = [(x, y) for x in left for y in right if x < y or x not in right]
        return np.array([(x, y) for x, y in once if similarity(sets[x], sets[y]) >= least], np.int64).reshape(-1, 2)
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    shingle, weight = (np.concatenate(c) for c in zip(*sets))
    order = np.argsort(shingle, kind="stable")
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    shared = np.zeros((len(left), len(right)), np.float64)
    for x, y in zip(first, np.append(first[1:], len(shingle))):
        if y - x > 1:
            o, w = owner[x:y], weight[x:y]
            l, r = row[o] >= 0, column[o] >= 0
            shared[np.ix_(row[o[l]], column[o[r]])] += np.minimum.outer(w[l], w[r])
    whole = np.array([w.sum() for _, w in sets])
    union = whole[left][:, None] + whole[right][None, :] - shared
    x, y = np.nonzero(shared >= least * union)
    x, y = left[x], right[y]
    return np.stack([x, y], axis=1)[x != y]


def _links(rows: DataFrame, rarity, least: float) -> DataFrame:
    """(a, b) links that join what is alike, from texts sorted by their part: a candidate group and two of its blocks."""

    def compare(part: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        shingles = kept("shingle words", lambda: Shingles(np.zeros(0)))
        shingles.rarity = rarity.value
        owner, h, w = shingles([r[4] for r in part])
        cut = np.searchsorted(owner, np.arange(len(part) + 1))
        ends = [i for i in range(1, len(part) + 1) if i == len(part) or part[i][:3] != part[i - 1][:3]]
        for x, y in zip([0, *ends], ends):
            one, other = part[x][1:3]
            block = np.array([r[3] for r in part[x:y]])
            sets = [(h[a:b], w[a:b]) for a, b in zip(cut[x:y], cut[x + 1:y + 1])]
            pairs = _alike(sets, np.flatnonzero(block == one), np.flatnonzero(block == other), least)
            for i, r in enumerate(_roots(y - x, pairs)):
                if i != r:
                    yield part[x + i][5], part[x + r][5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(part) >= BLOCK and row[:3] != part[-1][:3]:
                    found = list(compare(part))
                    part = []
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
                part.append(row)
        found = list(compare(part)) if part else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return rows.select("root", "one", "other", "block", "text", "node").mapInArrow(run, "a binary, b binary")


def _classes(sketch: DataFrame, texts: DataFrame, rarity, least: float) -> DataFrame:
    """(node, root) of the classes of near copies among distinct texts that share a band with another.

    Texts joined by shared bands are a candidate group. All texts of a group are compared exactly, in the tasks: a group of
    more than ``BLOCK`` texts is dealt into blocks, and each two blocks meet in a task, so no task holds more than two of
    them. Only links that join what is alike leave a task, at most one for each text.
    """
    buckets = sketch.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1").select("band", "lead")
    stars = buckets.join(materialize(shared, "buckets"), "band").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    groups = materialize(components(stars).select(F.col("seq").alias("node"), "root"), "groups")
    sizes = materialize(groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    placed = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # merge joins at every size: what is joined to the texts grows with them
    members = texts.join(groups.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    members = members.join(placed.hint("merge"), "node")
    dealt = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")})
    parts = dealt.repartition(partitions(sketch.sparkSession), "root", "one", "other").sortWithinPartitions("root", "one", "other")
    links = materialize(_links(parts, rarity, least), "links")
    return components(links).select(F.col("seq").alias("node"), "root")


def _node(body: Column) -> Column:
    return F.unhex(F.md5(body.cast("binary")))


def _placed(docs: DataFrame, id_column: str, text: str, similar: float) -> DataFrame:
    """(id, node, root) for every row: the hash of its text, and that of its class."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), _node(body).alias("node"), body.alias("text"))
    rarity = spark.sparkContext.broadcast(word_rarity(docs, text))
    names = materialize(rows.select("id", "node"), "names")
    sketch = materialize(_signatures(rows.select("node", "text"), rarity).dropDuplicates(["node"]), "sketches")
    roots = _classes(sketch, rows.select("node", "text"), rarity, similar)
    return names.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similar: float = SIMILARITY) -> DataFrame:
    """``(id, class_id, n_copies)`` for every row: the smallest id of its class, and how many rows the class has.

    Rows are in one class if their texts are equal or joined by a chain of texts whose shingles have a weighted Jaccard similarity of
    at least ``similar``. Candidates share a band of weighted samples (a pair at 0.8 is missed with a probability of
    0.0002, a more similar one less) and are compared exactly. Null texts are empty; texts without words are alike only if
    equal. Repeated rows are in one class; a null id is the smallest of its class only if all ids there are null. No rows give no rows.

    Equal texts are one node throughout, so the size of a group of copies is of no account; only the distinct texts of shared
    bands are shuffled for comparing.
    """
    placed = _placed(docs, id_column, text, similar)
    classes = placed.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    return placed.join(classes, "root").select(F.col("id").alias(id_column), "class_id", "n_copies")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similar: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class of near copies: that of the smallest id (null ones last), of these the one with the smallest text."""
    placed = materialize(_placed(docs, id_column, text, similar), "placed")
    ids = placed.groupBy("root", "id").agg(F.count("*").alias("n"))
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first"))
    first = first.select(F.col("root").alias("_root"), F.col("first.id").alias("_first"), F.col("first.n").alias("_n"))
    chosen = placed.join(first, (F.col("root") == F.col("_root")) & F.col("id").eqNullSafe(F.col("_first")))
    chosen = chosen.select("_root", F.col("id").alias("_id"), F.col("node").alias("_node"), "_n").distinct()
    keyed = docs.withColumns({"_id": F.col(id_column), "_node": _node(F.coalesce(F.col(text), F.lit("")))})
    # merge joins at every size, as above
    rows = keyed.join(chosen.hint("merge"), same(keyed, chosen, ["_id", "_node"])).select("_root", "_n", *(docs[c] for c in docs.columns))
    order = F.struct(F.coalesce(F.col(text), F.lit("")), F.to_json(F.struct(*docs.columns)))
    tied = rows.where("_n > 1").groupBy("_root").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return rows.where("_n = 1").select(*docs.columns).unionByName(tied)
