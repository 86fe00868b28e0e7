"""Substring dedup: bytes covered by a long string that also starts in an earlier document are removed.

Strings are ordered as a suffix array orders them, by deep-shallow sorting: a multikey sort of the first bytes, and
blind tries for what is still equal then. Which strings can be equal at all is found first: every string of
``length`` bytes is known by its minimizer, the smallest hash of its substrings of ``ANCHOR`` bytes, so equal strings have equal
minimizers, and runs of strings with one minimizer travel as one piece of text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import partitions, same, small_batches

#: Bytes of a minimizer, bytes hashed at a time, and most strings in a run.
ANCHOR, CHUNK, RUN = 16, 1 << 18, 128
#: Bytes that the multikey sort looks at before blind tries take over, and strings sorted together.
SHALLOW, TOGETHER = 16, 1 << 18
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes at each place."""
    n = len(text) - ANCHOR + 1
    word = text[:len(text) - 7].astype(np.uint64)
    for i in range(1, 8):
        word |= text[i:len(text) - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    mixed = word[:n] * A
    mixed ^= mixed >> np.uint64(29)
    mixed += word[8:8 + n] * B
    mixed ^= mixed >> np.uint64(32)
    mixed *= A
    return mixed ^ mixed >> np.uint64(29)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    found, size = values, 1
    while 2 * size <= width:
        found = np.minimum(found[:-size], found[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(found[:n], found[width - size:width - size + n]) if size < width else found


def runs(texts: Sequence[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, n, minimizer): runs of n strings of ``length`` bytes, starting one after the other, with one minimizer."""
    pieces = [(i, at, t[at:at + CHUNK + length - 1]) for i, t in enumerate(texts) for at in range(0, len(t) - length + 1, CHUNK)]
    out, at = [], 0
    while at < len(pieces):
        upto, size = at, 0
        while upto < len(pieces) and (upto == at or size + len(pieces[upto][2]) <= CHUNK):
            size += len(pieces[upto][2])
            upto += 1
        part = pieces[at:upto]
        text = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        begins = np.cumsum(sizes) - sizes
        inside = np.ones(len(text) - length + 1, bool)  # strings that don't run into the next piece
        for k, s in zip(begins[1:], sizes[:-1]):
            inside[k - length + 1:k] = False
        least = _least(_hashes(text), length - ANCHOR + 1)
        places = np.flatnonzero(inside)
        found = least[places]
        first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (np.diff(places) > 1)]))
        n = np.diff(np.concatenate([first, [len(places)]]))
        if (n > RUN).any():  # a run may be cut anywhere
            parts = -(-n // RUN)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, whole = np.repeat(first, parts) + step * RUN, np.repeat(n, parts)
            n = np.minimum(RUN, whole - step * RUN)
        which = np.searchsorted(begins, places[first], side="right") - 1
        owner, offset = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        out.append((owner[which], places[first] - begins[which] + offset[which], n, found[first]))
        at = upto
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of the groups of equal neighbours in sorted columns, and each row's group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def deep_shallow_classes(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the rows of a byte matrix inside their groups; (order, class of each place in it), equal rows in one class.

    Shallow: a multikey sort by group and the first ``SHALLOW`` bytes, eight at a time. Deep: rows still equal hang in one blind
    trie, built along the path of its first row: only where a row leaves that path, and with which byte, decides its place.
    Rows that leave below the path come first, the earlier the smaller, then the path itself, then those above it, the
    later the smaller; rows that leave at one place with one byte are again a trie, until each has only its path.
    """
    width = strings.shape[1]
    padded = np.zeros((len(strings), SHALLOW), np.uint8)
    padded[:, :min(SHALLOW, width)] = strings[:, :SHALLOW]
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    first, label = _groups(group[order], *(w[order] for w in words.T))
    todo = np.arange(len(order))  # places whose group may still hold different rows
    while True:
        sizes = np.bincount(label[todo], minlength=len(first))
        todo = todo[sizes[label[todo]] > 1]
        if not len(todo):
            return order, label
        mine, lead = strings[order[todo]], strings[order[first[label[todo]]]]
        differs = mine != lead
        leaves = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        rows = np.arange(len(todo))
        at = np.minimum(leaves, width - 1)
        byte = mine[rows, at].astype(np.int64)
        above = byte > lead[rows, at]
        side = np.where(leaves == width, 0, np.where(above, 1, -1))
        depth = np.where(side < 0, leaves, np.where(side > 0, -leaves, 0))
        byte = np.where(side == 0, 0, byte)
        inner = np.lexsort((byte, depth, side, label[todo]))
        order[todo] = order[todo[inner]]
        fresh = np.zeros(len(order), bool)
        fresh[first] = True
        _, parts = _groups(label[todo], side[inner], depth[inner], byte[inner])
        fresh[todo[np.flatnonzero(np.diff(parts, prepend=-1))]] = True
        unequal = todo[side[inner] != 0]
        first, label = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        todo = unequal


def _repeats(minimizer: np.ndarray, doc: np.ndarray, n: np.ndarray, contents: np.ndarray, ends: np.ndarray,
             length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run, place) of every string that is also in a run of a smaller document; runs are sorted by minimizer."""
    begins, label = _groups(minimizer)
    fewest, most = np.minimum.reduceat(doc, begins), np.maximum.reduceat(doc, begins)
    busy = np.flatnonzero((fewest < most)[label])  # runs whose minimizer is in several documents
    if not len(busy):
        return
    first, label = _groups(minimizer[busy])
    bounds = np.append(first, len(busy))
    weight = np.concatenate([[0], np.cumsum(n[busy])])
    g = 0
    while g < len(first):
        upto = max(g + 1, int(np.searchsorted(weight[bounds], weight[bounds[g]] + TOGETHER, side="right")) - 1)
        part = busy[bounds[g]:bounds[upto]]
        run = np.repeat(part, n[part])
        place = np.arange(len(run)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        starts = (ends[run] - n[run] - length + 1) + place
        strings = np.lib.stride_tricks.sliding_window_view(contents, length)[starts]
        order, classes = deep_shallow_classes(strings, minimizer[run])
        least = np.minimum.reduceat(doc[run][order], np.flatnonzero(np.diff(classes, prepend=-1)))
        again = order[doc[run][order] > least[classes]]
        yield run[again], place[again]
        g = upto


def _pack(*columns: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by ``bucket``, those of one bucket at a time."""
    bucket, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["bucket"] != bucket:
                yield bucket, rows
                rows = []
            bucket = r["bucket"]
            rows.append(r)
    if rows:
        yield bucket, rows


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"integer": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) or [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(columns, schema.fields)], names=schema.names)


def _shared_minimizers(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc, minimizers): those of a document's minimizers that another document has, too.

    Each batch of documents sends its minimizers to the bucket of their hash. A minimizer that several documents of the batch
    have needs no answer and is sent once, so that a very common one costs a row for each batch and not for each document.
    """
    sent = T._parse_datatype_string("bucket int, kind int, docs binary, which binary, minimizers binary")
    answer = T._parse_datatype_string("doc long, minimizers binary")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            owner, _, _, least = runs([t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()], length)
            order = np.lexsort((ids[owner], least))
            owner, least = owner[order], least[order]
            first, label = _groups(least, ids[owner])  # one for each document
            owner, least = owner[first], least[first]
            first, label = _groups(least)
            several = np.bincount(label, minlength=len(first)) > 1
            out = []
            local = several[label]
            if local.any():
                out.append((-1 - int(ids[0]) % buckets, 2, *_pack(ids, owner[local].astype(np.uint16), least[local])))
            for kind, chosen in ((1, first[several]), (0, np.flatnonzero(~local))):
                bucket = (least[chosen] >> np.uint64(20)) % np.uint64(buckets)
                order = np.lexsort((owner[chosen], bucket))
                chosen, bucket = chosen[order], bucket[order].astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    part = chosen[cut[b]:cut[b + 1]]
                    docs, which = np.unique(owner[part], return_inverse=True) if kind == 0 else (owner[part][:0], owner[part][:0])
                    out.append((int(b), kind, *_pack(ids[docs], which.astype(np.uint16), least[part])))
            yield _batch(out, sent)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _grouped(batches):
            docs, least, kinds = [], [], []
            for r in found:
                m = np.frombuffer(r["minimizers"], np.uint64)
                which = np.frombuffer(r["which"], np.uint16)
                docs.append(np.frombuffer(r["docs"], np.int64)[which] if r["kind"] != 1 else np.zeros(len(m), np.int64))
                least.append(m)
                kinds.append(np.full(len(m), r["kind"], np.int8))
            doc, least, kind = np.concatenate(docs), np.concatenate(least), np.concatenate(kinds)
            order = np.lexsort((doc, least))
            doc, least, kind = doc[order], least[order], kind[order]
            first, label = _groups(least)
            asks = kind != 1
            some = np.bincount(label, weights=~asks, minlength=len(first)) > 0
            low, high = (f.reduceat(np.where(asks, doc, far), first) if len(first) else doc
                         for f, far in ((np.minimum, np.iinfo(np.int64).max), (np.maximum, np.iinfo(np.int64).min)))
            chosen = np.flatnonzero((some | (low < high) | (kind[first] == 2))[label] & asks)
            chosen = chosen[np.argsort(doc[chosen], kind="stable")]
            first, _ = _groups(doc[chosen])
            cut = np.append(first, len(chosen))
            yield _batch([(int(doc[chosen[a]]), least[chosen[a:b]].tobytes()) for a, b in zip(cut, cut[1:])], answer)

    asked = rows.mapInArrow(send, sent).repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(reply, answer)


def _repeated_ranges(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc, copy, starts, ends) of what is repeated, from texts with the minimizers that they share with others."""
    sent = T._parse_datatype_string("bucket int, doc long, copy long, starts binary, ends binary, heads binary, contents binary")
    answer = T._parse_datatype_string("doc long, copy long, starts binary, ends binary")

    def spans(ids: np.ndarray, copies: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
        order = np.lexsort((start, copies, ids))
        ids, copies, start, end = ids[order], copies[order], start[order].astype(np.int64), end[order].astype(np.int64)
        first, _ = _groups(ids, copies)
        cut = np.append(first, len(ids))
        return [(int(ids[a]), int(copies[a]), *_pack(start[a:b], end[a:b])) for a, b in zip(cut, cut[1:])]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(i).to_numpy() for i in (0, 1))
            texts = [t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            owner, start, n, least = runs(texts, length)
            kept = np.zeros(len(owner), bool)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, found in enumerate(batch.column(3).to_pylist()):
                wanted = np.unique(np.frombuffer(b"".join(found), np.uint64))
                mine = least[cut[i]:cut[i + 1]]
                at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                kept[cut[i]:cut[i + 1]] = wanted[at] == mine
            owner, start, n, least = owner[kept], start[kept], n[kept], least[kept]
            contents = [texts[o][s:s + k + length - 1] for o, s, k in zip(owner.tolist(), start.tolist(), n.tolist())]
            # equal runs of the batch: the smallest document's stands for all, and the others are repeated
            names = {}
            name = np.array([names.setdefault(c, len(names)) for c in contents], np.int64)
            order = np.lexsort((ids[owner], name))
            first, label = _groups(name[order])
            least_doc = ids[owner[order[first]]] if len(first) else ids[:0]
            again = order[ids[owner[order]] > least_doc[label]]
            out = [(-1 - doc % buckets, doc, copy, *x, None, None) for doc, copy, *x in spans(
                ids[owner[again]], copies[owner[again]], start[again], start[again] + n[again] + length - 1)]
            mark = np.zeros(len(owner), bool)
            mark[order[ids[owner[order]] == least_doc[label]]] = True
            chosen = np.flatnonzero(mark)
            bucket = ((least[chosen] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((least[chosen], bucket))
            chosen, bucket = chosen[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                part = chosen[cut[b]:cut[b + 1]]
                heads = np.stack([least[part].astype(np.int64), ids[owner[part]], copies[owner[part]], start[part], n[part]])
                out.append((int(b), None, None, None, None, heads.tobytes(), b"".join([contents[c] for c in part])))
            yield _batch(out, sent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, found in _grouped(batches):
            if bucket < 0:
                yield _batch([(r["doc"], r["copy"], r["starts"], r["ends"]) for r in found], answer)
                continue
            least, ids, copies, start, n = np.hstack([np.frombuffer(r["heads"], np.int64).reshape(5, -1) for r in found])
            contents = np.frombuffer(b"".join(r["contents"] for r in found), np.uint8)
            ends = np.cumsum(n + length - 1)
            order = np.argsort(least, kind="stable")
            ids, copies, start, n, ends = ids[order], copies[order], start[order], n[order], ends[order]
            for run, place in _repeats(least[order], ids, n, contents, ends, length):
                # strings that start one after the other are one range
                if not len(run):
                    continue
                by_place = np.lexsort((place, run))
                run, place = run[by_place], place[by_place]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(run) != 0) | (np.diff(place) != 1)]))
                last = np.append(new[1:], len(run)) - 1
                yield _batch(spans(ids[run[new]], copies[run[new]], start[run[new]] + place[new],
                                   start[run[new]] + place[last] + length), answer)

    sent_rows = rows.mapInArrow(send, sent).repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return sent_rows.mapInArrow(judge, answer)


def remove_repeats(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` without each byte that is covered by a string of ``length`` bytes that also starts in a document of smaller id.

    Texts are UTF-8 bytes, null: empty. Strings don't cross documents; they are judged on the input, not on what is left.
    Adds ``n_bytes, n_removed, n_spans`` (maximal removed runs) and ``kept`` (binary: the remaining bytes; with ``as_text`` a string of the
    characters all of whose bytes remain), in place of columns of these names; the text column stays as it was. Documents under ``length`` bytes stay whole. Rows of one id, equal or not, take nothing
    from each other; a null id is smaller than all others. No rows give no rows.

    A text that an earlier document has as a whole is removed as a whole. For the others: minimizers that several documents
    share, then the runs of strings with these minimizers, which are sorted and compared. Very common strings are
    reduced to one for each batch before they are shuffled.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"strings of at least {2 * ANCHOR} bytes are compared")
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(doc.alias("doc"), F.xxhash64(body, F.length(body)).alias("copy"), body.alias("text"))
    buckets = 4 * partitions(spark)

    names = materialize(rows.select("doc", "copy", F.md5(F.col("text").cast("binary")).alias("name")), "names")
    earliest = materialize(names.groupBy("name").agg(F.min("doc").alias("least")), "earliest")  # joined as a table, a hot name can be split
    whole = names.join(earliest, "name").where("doc > least").select("doc", "copy").distinct()
    whole = materialize(whole, "whole")

    shared = materialize(_shared_minimizers(rows, length, buckets), "minimizers")
    asked = shared.groupBy("doc").agg(F.collect_list("minimizers").alias("found"))
    single = rows.join(asked, "doc").join(whole, ["doc", "copy"], "left_anti").select("doc", "copy", "text", "found")
    ranges = materialize(_repeated_ranges(single, length, buckets), "ranges")
    cut = ranges.groupBy("doc", "copy").agg(F.collect_list(F.struct("starts", "ends")).alias("_cut")).unionByName(
        whole.select("doc", "copy", F.lit(None).cast("array<struct<starts:binary,ends:binary>>").alias("_cut")))
    cut = cut.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "_cut", F.lit(True).alias("_any"))

    added = T._parse_datatype_string(f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}").fields
    plain = docs.drop(*(f.name for f in added))
    keyed = plain.withColumns({"_doc": doc, "_copy": F.xxhash64(body, F.length(body))})
    joined = keyed.join(cut, same(keyed, cut, ["_doc", "_copy"]), "left").select(*(keyed[c] for c in plain.columns), "_cut", "_any")
    schema = T.StructType([*plain.schema.fields, *added])
    at, kind = plain.columns.index(text), pa.string() if as_text else pa.binary()

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            found, some = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for t, parts, any_ in zip(batch.column(at).to_pylist(), found, some):
                raw = (t or "").encode("utf-8", "replace")
                if not any_ or len(raw) < length:
                    out.append((len(raw), 0, 0, raw))
                elif parts is None:
                    out.append((len(raw), len(raw), 1, b""))
                else:
                    starts, ends = (np.frombuffer(b"".join(p[c] for p in parts), np.int64) for c in ("starts", "ends"))
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, ends, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    spans, removed, own = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), int(gone.sum()), np.frombuffer(raw, np.uint8)
                    if as_text:
                        characters = np.flatnonzero(own & 0xC0 != 0x80)
                        gone = np.repeat(np.logical_or.reduceat(gone, characters), np.diff(np.append(characters, len(own))))
                    out.append((len(raw), removed, spans, own[~gone].tobytes()))
            sizes, removed, spans, kept = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(kept, pa.binary()).cast(kind)], names=schema.names)

    return joined.mapInArrow(take_out, schema)
