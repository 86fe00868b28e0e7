"""Best-fit packing of tokenized documents into sequences, with several capacities at once."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import bpe
from .common import kept, rank_in_group, small_batches

#: How the word tokenizer splits lower-cased text before merging (public pattern, fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder(bpe.Encoder):
    """Ids of texts under a lower-casing BPE vocabulary with word ends, in which white space only separates words.

    The normal form is NFC in lower case. No word crosses white space, so words between spaces are
    looked up one by one; those not met before are split and go through the automaton together.
    """

    #: Words and what stands between spaces that a task keeps; then it starts afresh.
    KEPT = 700_000

    def __init__(self, automaton: bpe.Automaton) -> None:
        import regex

        super().__init__(automaton)
        self.words_in = regex.compile(WORD_PATTERN).findall

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # one character at a time where the case of a letter depends on what stands around it
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _split_word(self, part: str) -> list[str]:
        if part[-1] in ",." and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.words_in(part)

    def texts(self, texts: list[str]) -> list[bytes]:
        special, parts = {s: np.array([i], "<i4").tobytes() for s, i in self.machine.special.items()}, self.parts
        cut = [[p for p in self.special.split(t) if p] if special and any(s in t for s in special) else [t] for t in texts]
        rows = [[None if s in special else self._normal(s).replace("\n", " ").split(" ") for s in segments] for segments in cut]
        if len(parts) > self.KEPT:
            parts.clear()
        parts[""] = b""
        missing = {w for w in set().union(*(r for segments in rows for r in segments if r)) if w not in parts}
        split = {w: self._split_word(w) for w in missing if not w.isalpha()}
        words = missing.difference(split)  # letters alone are one word, also where they stand in a longer part
        words |= {x for found in split.values() for x in found if x not in parts}
        marked = {x for x in words if "\0" in x}  # a zero byte in a text is no word's end
        parts.update(self.ids(words - marked, b"\0"))
        parts.update((x, self._with_zeros(x)) for x in marked)
        parts.update((w, b"".join([parts[x] for x in found])) for w, found in split.items())
        get = parts.__getitem__
        out = [b"".join([special[s] if r is None else b"".join(map(get, r)) for s, r in zip(segments, found)])
               for segments, found in zip(cut, rows)]
        for w in [w for w in missing | words if len(w) > 64]:
            del parts[w]
        return out

    def _with_zeros(self, word: str) -> bytes:
        """A zero byte's own token is merged with nothing, so the word is what stands between zero bytes."""
        zero, last = self.machine.zero
        found: list[bytes] = []
        pieces = word.encode("utf-8", "replace").split(b"\0")
        for i, piece in enumerate(pieces):
            ending = i == len(pieces) - 1
            found.append(np.array(self.word(piece + b"\0" if ending else piece), "<i4").tobytes() if piece else b"")
            if not ending:
                found.append(np.array([last if i == len(pieces) - 2 and not pieces[-1] else zero], "<i4").tobytes())
        return b"".join(found)


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids)``: each document's tokens and then ``end_id``, cut where they exceed ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers. Null texts are empty and give one piece with the end alone; equal rows
    give equal pieces. ``path`` is a tokenizers file of a lower-casing BPE model with word ends.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("piece int, start long, length long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"word bpe {path}", lambda: WordEncoder(bpe.automaton(path)))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for i, found in enumerate(encoder.texts(batch.column(1).to_pylist())):
                found += end
                for at in range(0, len(found), 4 * capacity):
                    part = found[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def best_fit_plan(counts: dict[int, int], capacity: int, documents: int | None = None, cost: int | None = None, rule: str = "norm",
                  weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)) -> list[tuple[int, int, int, int, int]]:
    """Vector best fit for ``counts`` pieces of each length: ``(length, first, n, sequence, offset)`` says that the pieces
    number first … first + n - 1 of that length go to the sequences from ``sequence`` on, one each, at ``offset``.

    A sequence has three residual capacities: tokens, documents (None: as many as tokens) and attention cost, the sum
    of squared lengths (None: the capacity's square); a piece takes its length, one and its squared length. Longest
    pieces come first. Of the sequences in which a piece fits under all three, it goes to the one with the largest
    weighted dot product of piece and residual ('dot') or the smallest weighted norm of what is left ('norm'), all in shares
    of the capacities; if it fits nowhere, it opens one. Sequences in the same state are one group, and pieces of a length
    are placed together, so the work depends on the lengths (at most ``capacity``), not on the pieces.
    """
    full = np.array([capacity, documents or capacity, cost or capacity * capacity], np.float64)
    w = np.array(weights)
    if rule not in ("dot", "norm"):
        raise ValueError(f"unknown rule: {rule}")
    # a row for each group: first sequence, number of sequences, residual capacities
    groups, used, plan, fresh = np.zeros((1024, 5)), 0, [], 0

    def add(*row: float) -> None:
        nonlocal groups, used
        if used == len(groups):
            groups = np.vstack([groups, np.zeros_like(groups)])
        groups[used] = row
        used += 1

    for length in sorted(counts, reverse=True):
        size = np.array([length, 1, length * length], np.float64)
        if (size > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        placed, wanted = 0, counts[length]
        while placed < wanted:
            fits = np.flatnonzero((groups[:used, 2:] >= size).all(axis=1))
            if len(fits):
                share = groups[fits, 2:] / full
                score = share @ (w * size / full) if rule == "dot" else -((share - size / full) ** 2 @ w)
                best = int(fits[np.argmax(score)])
                n = min(int(groups[best, 1]), wanted - placed)
                plan.append((length, placed, n, int(groups[best, 0]), int(capacity - groups[best, 2])))
                add(groups[best, 0], n, *(groups[best, 2:] - size))
                groups[best, 0] += n
                groups[best, 1] -= n
                if not groups[best, 1]:
                    used -= 1
                    groups[best] = groups[used]
                placed += n
                continue
            each = max(1, int(min(full // size)))
            bins = max(1, (wanted - placed) // each)
            take = min(each, wanted - placed)
            for k in range(take):
                plan.append((length, placed, bins, fresh, k * length))
                placed += bins
            add(fresh, bins, *(full - take * size))
            fresh += bins
        open_ones = groups[:used][groups[:used, 2:].min(axis=1) > 0]
        used = len(open_ones)
        groups[:used] = open_ones
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, documents: int | None = None, cost: int | None = None, rule: str = "norm",
         order: list[str] | None = None, **options) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` between 1 and ``capacity``, by ``best_fit_plan``.

    Only the number of pieces of each length (at most ``capacity`` numbers) goes to the driver, and the plan back to
    the tasks (its size depends on the lengths alone). Each piece is numbered among those of its length,
    also when one length has most pieces, and finds its place in the plan by that number. Equal pieces are packed one by
    one; no rows give no rows. Columns named ``sequence_id`` or ``offset`` are replaced.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length: dict[int, list] = {}
    for length, *step in best_fit_plan(counts, capacity, documents, cost, rule, **options):
        by_length.setdefault(length, []).append(step)
    shared = pieces.sparkSession.sparkContext.broadcast({n: np.array(sorted(s), np.int64) for n, s in by_length.items()})
    ranked = rank_in_group(pieces, ["length"], order or [c for c in ("doc_id", "piece") if c in pieces.columns], "_number")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            lengths, numbers = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                plan = steps[int(length)]
                step = plan[np.searchsorted(plan[:, 0], numbers[own] - 1, side="right") - 1]
                sequence[own], offset[own] = step[:, 2] + numbers[own] - 1 - step[:, 0], step[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)
