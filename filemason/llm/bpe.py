"""Byte-pair encoding by a tokenization automaton, and decoding by its arcs' labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, per_text, small_batches

#: How the byte-level tokenizers split text before merging (public pattern, fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a task keeps; then it starts afresh, so its memory is bounded.
KEPT_WORDS, KEPT_PARTS = 350_000, 500_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, mapped to its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Automaton:
    """Deterministic automaton over tokens that accepts exactly the merged token sequences.

    After token t the automaton is in ``state[t]``; token u may follow unless the bit ``kind[u]`` of that
    state's row in ``barred`` is set. ``tokens`` maps the labels of the usable arcs to tokens, ``labels`` has the bytes
    of every token, special ones too, ``special`` the strings that are tokens of their own.
    """

    tokens: dict[bytes, int]
    labels: dict[int, bytes]
    special: dict[str, int]
    state: list[int]
    kind: list[int]
    barred: bytes
    stride: int
    zero: tuple[int, int]  # the tokens of a zero byte inside and at the end of a word


def token_labels(path: str) -> tuple[dict[int, bytes], dict[str, int], dict]:
    """The bytes of every token (a word's end is a zero byte behind its last one), the special strings, and the model of the file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    symbol, end = byte_symbols(), model["model"].get("end_of_word_suffix") or ""

    def label(name: str) -> bytes:
        inside = name[:-len(end)] if end and name.endswith(end) and name != end else name
        return bytes(symbol[c] for c in inside) + bytes(inside != name)

    labels = {i: label(name) for name, i in model["model"]["vocab"].items()}
    special = {a["content"]: a["id"] for a in model.get("added_tokens", [])}
    for content, i in special.items():
        labels.setdefault(i, bytes(symbol[c] for c in content) if all(c in symbol for c in content) else content.encode())
    return labels, special, model["model"]


def compile_automaton(path: str) -> Automaton:
    """Merge by merge, from a tokenizers file with a byte-level BPE model.

    At first there is one state with a loop for each byte. The gadget of merge (u, v) → w: u gets a state of
    its own in which v is barred; w leads where v leads, and is allowed where u is allowed. If v was
    already barred after u, the merge never happens and w has no arc. Tokens share a state (or a kind: being
    barred in the same states) until a merge tells them apart, so the table has one row per distinct state.
    """
    labels, special, model = token_labels(path)
    symbol = byte_symbols()
    vocabulary, merges = model["vocab"], model["merges"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    end = model.get("end_of_word_suffix") or ""
    state, kind = np.zeros(max([*labels, *special.values()]) + 1, int), None
    kind = state.copy()
    reached = {vocabulary[c + e] for c in symbol for e in {"", end} if c + e in vocabulary}
    sharing, like = {0: len(reached)}, {0: len(reached)}
    rows, columns = 1024, 1024
    barred = np.zeros((rows, columns // 8), np.uint8)  # a bit per state and kind
    place = lambda k: (int(k) >> 3, np.uint8(7 - (int(k) & 7)))  # noqa: E731  byte and shift of a kind

    def own(of: np.ndarray, token: int, share: dict[int, int], always: bool = False) -> tuple[int, int]:
        """Give a token a state or kind of its own, if others share it; (its old one, its present one)."""
        old = int(of[token])
        if share[old] > 1 or always:
            share[old] -= 1
            of[token] = len(share)
            share[len(share)] = 1
        return old, int(of[token])

    for left, right in merges:
        u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
        at, shift = place(kind[v])
        if u not in reached or v not in reached or w in reached or barred[state[u], at] >> shift & 1:
            continue
        if len(sharing) + 1 >= rows or len(like) + 1 >= columns:
            more = (rows * 2 if len(sharing) + 1 >= rows else rows, columns * 2 if len(like) + 1 >= columns else columns)
            larger = np.zeros((more[0], more[1] // 8), np.uint8)
            larger[:rows, :columns // 8] = barred
            barred, (rows, columns) = larger, more
        leads = int(state[v])
        old, now = own(state, u, sharing, always=u == v)
        if now != old:
            barred[now] = barred[old]
        old, now = own(kind, v, like)
        at, shift = place(now)
        if now != old:
            old_at, old_shift = place(old)
            barred[:, at] |= (barred[:, old_at] >> old_shift & 1) << shift
        barred[state[u], at] |= np.uint8(1) << shift
        state[w], kind[w] = leads, kind[u]
        sharing[leads] += 1
        like[int(kind[u])] += 1
        reached.add(w)
    packed = barred[:len(sharing), :(len(like) + 7) // 8]
    usable = {labels[t]: t for t in reached if not end or labels[t].strip(b"\0")}  # with word ends, no word holds a zero byte
    return Automaton(usable, labels, special, state.tolist(), kind.tolist(), packed.tobytes(), packed.shape[1],
                     tuple(vocabulary.get(next(c for c in symbol if not symbol[c]) + e, -1) for e in ("", end)))


class Arcs:
    """The usable tokens' labels as a table of transitions by one byte: ``step[node << 8 | byte]`` is the next node and
    ``token[node]`` the token whose label ends there (-1: none). The table is kept as a dict for single words and, by hashing
    into a power of two of slots, as arrays for many words at once."""

    SHIFT, FACTOR = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, tokens: dict[bytes, int]) -> None:
        step, ends = {}, [-1]
        for label, token in tokens.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = step.get(key)
                if node is None:
                    node = step[key] = len(ends)
                    ends.append(-1)
            ends[node] = token
        self.step, self.ends, self.token = step, ends, np.array(ends, np.int32)
        while len(step) * 2 > 1 << self.SHIFT:
            self.SHIFT += 1
        self.keys, self.nodes = np.full(1 << self.SHIFT, -1, np.int64), np.zeros(1 << self.SHIFT, np.int32)
        keys, nodes = np.array([*step], np.int64), np.array([*step.values()], np.int32)
        at = self._slot(keys)
        while len(keys):  # a slot goes to one of the keys that want it; the others move on
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]], self.nodes[at[free]] = keys[free], nodes[free]
            left = np.flatnonzero(self.keys[at] != keys)
            won = np.flatnonzero(self.keys[at] == keys)
            self.nodes[at[won]] = nodes[won]
            keys, nodes, at = keys[left], nodes[left], at[left] + 1 & (1 << self.SHIFT) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.FACTOR >> np.uint64(64 - self.SHIFT)).astype(np.int64)

    def follow(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node of each, or -1."""
        keys = nodes.astype(np.int64) << 8 | byte
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.nodes[at], -1)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = at[more] + 1 & (1 << self.SHIFT) - 1
            there = self.keys[at[more]]
            hit = there == keys[more]
            out[more[hit]] = self.nodes[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out


class Encoder:
    """Ids of whole texts, as little-endian 32-bit numbers."""

    #: Words of up to so many bytes go through the automaton together.
    TOGETHER = 32

    def __init__(self, automaton: Automaton) -> None:
        import regex

        self.machine, self.split = automaton, regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, automaton.special)) + ")") if automaton.special else None
        self.crowded = re.compile(r"\s\s|^\s|\s\Z").search
        self.words: dict[str, bytes] = {}  # ids of a pre-split word
        self.parts: dict[str, bytes] = {}  # ids of what stands between two single spaces, with the first of them
        self.barred = np.frombuffer(automaton.barred, np.uint8).reshape(-1, automaton.stride)
        self.state, self.kind = np.array(automaton.state, np.int32), np.array(automaton.kind, np.int32)
        self.arcs = Arcs(automaton.tokens)

    def word(self, word: bytes) -> list[int]:
        """The tokens of a pre-split word of any length: from each byte that an accepted sequence reaches, the transitions are
        followed byte by byte, and a token that ends on the way is taken if the state before allows it. Each prefix has one
        accepted sequence at most; ``last[i]`` is the token that ends the one of the first i bytes."""
        n, machine = len(word), self.machine
        step, ends, state, kind, barred, stride = self.arcs.step.get, self.arcs.ends, machine.state, machine.kind, machine.barred, machine.stride
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            if start and last[start] < 0:
                continue
            row, node = state[last[start]] * stride if start else -1, 0
            for at in range(start, n):
                node = step(node << 8 | word[at])
                if node is None:
                    break
                t = ends[node]
                if t >= 0:
                    k = kind[t]
                    if row < 0 or not barred[row + (k >> 3)] >> (7 - (k & 7)) & 1:
                        last[at + 1], came[at + 1] = t, start
        found = []
        while n:
            found.append(last[n])
            n = came[n]
        return found[::-1]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """``word`` for many words at once, each up to ``TOGETHER`` bytes long: one array operation for a step of all."""
        m, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")  # the longest first: those that reach a byte are a head of the arrays
        lengths = lengths[order]
        n = int(lengths[0])
        text = np.frombuffer(b"".join([words[i].ljust(n, b"\0") for i in order.tolist()]), np.uint8).reshape(m, n).T.copy()
        reach = np.searchsorted(-lengths, -np.arange(n + 1), side="right")  # words of at least i bytes
        last, came = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int8)
        for start in range(n):
            rows = np.arange(reach[start + 1]) if not start else np.flatnonzero(last[start, :reach[start + 1]] >= 0)
            nodes, states = np.zeros(len(rows), np.int32), self.state[last[start, rows]] if start else None
            for end in range(start + 1, n + 1):
                inside = np.searchsorted(rows, reach[end])
                if not inside:
                    break
                rows, nodes = rows[:inside], nodes[:inside]
                nodes = self.arcs.follow(nodes, text[end - 1, rows])
                alive = np.flatnonzero(nodes >= 0)
                rows, nodes = rows[alive], nodes[alive]
                token = self.arcs.token[nodes]
                if start:
                    states = states[:inside][alive]
                    hit = np.flatnonzero(token >= 0)
                    k = self.kind[token[hit]]
                    hit = hit[self.barred[states[hit], k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1 == 0]
                else:
                    hit = np.flatnonzero(token >= 0)
                last[end, rows[hit]], came[end, rows[hit]] = token[hit], start
        ids, used, at, rows = np.zeros((m, n), "<i4"), np.zeros(m, np.int64), lengths.copy(), np.arange(m)
        while len(rows):
            used[rows] += 1
            ids[rows, n - used[rows]] = last[at[rows], rows]
            at[rows] = came[at[rows], rows]
            rows = rows[at[rows] > 0]
        joined, begin = ids.tobytes(), (np.arange(m) * n + n - used) * 4
        out: list[bytes] = [b""] * m
        for i, x, y in zip(order.tolist(), begin.tolist(), range(4 * n, 4 * n * m + 1, 4 * n)):
            out[i] = joined[x:y]
        return out

    def ids(self, words: Iterable[str], end: bytes = b"") -> Iterator[tuple[str, bytes]]:
        """Words with their ids; ``end`` is what marks the end of a word."""
        short: list[str] = []
        raws: list[bytes] = []
        for w in words:
            raw = w.encode("utf-8", "replace") + end
            if len(raw) <= self.TOGETHER:
                short.append(w)
                raws.append(raw)
            else:
                yield w, np.array(self.word(raw), "<i4").tobytes()
        for i in range(0, len(short), 20_000):
            yield from zip(short[i:i + 20_000], self._together(raws[i:i + 20_000]))

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet."""
        if len(self.words) + len(words) > KEPT_WORDS:
            self.words.clear()
        self.words.update(self.ids(words))

    def _split(self, part: str) -> list[str]:
        """``PATTERN`` on a part with one leading space: plain words, also before a comma or full stop, need no search."""
        if part[1:].isalpha():
            return [part]
        if part[-1] in ",." and part[1:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.split(part)

    def _pieces(self, text: str) -> list[str]:
        """Parts with a cut before each single space that stands between two other characters: there a word begins in any
        case. Parts after the first are given without that space, those that can't be cut as the whole text."""
        return [text] if self.crowded(text) else text.split(" ")

    def texts(self, texts: list[str]) -> list[bytes]:
        cut = [[p for p in self.special.split(t) if p] if self.special and any(s in t for s in self.machine.special) else [t]
               for t in texts]
        pieces = [[self._pieces(s) for s in segments] for segments in cut]
        parts, wholes = self.parts, {p[0] for segments in pieces for p in segments if p[0] not in self.machine.special}
        if len(parts) > KEPT_PARTS:
            parts.clear()
        missing = {w for w in set().union(*(p[1:] for segments in pieces for p in segments)) if w not in parts}
        wanted = {" " + w: w for w in missing}
        split = {w: self._split(w) for w in wanted} | {w: self.split(w) for w in wholes}
        unknown = {x for found in split.values() for x in found}
        words = {x for x in unknown if x not in self.words}
        known = {x: self.words[x] for x in unknown - words}
        self.learn(words)
        known |= {x: self.words[x] for x in words}
        ids = {w: b"".join([known[x] for x in found]) for w, found in split.items()}
        parts.update((bare, ids[w]) for w, bare in wanted.items())
        special = {s: np.array([i], "<i4").tobytes() for s, i in self.machine.special.items()}
        get = parts.__getitem__
        out = [b"".join([special[p[0]] if p[0] in special else ids[p[0]] + b"".join(map(get, p[1:])) for p in segments])
               for segments in pieces]
        for w in [w for w in missing if len(w) > 64]:
            del parts[w]
        for w in [w for w in words if len(w) > 64]:
            del self.words[w]
        return out


def automaton(path: str) -> Automaton:
    """The compiled automaton of a vocabulary, compiled once in a Python worker: its size is that of the vocabulary, some 20 MB for
    50 000 tokens, and nothing of it goes through the driver."""
    return kept(f"automaton {path}", lambda: compile_automaton(path))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for every row: the ids of the whole text (null: empty) without added special tokens.

    ``path`` is a tokenizers file with a byte-level BPE model that executors can read; strings of its special tokens in a text
    become those tokens. One pass without a shuffle. Empty texts have no ids; equal rows equal ids.
    """
    def start() -> Callable:
        encoder = kept(f"bpe {path}", lambda: Encoder(automaton(path)))

        def run(texts: list[str]) -> list[pa.Array]:
            found = encoder.texts(texts)
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))]

        return run

    return per_text(docs, id_column, text, start, "ids array<int>")


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``decoded``: the arc labels of the ids, joined; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    small_batches(encoded.sparkSession)
    rows = encoded.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def run(batches):
        label = kept(f"labels {path}", lambda: token_labels(path)[0]).__getitem__
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            texts = [b"".join(map(label, values[a:b])).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
