"""BPE, token counts, packing and fingerprints against the tokenizers library and plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from filemason.llm import bpe, fingerprints, packing, token_counts

from .conftest import TEXTS

random.seed(5)
ALPHABET = "abcdethn  \n\t'.,-1é日<|end>ABC\0"
RANDOM = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 60))) for _ in range(400)]
ODD = [t or "" for _, t in TEXTS] + ["  a  b", "\x1c x\x1fy \x85z\xa0 w", "aaaa" * 50, "foo \nbar", "½²Ⅷ x", "İ Σ"]


@pytest.fixture(scope="module")
def byte_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


def test_automaton_equals_the_library(byte_path):
    library, machine = Tokenizer.from_file(byte_path), bpe.compile_automaton(byte_path)
    names = list(library.get_vocab())[:5000]
    texts = ODD + RANDOM + ["".join(random.choice(names) for _ in range(8)) for _ in range(300)]
    encoder = bpe.Encoder(machine)
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.texts(texts)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == want
    for word in ("hello", "ing" * 20, "é日"):
        assert encoder.word(word.encode()) == library.encode(word, add_special_tokens=False).ids
    for ids in want:
        assert b"".join(machine.labels[i] for i in ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_long_runs_without_a_space(byte_path):
    import time

    library, encoder = Tokenizer.from_file(byte_path), bpe.Encoder(bpe.compile_automaton(byte_path))
    for run in ("".join(random.choice("abcdefghij") for _ in range(1_000_000)), "-" * 100_000, "ab" * 100_000):
        start = time.perf_counter()
        got = np.frombuffer(encoder.texts([run])[0], "<i4").tolist()
        assert time.perf_counter() - start < 4
        assert got[:900] == library.encode(run[:60_000], add_special_tokens=False).ids[:900]


def test_special_strings_in_other_cases(word_path):
    library, encoder = Tokenizer.from_file(word_path), packing.WordEncoder(bpe.compile_automaton(word_path))
    for text in ("<|ENDOFTEXT|> a", "x <|endoftext|> <|EndOfText|> y", "It's 'Quoted', 1.5 - l'été. done.,"):
        assert np.frombuffer(encoder.texts([text])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_merge_gadget_on_small_merge_lists(tmp_path):
    """Every string over two letters, for merge lists with overlaps and repeats, against one-merge-at-a-time replacement."""
    import itertools
    import json

    for merges in (["a a"], ["a b", "b a", "ab a"], ["a a", "aa a", "aa aa"], ["b b", "a b", "ab b", "a a", "aa b"]):
        names = list(bpe.byte_symbols()) + [m.replace(" ", "") for m in merges]
        path = tmp_path / "t.json"
        path.write_text(json.dumps({"model": {"vocab": {n: i for i, n in enumerate(dict.fromkeys(names))}, "merges": merges}}))
        machine = bpe.compile_automaton(str(path))
        encoder = bpe.Encoder(machine)
        for n in range(1, 9):
            for letters in itertools.product("ab", repeat=n):
                parts = list(letters)
                for left, right in (m.split() for m in merges):
                    i = 0
                    while i < len(parts) - 1:
                        if parts[i:i + 2] == [left, right]:
                            parts[i:i + 2] = [left + right]
                        i += 1
                assert [machine.labels[t].decode() for t in encoder.word("".join(letters).encode())] == parts


def test_encode_and_decode_rows(spark, messy, nothing, byte_path):
    encoded = bpe.encode(messy, byte_path)
    back = bpe.decode(encoded, byte_path, ["doc_id", "ids"]).collect()
    library = Tokenizer.from_file(byte_path)
    want = sorted((str(i), t or "", library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["decoded"], r["ids"]) for r in back) == want
    assert bpe.encode(nothing, byte_path).count() == 0


def test_token_counts_equal_the_library(messy, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, unknown = token_counts.sentencepiece_vocabulary(path)
    library = Tokenizer(models.Unigram(vocabulary, unknown, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.UnigramCounter(vocabulary, unknown)
    assert [counter.text(t) for t in ODD + RANDOM] == [len(library.encode(t).ids) for t in ODD + RANDOM]
    rows = token_counts.count_tokens(messy, lambda: token_counts.sentencepiece_vocabulary(path), name=path).collect()
    assert sorted((str(r[0]), r[1]) for r in rows) == sorted((str(i), len(library.encode(t or "").ids)) for i, t in TEXTS)
    assert token_counts.count_tokens(nothing, lambda: (vocabulary, unknown)).count() == 0


def test_unigram_ties_and_unknown_runs():
    for _ in range(200):
        pieces = {"<unk>": 0.0} | {"".join(random.choice("ab▁") for _ in range(random.randint(1, 4))): -float(random.randint(0, 4)) for _ in range(8)}
        library = Tokenizer(models.Unigram(list(pieces.items()), 0, False))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_counts.UnigramCounter(list(pieces.items()), 0, False)
        for _ in range(10):
            text = "".join(random.choice("abc ") for _ in range(random.randint(0, 12)))
            assert counter.text(text) == len(library.encode(text).ids), (pieces, text)


def test_word_encoder_equals_the_library(word_path):
    library, encoder = Tokenizer.from_file(word_path), packing.WordEncoder(bpe.compile_automaton(word_path))
    texts = ODD + RANDOM
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.texts(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_respects_every_capacity():
    rng = random.Random(1)
    for _ in range(150):
        capacity, counts = rng.choice([8, 20, 50]), {}
        for _ in range(rng.randint(0, 300)):
            length = min(capacity, max(1, int(rng.expovariate(3 / capacity))))
            counts[length] = counts.get(length, 0) + 1
        documents, cost, rule = rng.choice([None, 3]), rng.choice([None, capacity * capacity]), rng.choice(["dot", "norm"])
        placed, bins = set(), {}
        for length, first, n, sequence, offset in packing.best_fit_plan(counts, capacity, documents, cost, rule):
            for k in range(n):
                assert (length, first + k) not in placed
                placed.add((length, first + k))
                bins.setdefault(sequence + k, []).append((offset, length))
        assert placed == {(length, k) for length, n in counts.items() for k in range(n)}
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= capacity and len(content) <= (documents or capacity)
            assert cost is None or sum(n * n for _, n in content) <= cost
        if documents is None and counts:
            assert len(bins) <= 1.25 * sum(n * c for n, c in counts.items()) / capacity + 1
    with pytest.raises(ValueError):
        packing.best_fit_plan({9: 1}, 8)


def test_packed_pieces_are_whole(spark, messy, nothing, word_path):
    rows = packing.pack(packing.tokenize_pieces(messy, word_path, 64), 64).collect()
    library = Tokenizer.from_file(word_path)
    want = sorted(str(library.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in TEXTS if t != "one")
    whole, bins = {}, {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] <= 256
    got = sorted(str(np.frombuffer(b"".join(x for _, x in sorted(parts)), "<u4").tolist()) for i, parts in whole.items() if i not in (8, 9))
    assert got == want
    assert all(sum(n for _, n in b) <= 64 and sorted(b)[0][0] == 0 for b in bins.values())
    assert packing.pack(packing.tokenize_pieces(nothing, word_path, 64), 64).count() == 0


def test_fingerprints(spark, messy, nothing, monkeypatch):
    texts = [t or "" for _, t in TEXTS]
    prints = fingerprints.digests(texts)
    assert prints[0] == prints[4] and len(set(map(len, prints))) == 1
    monkeypatch.setattr(fingerprints, "CHUNK", 50)
    assert fingerprints.digests(texts) == prints  # piece by piece as in one go
    assert list(fingerprints.likeness(prints, prints)) == [1.0] * len(prints)
    near = fingerprints.likeness([prints[5]], [prints[-1]])[0]
    assert near > fingerprints.likeness([prints[5]], [prints[0]])[0]
    assert sorted(r["fingerprint"] for r in fingerprints.fingerprint(messy).collect()) == sorted(prints)
    assert fingerprints.fingerprint(nothing).count() == 0


def test_next_documents(spark, messy, nothing):
    def edit(a, b):
        half = len(a) // 2
        return a[:len(a) - half] + b[:half]

    rows = fingerprints.compare_with_next(messy, edit).collect()
    order = sorted(TEXTS, key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))
    texts = [t or "" for _, t in order]
    want = sorted((str(i), len(t), hashlib.sha256(edit(t, texts[(k + 1) % len(texts)]).encode()).hexdigest())
                  for k, ((i, _), t) in enumerate(zip(order, texts)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.compare_with_next(nothing, edit).count() == 0
    alone = fingerprints.compare_with_next(messy.where("doc_id = 1"), edit).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
