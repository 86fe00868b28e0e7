"""Token counts of a unigram vocabulary: the best segmentation's score and number of pieces, without its pieces."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from .common import kept, per_text

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a task keeps; then it starts afresh, so its memory is bounded.
KEPT_WORDS = 300_000


def sentencepiece_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores and the unknown id of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())], model.unk_id()


class UnigramCounter:
    """Number of tokens that a unigram tokenizer gives for a word (spaces as ``▁``, before each word).

    An Aho-Corasick automaton enumerates the vocabulary matches in a word; going through their ends, each
    position keeps the best score up to it and its number of pieces. Ties follow the tokenizers library:
    of equal scores the one whose last piece starts first wins, a character without a piece of its own is
    unknown at the lowest score less ten, and a run of unknown characters is one token, or the bytes
    of its characters where all bytes are in the vocabulary.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]], unknown: int, byte_fallback: bool = True) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.machine.add_word(piece, (len(piece), score, i))
        self.machine.make_automaton()
        self.unknown = unknown
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        names = {piece for piece, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        n = len(text)
        if n == 0:
            return 0
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
        single = bytearray(n)
        for end, match in self.machine.iter(text):
            ends[end].append(match)
            if match[0] == 1:
                single[end] = 1
        score, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best, start_of_best, piece_of_best = None, -1, -1
            matches = ends[end] if single[end] else [*ends[end], (1, self.unknown_score, self.unknown)]
            for size, value, piece in sorted(matches, reverse=True):  # earliest start first
                found = score[end + 1 - size] + value
                if best is None or found > best:
                    best, start_of_best, piece_of_best = found, end + 1 - size, piece
            score[end + 1] = best
            if piece_of_best != self.unknown:
                count[end + 1] = count[start_of_best] + 1
            elif self.bytes:
                count[end + 1] = count[start_of_best] + len(text[start_of_best:end + 1].encode("utf-8", "replace"))
            else:
                count[end + 1] = count[start_of_best] + (not open_run[start_of_best])
            open_run[end + 1] = piece_of_best == self.unknown
        return count[n]

    def text(self, text: str) -> int:
        """Tokens of a whole text: ``▁`` before it and for each space, a word from each ``▁`` to the next."""
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        if words[0] == "" and len(words) > 1:
            words = words[1:]  # the text starts with a space, which serves as the first mark
        known, total, missing = self.known, 0, []
        for w in words:
            n = known.get(w)
            if n is None:
                missing.append(w)
            else:
                total += n
        for w in missing:
            n = known.get(w)
            if n is None:
                n = self.word(SPACE + w)
                if len(known) >= KEPT_WORDS:
                    known.clear()
                if len(w) <= 64:
                    known[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: Callable[[], tuple[list[tuple[str, float]], int]], id_column: str = "doc_id",
                 text: str = "text", byte_fallback: bool = True, name: str = "") -> DataFrame:
    """``(id, n_tokens)`` for every row; null and empty texts have 0 tokens, equal rows equal counts.

    ``vocabulary`` is called in the tasks and gives pieces with scores and the unknown piece's number.
    One pass without a shuffle; other columns are not read. Under a ``name`` for the vocabulary, a worker keeps
    its automaton from task to task.
    """
    def start() -> Callable:
        fresh = lambda: UnigramCounter(*vocabulary(), byte_fallback)
        counter = kept(f"unigram {name} {byte_fallback}", fresh) if name else fresh()
        return lambda texts: [[counter.text(t) for t in texts]]

    return per_text(docs, id_column, text, start, "n_tokens long")
