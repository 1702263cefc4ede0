"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming carries, for each end, only the best
score and how many pieces it took.  The tie rule is the tokenizer's: of equally good ways to an end the one that is met first, from
the earliest start, stays.  No piece reaches from a word into the space after it, so a text's count is the sum of its words', and
each distinct word is solved once.

The vocabulary file holds pieces with scores; they are read as unigram log-probabilities.  For a file of another type of model (the
scores of a merge list are minus the ranks) the count is that of the unigram tokenizer with these pieces and scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import pick

#: Distinct words that one worker keeps.
MEMO_WORDS = 500_000
#: What an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
SPACE = "\u2581"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_path() -> str:
    """The public vocabulary that the production query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[dict[str, float], bool]:
    """The ordinary pieces with their scores, and whether unknown characters fall back to bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    plain = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return {m.id_to_piece(i): m.get_score(i) for i in plain}, any(m.is_byte(i) for i in ids)


class UnigramCounter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True, memo_words: int = MEMO_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.singles = {p for p in pieces if len(p) == 1}
        self.byte_fallback, self.memo_words = byte_fallback, memo_words
        # a piece that goes on after a space within it ties words together: then texts are solved whole
        self.whole = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.memo: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a string, in one pass over its matches."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        singles, filled = self.singles, 0

        def close(end: int) -> None:
            # an unknown character is the last way to its end: it starts latest
            c = word[end - 1]
            if c not in singles and score[end - 1] is not None:
                s = score[end - 1] + self.unknown
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)

        for last, (length, own) in self.automaton.iter(word):
            end = last + 1
            while filled < end - 1:
                filled += 1
                close(filled)
            start = end - length
            if score[start] is not None:
                s = score[start] + own
                if score[end] is None or s > score[end]:
                    score[end], count[end] = s, count[start] + 1
        while filled < n:
            filled += 1
            close(filled)
        return count[n], score[n] or 0.0

    def count(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a whole text; null and empty texts have none."""
        if not text:
            return 0, 0.0
        written = SPACE + text.replace(" ", SPACE)
        if self.whole:
            return self.best(written)
        memo = self.memo
        if len(memo) > self.memo_words:
            memo.clear()
        pieces, total = 0, 0.0
        for word in _WORDS.findall(written):
            found = memo.get(word)
            if found is None:
                found = memo[word] = self.best(word)
            pieces += found[0]
            total += found[1]
        return pieces, total


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """This process's counter of a file: a worker keeps its memo from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(*vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, score (of the best segmentation).

    Defined cases: null and empty texts count 0 with score 0; null ids and repeated rows keep their rows; texts of any length are counted
    whole; an empty table gives no row; further columns are ignored.
    """
    path = path or default_path()

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = counter(path)
        for batch in batches:
            found = [own.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return pick(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_tokens long, score double")
