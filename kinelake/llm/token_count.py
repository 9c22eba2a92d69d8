"""Token counts by count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary pieces that end at each character; dynamic programming carries only the best
score and the number of pieces. Tie rule: for one end, starts are tried in ascending order and a later one must score
strictly more. A character that no one-character piece covers may be an unknown piece (lowest score - 10) and counts
as its UTF-8 bytes, as byte fallback writes it. No piece has a word mark after another character, so the best path of
a text is that of its marked words one after another, and equal words are solved once (memo of bounded size).

The vocabulary is read from a public SentencePiece model file (parameter), pieces and scores as they stand; nothing
is trained. Blanks become the word mark, and a text that is not empty gets one in front.
Scores and counts are kept for the reach of the longest piece only, so a text of one long word takes no more memory.
Defined cases: null and empty texts have 0 tokens; bytes that are no UTF-8 count as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 200_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def read_pieces(model_file: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a SentencePiece model; kinds 1 normal, 2 unknown, 3 control, 4 user, 5 unused, 6 byte."""
    import sentencepiece as sp

    model = sp.SentencePieceProcessor(model_file=model_file)
    kind = lambda k: 2 if model.is_unknown(k) else 3 if model.is_control(k) else 5 if model.is_unused(k) else 6 if model.is_byte(k) else 1
    return [(model.id_to_piece(k), model.get_score(k), kind(k)) for k in range(model.get_piece_size())]


class Viterbi:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        normal = {p: s for p, s, kind in pieces if kind == 1 and p}
        self.unknown = min(s for s in normal.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in normal.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.ring = 1 + max(map(len, normal))
        self.single = {p for p in normal if len(p) == 1}
        self.apart = not any(MARK in p.lstrip(MARK) for p in normal)
        self.memo: dict[str, int] = {}

    def solve(self, text: str) -> int:
        """Pieces on the best path. The automaton reports the pieces that end at a character from the longest to the
        shortest, that is by ascending start; scores and counts are kept for the longest piece's reach only."""
        n, ring = len(text), self.ring
        if n < ring and self.single.issuperset(text):  # a word of known characters, which is nearly every one
            score, count = [0.0] * (n + 1), [0] * (n + 1)
            last = -1
            for end, (size, s) in self.automaton.iter(text):
                start = end + 1 - size
                total = score[start] + s
                if end != last or total > score[end + 1]:
                    score[end + 1], count[end + 1], last = total, count[start] + 1, end
            return count[n]
        score, count = [0.0] * ring, [0] * ring
        at = 0  # characters done
        best, number, covered = None, 0, False
        for end, (size, s) in self.automaton.iter(text):
            while at < end:
                self._close(text, at, best, number, covered, score, count)
                at += 1
                best, covered = None, False
            start = (end + 1 - size) % ring
            total = score[start] + s
            if best is None or total > best:
                best, number = total, count[start] + 1
            covered = covered or size == 1
        for at in range(at, len(text)):
            self._close(text, at, best, number, covered, score, count)
            best, covered = None, False
        return count[len(text) % ring]

    def _close(self, text, at, best, number, covered, score, count) -> None:
        """Ends the character at ``at``: an unknown piece competes where no piece is this one character."""
        ring = self.ring
        if not covered:
            other = score[at % ring] + self.unknown
            if best is None or other > best:
                best, number = other, count[at % ring] + len(text[at].encode("utf-8", "replace"))
        score[(at + 1) % ring], count[(at + 1) % ring] = best, number

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.apart:
            return self.solve(text)
        total, memo = 0, self.memo
        for m in _WORD.finditer(text):
            word = m[0]
            k = memo.get(word)
            if k is None:
                k = self.solve(word)
                if len(word) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = k
            total += k
        return total


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens (long) for each row. The vocabulary (a fixed public file) is read on the driver and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Viterbi(shared.value)
        for batch in batches:
            counts = [model.tokens(t) for t in T.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
