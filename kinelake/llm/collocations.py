"""Phrase collocations: merged count-min sketches, an exact second pass over what survives, scores and subsumption.

Words are runs of other bytes than blanks (space, tab), inside pieces between ``. , ; : ! ?`` and line ends; A-Z are
lower-cased. Phrases are runs of 1 to ``longest`` words of one piece, counted for each language (null: ``und``).

1. Each task folds the phrases of its rows into one count-min sketch (``ROWS`` rows of cells, counters that stop at
   ``least``), cut into chunks; chunks of all tasks are added in a streaming merge, one task for some chunks at a time.
   Cells that reach ``least`` become bits. A sketch only ever overestimates.
2. A second scan counts exactly those phrases whose cells are all set, and whose two parts one word shorter survive as
   well (a frequent phrase has frequent parts). Within a slice phrases are told apart by their words, not by hashes.
3. Candidates are phrases of two and more words counted ``least`` times or more. Every cut into two parts scores
   floor(1000 * a * n / (l * r)) in exact decimals; the lowest cut counts, of equal ones the first.
4. A candidate inside a longer one that is counted ``percent`` or more times in a hundred of it is dropped.

The sketch has about 3 cells for ``least`` occurrences expected, up to ``cells`` (one byte each for ``least`` up to 255),
so bits of at most ``ROWS * cells / 8`` bytes reach the driver and the tasks. Beyond that size more phrases survive the
sketch and the shuffle of the second pass grows; results are the same. A ``least`` that grows with the corpus keeps the
sketch as it is.

Defined cases: null and empty texts have no words; repeated rows count as often as they occur; an empty table gives an
empty result; other columns are ignored; bytes that are no UTF-8 are parts of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as T
from .frames import release, text_bytes, written

LEAST, LONGEST, PERCENT, BEST = 100, 5, 100, 2000
ROWS, CELLS, CHUNK = 2, 1 << 26, 1 << 15
#: bytes of text that a task folds or counts at a time
SLICE = 2 << 20
#: tasks that a hot first or last part, and a language's candidates, are dealt to
SALTS = 16
UNKNOWN = "und"
_BREAKS = ~T.byte_class([(x, x) for x in b".,;:!?\n\x0b\x0c\r"])
_WORDS = T.byte_class([(x, x) for x in b" \t.,;:!?\n\x0b\x0c\r"])
_U = np.uint64


class Phrases:
    """Words of a slice of texts as numbers, and where they go on in the same piece."""

    def __init__(self, column, langs: list[str | None]):
        words = T.Words(column, _WORDS, hashes=False)
        size = words.ends - words.starts
        inside = _WORDS[words.buf]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(words.buf[inside])])
        coded = every.dictionary_encode()
        self.known, self.word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        buf, offsets = T.flat(self.known)
        self.hash = T.hash_ranges(buf, offsets[:-1], offsets[1:]) if len(self.known) else np.zeros(0, _U)
        breaks = np.cumsum(_BREAKS[words.buf])
        at = breaks[words.starts] if len(size) else np.zeros(0, np.int64)
        #: whether the next word stands in the same piece of the same text
        self.next = np.zeros(len(size), bool)
        self.next[:-1] = (words.doc[1:] == words.doc[:-1]) & (at[1:] == at[:-1])
        names = [UNKNOWN if x is None else x for x in langs]
        self.langs = sorted(set(names))
        index = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.array([index[x] for x in names], np.int64)[words.doc]
        self.salt = T.mix64(np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.langs], _U))

    def levels(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: the first word of every phrase, and its hash."""
        at = np.arange(len(self.word))
        h = T.mix64(self.hash[self.word] ^ self.salt[self.lang]) if len(at) else np.zeros(0, _U)
        yield at, h
        for k in range(1, longest):
            on = self.next[at + k - 1]
            at, h = at[on], h[on]
            h = T.mix64(h * _U(0xC2B2AE3D27D4EB4F) + self.hash[self.word[at + k]])
            yield at, h


def cells_of(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in every row of the sketch; width is a power of two, at most 2^32."""
    bits = _U(64 - int(width).bit_length() + 1)
    return [h >> bits, (h * _U(0x9E3779B97F4A7C15)) >> bits][:ROWS]


class Sketch:
    """Counters that stop at ``least``."""

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least
        self.rows = [np.zeros(width, np.uint8 if least <= 255 else np.uint32) for _ in range(ROWS)]

    def add(self, h: np.ndarray) -> None:
        known, n = _folded(h)
        for row, cells in zip(self.rows, cells_of(known, self.width), strict=True):
            order = np.argsort(cells)
            cells, more = cells[order], n[order]
            begins = np.flatnonzero(np.diff(cells, prepend=cells[:1] + _U(1))) if len(cells) else np.zeros(0, np.int64)
            if len(begins):
                at = cells[begins]
                row[at] = np.minimum(row[at].astype(np.int64) + np.add.reduceat(more, begins), self.least)


def _folded(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[begins], np.diff(begins, append=len(h))


def _slices(batch: pa.RecordBatch) -> Iterator[Phrases]:
    for piece in T.pieces(batch, limit=SLICE):
        yield Phrases(piece.column(0), piece.column(1).to_pylist())


def sketched(rows: DataFrame, width: int, tasks: int, least: int = LEAST, longest: int = LONGEST) -> np.ndarray:
    """One bit for each cell of the merged sketch of all rows, ROWS x width / 8 bytes: whether its count is ``least`` or more."""
    chunk = min(CHUNK, width)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, some = Sketch(width, least), False
        for batch in batches:
            for phrases in _slices(batch):
                hashes = [h for _, h in phrases.levels(longest)]
                sketch.add(np.concatenate(hashes))
                some = True
        for k, row in enumerate(sketch.rows if some else []):
            for c in range(0, width, chunk):
                yield pa.RecordBatch.from_arrays([pa.array([k * (width // chunk) + c // chunk], pa.int32()), pa.array([row[c : c + chunk].tobytes()], pa.binary())], names=["chunk", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, total = np.uint8 if least <= 255 else np.uint32, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for place, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), kind).astype(np.int64)
                if place != now:
                    if now is not None:
                        yield done()
                    now, total = place, np.zeros(chunk, np.int64)
                total = np.minimum(total + own, least)
        if now is not None:
            yield done()

    parts = rows.coalesce(tasks).mapInArrow(fold, "chunk int, counts binary")
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for r in merged.collect():
        bits[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def surviving(phrases: Phrases, bits: np.ndarray, width: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: first word and count of each different phrase that survives the sketch, and its language."""
    n = len(phrases.word)
    alive = np.zeros(0, bool)
    code = np.zeros(n, np.int64)
    for k, (at, h) in enumerate(phrases.levels(longest)):
        ok = np.ones(len(at), bool)
        for row, cells in enumerate(cells_of(h, width)):
            place = cells.astype(np.int64) + row * width
            ok &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
        if k:
            ok &= alive[at] & alive[at + 1]
        at = at[ok]
        alive = np.zeros(n + 1, bool)
        alive[at] = True
        # a phrase is the number of its part without the last word, and that word
        pair = code[at] * len(phrases.known) + phrases.word[at + k] if k else phrases.lang[at] * len(phrases.known) + phrases.word[at]
        known, first, place, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        code = np.zeros(n, np.int64)
        code[at] = place
        yield at[first], count, phrases.lang[at[first]]


def counted(rows: DataFrame, bits: np.ndarray, width: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, n): exact counts of the phrases counted ``least`` times or more, and of all words of each
    language under words = 0."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for phrases in _slices(batch):
                names = pa.array(phrases.langs, pa.string())
                totals = np.bincount(phrases.lang, minlength=len(phrases.langs))
                yield _batch(names, pa.array([""] * len(names), pa.string()), 0, totals)
                for k, (at, n, lang) in enumerate(surviving(phrases, shared.value, width, longest)):
                    parts = [phrases.known.take(pa.array(phrases.word[at + j])) for j in range(k + 1)]
                    text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k else parts[0]
                    yield _batch(names.take(pa.array(lang)), text.cast(pa.binary()).view(pa.string()), k + 1, n)

    found = rows.mapInArrow(count, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return found.filter((F.col("words") == 0) | (F.col("n") >= least))


def _batch(lang: pa.Array, phrase: pa.Array, words: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(lang), words), pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "n"])


def _part(first: Column | int, last: Column | int) -> Column:
    """Words first (from 1) to last of the column ``w``, one blank between two."""
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every candidate.

    Parts are looked up by equality. A part of one or two words may begin very many candidates, so its count is put
    beside each of ``SALTS`` numbers and every candidate draws one; the same holds for the words of a language."""
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    spread = F.explode(F.when(F.col("words") <= 2, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    table = counts.filter("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), spread)
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("total"), spread)
    # a word may hold any byte but blanks and breaks, so a candidate is cut at its blanks
    candidates = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), _part(F.lit(1), F.col("k")).alias("part"), F.col("k").alias("size")), F.struct(F.lit(1).alias("side"), _part(F.col("k") + 1, F.col("words")).alias("part"), (F.col("words") - F.col("k")).alias("size"))))
    parts = cuts.select("lang", "phrase", "words", "a", "k", sides.alias("s")).select("lang", "phrase", "words", "a", "k", "s.side", "s.part", F.when(F.col("s.size") <= 2, salt("phrase")).otherwise(0).alias("salt"))
    both = parts.join(table, ["lang", "part", "salt"]).groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    both = both.withColumn("salt", salt("phrase")).join(totals, ["lang", "salt"])
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    both = both.withColumns({"above": (wide("a") * wide("total")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "below": (wide("l") * wide("r")).cast("decimal(38,0)")})
    lowest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r", F.col("total").alias("n"))).alias("m"))
    return lowest.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.n", "m.score")


def subsumed(counts: DataFrame, longest: int = LONGEST, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, words, a) of candidates that lie inside a longer one with 100 * its count >= percent * a."""
    candidates = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    runs = [(i, size) for size in range(2, longest) for i in range(1, longest - size + 2)]
    inner = F.explode(F.filter(F.array(*(F.when((F.col("words") > size) & (F.col("words") >= i + size - 1), F.struct(_part(F.lit(i), F.lit(i + size - 1)).alias("phrase"), F.lit(size).alias("words"))) for i, size in runs)), lambda x: x.isNotNull()))
    longer = candidates.filter("words > 2").withColumn("w", F.split("phrase", " ", -1)).select("lang", F.col("a").alias("f"), inner.alias("x")).groupBy("lang", F.col("x.phrase").alias("phrase"), F.col("x.words").alias("words")).agg(F.max("f").alias("f"))
    return candidates.join(longer, ["lang", "phrase", "words"]).filter(F.col("f") * 100 >= F.col("a") * percent).select("lang", "phrase", "words", "a")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, best: int = BEST, cells: int = CELLS) -> DataFrame:
    """lang, rank (from 1), phrase, words, a, l, r, n, score: the first ``best`` collocations of each language by score,
    then count (both descending), then phrase."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null")
    total = text_bytes(rows)
    width = min(cells, max(CHUNK, 1 << math.ceil(math.log2(max(1, 3 * total / least)))))
    # a task's sketch takes ROWS * width bytes: at most half of the text that it folds, but for small tables
    tasks = max(8, math.ceil(total / (2 * ROWS * width)))
    bits = sketched(rows, width, tasks, least, longest)
    counts = written(counted(rows, bits, width, least, longest))
    kept = scored(counts).join(subsumed(counts, longest, percent).select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best).drop("part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", F.col("words").cast("long").alias("words"), "a", "l", "r", "n", "score")
