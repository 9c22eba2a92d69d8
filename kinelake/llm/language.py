"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased and cut into words (maximal runs of letters and marks), each between blanks; its n-grams are the
letters, and the pairs and triples that hold a letter (a triple's in the middle). The ``top`` most frequent n-grams of a
language, by count and then in the order of code points, are its profile. A document's own most frequent n-grams are
compared to each profile: the out-of-place distance adds the difference of both places, or ``top`` where the profile
lacks the n-gram. The nearest profile is the prediction, of several the first in the order of code points.

Counts cover all learning rows; they are folded by slice, by map-side aggregation and by (language, n-gram), and the
places of a language are found in parts of it first. Profiles go to the tasks in blocks of ``block`` languages, at most
``block`` times ``top`` rows each; with more languages the documents are scanned once for each block.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned;
rows without doc_id are predicted, never learned from, and not held out; rows with a null lang teach nothing; repeated
rows count as often as they occur; bytes that are no UTF-8 count as U+FFFD, which is no letter; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as T
from .frames import placed, release, written

TOP, BLOCK, FOLDS, HELD = 400, 256, 3, 1
#: parts of a language in which its most frequent n-grams are looked for first
PARTS = 32
#: (language, n-gram) counts that a learning task holds before it hands them on
HELD_COUNTS = 1 << 20
UNKNOWN, BLANK, BITS = "und", 0x20, 21
#: products of text rows, n-grams and languages that a task compares at a time
CELLS = 1 << 22


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is part of a word: a letter or a mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)], bool)


@functools.cache
def proper() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], bool)


class Grams:
    """The n-grams of a slice of texts as numbers ``key`` = (text, up to three places of ``signs``), one for each
    occurrence; place 0 is nothing, 1 a blank."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), "<u4")
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        inside = letters()[codes]
        at = np.flatnonzero(inside)
        self.signs, place = np.unique(codes[at], return_inverse=True)
        self.signs = np.concatenate([[0, BLANK], self.signs]).astype(np.int64)
        self.base = len(self.signs)
        seq = np.ones(len(codes), np.int64)
        seq[at] = place + 2
        pairs = np.flatnonzero(inside[:-1] | inside[1:])
        own = np.concatenate([[0], doc]).astype(np.int64)
        b = self.base
        # a pair belongs to the text of its letter
        pair_doc = np.where(inside[pairs], own[pairs], own[pairs + 1])
        one, two, three = own[at] * b**3 + seq[at] * b**2, pair_doc * b**3 + seq[pairs] * b**2 + seq[pairs + 1] * b, own[at] * b**3 + seq[at - 1] * b**2 + seq[at] * b + seq[at + 1]
        self.key = np.concatenate([one, two, three])
        self.lettered = np.bincount(own[at][proper()[codes[at]]], minlength=len(texts)) > 0

    def counted(self, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram, count), ascending; ``of`` maps texts to groups that are counted together."""
        key = self.key
        if of is not None:
            key = of[key // self.base**3] * self.base**3 + key % self.base**3
            key = key[key >= 0]
        key = np.sort(key)
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        return key[begins] // self.base**3, self.packed(key[begins] % self.base**3), np.diff(begins, append=len(key))

    def packed(self, gram: np.ndarray) -> np.ndarray:
        """The same number for the same n-gram in every slice: its code points, 21 bits each."""
        b = self.base
        return (self.signs[gram // b**2] << 2 * BITS) | (self.signs[gram // b % b] << BITS) | self.signs[gram % b]


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    """Slices whose keys fit 63 bits, with their n-grams."""
    for piece in T.pieces(batch):
        stack = [piece]
        while stack:
            part = stack.pop()
            low = [t.lower() for t in T.texts(part.column(1))]
            signs = len(set().union(*low)) + 2
            if part.num_rows > 1 and part.num_rows * signs**3 >= 1 << 62:
                half = part.num_rows // 2
                stack += [part.slice(half), part.slice(0, half)]
            else:
                yield part, Grams(low)


def gram_text(packed: int) -> str:
    """The n-gram of a packed number."""
    return "".join(chr(c) for c in (packed >> 2 * BITS, packed >> BITS & (1 << BITS) - 1, packed & (1 << BITS) - 1) if c)


def held_out(key: str):
    """Whether a row is held out; a row without doc_id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD, F.lit(False))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col("lang").cast("string").alias("lang")] if "lang" in docs.columns else []))


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, n, place): the ``top`` most frequent n-grams of each language, places from 0, over the rows of docs
    whose lang is known."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, np.ndarray, np.ndarray]] = []
        size = 0

        def folded() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
            for lang in sorted({h[0] for h in held}):
                gram, n = (np.concatenate([h[k] for h in held if h[0] == lang]) for k in (1, 2))
                known, at = np.unique(gram, return_inverse=True)
                yield lang, known, np.bincount(at, n, len(known)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, gram, n in held:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for piece, grams in slices(batch):
                langs, at = np.unique(np.array(piece.column(2).to_pylist(), object), return_inverse=True)
                group, gram, n = grams.counted(at)
                cuts = np.searchsorted(group, np.arange(len(langs) + 1))
                held += [(lang, gram[a:b], n[a:b]) for lang, a, b in zip(langs, cuts[:-1], cuts[1:], strict=True) if b > a]
                size += len(gram)
                if size > HELD_COUNTS:
                    held = list(folded())
                    size = sum(len(h[1]) for h in held)
                    if 2 * size > HELD_COUNTS:
                        yield from rows()
                        held, size = [], 0
        held = list(folded())
        yield from rows()

    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), "gram"]
    part = F.pmod(F.xxhash64("gram"), F.lit(PARTS))
    first = counts.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("r") <= top)
    placed_ = first.drop("r", "part").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return placed_.filter(F.col("place") < top)


def _table(rows: list, top: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, n-grams (ascending) and the place of each n-gram in each language."""
    langs = sorted({r["lang"] for r in rows})
    index = {lang: k for k, lang in enumerate(langs)}
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    places = np.full((len(grams), len(langs)), top, np.int32)
    places[np.searchsorted(grams, np.array([r["gram"] for r in rows], np.int64)), [index[r["lang"]] for r in rows]] = [r["place"] for r in rows]
    return langs, grams, places


def distances(grams: Grams, n_texts: int, table: np.ndarray, places: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of every text to every language, and the number of n-grams compared."""
    doc, gram, n = grams.counted()
    out = np.zeros((n_texts, places.shape[1]), np.int64)
    most = int(n.max(initial=0))
    order = np.argsort(doc * (most + 1) + most - n, kind="stable")
    doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, np.arange(n_texts + 1))
    rank = np.arange(len(doc)) - first[doc]
    doc, gram, rank = doc[rank < top], gram[rank < top], rank[rank < top]
    at = np.minimum(np.searchsorted(table, gram), len(table) - 1)
    hit = table[at] == gram
    step = max(1, CELLS // places.shape[1])
    for a in range(0, len(doc), step):
        near = np.where(hit[a : a + step, None], np.abs(places[at[a : a + step]] - rank[a : a + step, None]), top)
        near = np.where(places[at[a : a + step]] == top, top, near)
        begins = np.flatnonzero(np.diff(doc[a : a + step], prepend=-1))
        out[doc[a : a + step][begins]] += np.add.reduceat(near, begins, axis=0) if len(begins) else 0
    return out, np.bincount(doc, minlength=n_texts)


def _compared(rows: DataFrame, block: list, top: int, keep: list[str]) -> DataFrame:
    """The nearest language of a block for each row: (keep, lang_pred, distance, n_grams)."""
    shared = rows.sparkSession.sparkContext.broadcast(_table(block, top))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("distance", "long").add("n_grams", "long")
    ordered = rows.select("doc_id", "text", *[k for k in keep if k != "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, places = shared.value
        for batch in batches:
            for piece, grams in slices(batch):
                if langs:
                    far, n = distances(grams, piece.num_rows, table, places, top)
                else:
                    far, n = np.zeros((piece.num_rows, 1), np.int64), np.zeros(piece.num_rows, np.int64)
                best = far.argmin(axis=1)
                known = grams.lettered & bool(langs)
                names = pa.array([langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], pa.string())
                least = far[np.arange(piece.num_rows), best]
                columns = [piece.column(piece.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*columns, names, pa.array(least, pa.int64()), pa.array(np.where(known, n, 0), pa.int64())], names=[*keep, "lang_pred", "distance", "n_grams"])

    return ordered.mapInArrow(run, schema)


def identify(docs: DataFrame, learned: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """doc_id, lang_pred, score (1 - distance / (n-grams * top), 0 to 1), distance, n_grams for each row of docs.

    ``learned`` has profiles as ``profiles`` makes them. It is read block by block; a row's nearest language of each
    block is joined by the row's place in the files, and the nearest of all kept."""
    learned = written(learned)
    numbered = written(learned.join(learned.select("lang").distinct().withColumn("block", F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / block)), "lang"))
    blocks = int(numbered.agg(F.max("block")).first()[0] or 0) + 1
    rows = lambda k: numbered.filter(F.col("block") == k).select("lang", "gram", "place").collect()  # noqa: E731 - at most block * top rows
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if blocks == 1:
        found = _compared(named, rows(0), top, ["doc_id"])
    else:
        at = placed(named)
        each = [_compared(at, rows(k), top, ["doc_id", "file_key", "row_at"]) for k in range(blocks)]
        every = functools.reduce(DataFrame.unionByName, each)
        found = every.groupBy("file_key", "row_at").agg(F.first("doc_id").alias("doc_id"), F.first("n_grams").alias("n_grams"), F.min(F.struct("distance", "lang_pred")).alias("near")).select("doc_id", "near.lang_pred", "near.distance", "n_grams")
    release(numbered, learned)
    score = F.when(F.col("n_grams") > 0, 1 - F.col("distance") / (F.col("n_grams") * top)).otherwise(0.0)
    return found.select("doc_id", "lang_pred", score.alias("score"), "distance", "n_grams")


def identify_language(docs: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Learns from the rows of docs that are not held out, and predicts all rows; adds held_out."""
    rows = _named(docs)
    learn = rows.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return identify(docs, profiles(learn, top), top, block).withColumn("held_out", held_out("doc_id"))
