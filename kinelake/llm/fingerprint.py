"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A fingerprint is a vector of sums: each paragraph (what stands between two line feeds, empty lines too) adds the 4 words of 64 bits of a 256-bit hash (BLAKE2b) of its
bytes modulo 2**64, and 256 lanes modulo 2**16, to which each of its words adds +1 or -1 by the hash of the word with the two before it.
Sums do not depend on the order of paragraphs, and a paragraph is inserted or deleted by adding or subtracting its own
vector. The lanes are a linear sketch too: the squared length of a difference estimates how many words differ, so
``likeness`` is 1 - |a-b|^2 / (|a|^2 + |b|^2), cut to 0..1. It takes the sums before they are reduced, so long texts that
repeat one run of words do not wrap; only the written fingerprint has them modulo 2**16.

Defined cases: null and empty texts have the zero vector, alike to each other (1.0); rows that share a doc_id are ordered
by Spark's xxhash64 of their texts; rows without doc_id come first; with one row the next document is the row itself;
bytes that are no UTF-8 are taken as U+FFFD. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .frames import at_bound, range_count, range_of

LANES, WIDE = 256, 4
BLOCK = 4 << 20
#: most ranges, and keys that the driver gets for each to cut them
RANGES, SAMPLE = 20_000, 20
_LANE_SEEDS = T.mix64(np.arange(1, LANES // 64 + 1, dtype=T._U))
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Prints:
    """Fingerprint vectors of texts: wide (n, 4) and lanes (n, 256), the latter as full sums."""

    def __init__(self, wide: np.ndarray, lanes: np.ndarray):
        self.wide, self.lanes = wide, lanes

    @classmethod
    def of(cls, texts) -> Prints:
        words = T.Words(texts, T.BLANK_WORDS, lower=False)
        n = len(words.counts)
        # a paragraph ends at a line feed or with its document
        line = np.zeros(len(words.buf) + 1, np.int64)
        np.cumsum(words.buf == 10, out=line[1:])
        para = line[words.starts]
        total = len(words.starts)
        same = lambda k: np.concatenate([np.zeros(min(k, total), bool), (para[k:] == para[:-k]) & (words.doc[k:] == words.doc[:-k])])
        one, two = same(1), same(2)
        h = words.hash.copy()
        back = lambda k: np.concatenate([np.zeros(min(k, total), T._U), words.hash[: max(0, total - k)]])
        h += np.where(one, back(1), T._U(0)) * T._U(0xC2B2AE3D27D4EB4F) + np.where(one & two, back(2), T._U(0)) * T._U(0x165667B19E3779F9)
        lanes = np.zeros((n, LANES), np.int64)
        # documents one after another in slices of bounded size
        step = 1 << 15
        for a in range(0, total, step):
            own = h[a : a + step]
            bits = np.unpackbits(np.stack([T.mix64(own + k) for k in _LANE_SEEDS], axis=1).view(np.uint8), axis=1)
            docs = words.doc[a : a + step]
            cuts = np.flatnonzero(np.diff(docs, prepend=-1))
            for c, d in zip(cuts, [*cuts[1:], len(docs)], strict=True):
                lanes[docs[c]] += 2 * bits[c:d].sum(axis=0, dtype=np.int64) - (d - c)
        # bytes of each line of a text that is not empty
        wide = np.zeros((n, WIDE), T._U)
        ends = np.flatnonzero(words.buf == 10)
        some = np.flatnonzero(np.diff(words.offsets))
        starts = np.concatenate([words.offsets[some], ends + 1])
        doc = np.concatenate([some, np.searchsorted(words.offsets, ends, "right") - 1])
        stops = np.minimum(np.append(ends, len(words.buf))[np.searchsorted(ends, starts)], words.offsets[doc + 1])
        raw = words.buf.tobytes()
        own = b"".join(hashlib.blake2b(raw[a:b], digest_size=8 * WIDE).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True))
        np.add.at(wide, doc, np.frombuffer(own, "<u8").reshape(-1, WIDE))
        return cls(wide, lanes.astype(np.int32))  # a text has under 2**31 words

    def add(self, other: Prints) -> Prints:
        return Prints(self.wide + other.wide, self.lanes + other.lanes)

    def subtract(self, other: Prints) -> Prints:
        return Prints(self.wide - other.wide, self.lanes - other.lanes)

    def text(self) -> list[str]:
        return [w.tobytes().hex() + v.tobytes().hex() for w, v in zip(self.wide, self.lanes.astype(np.uint16), strict=True)]

    def take(self, rows) -> Prints:
        return Prints(self.wide[rows], self.lanes[rows])


def likeness(a: Prints, b: Prints) -> np.ndarray:
    x, y = a.lanes.astype(np.float64), b.lanes.astype(np.float64)
    gap = x - y
    norm = (x**2).sum(axis=1) + (y**2).sum(axis=1)
    out = np.clip(1 - (gap**2).sum(axis=1) / np.maximum(norm, 1e-9), 0, 1)
    return np.where((a.wide == b.wide).all(axis=1) & (gap == 0).all(axis=1), 1.0, out)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _results(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of the texts but the last, each with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    all_, theirs = Prints.of(pa.array(texts, pa.large_string())), Prints.of(pa.array(changed, pa.large_string()))
    mine, following = all_.take(slice(0, len(changed))), all_.take(slice(1, len(texts)))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in changed],
            "fingerprint": mine.text(),
            "edited_fingerprint": theirs.text(),
            "near_edited": likeness(mine, theirs),
            "near_next": likeness(mine, following),
        }
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of documents, range by range, each range with the first row of the next as its tail. One
    slice of documents and the one after them are held at a time."""
    ids, texts, size, ended = [], [], 0, None
    for batch in batches:
        for k, block, tail, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), T.texts(batch.column(1)), strict=True):
            if block == ended:  # equal rows at the border: one is enough
                continue
            texts.append(text)
            size += len(text)
            if tail or size > T.CHUNK and ids:
                yield _results(ids, texts)
                ids, texts, size = [], [text], len(text)
            if tail:
                texts, size, ended = [], 0, block
            else:
                ids.append(k)


def with_next(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """(doc_id, text, block, tail, o): ranges of the order o (doc_id, null first, then the text's hash), each with the
    first row of the next range as its tail; the last range's tail is the first row of all. The driver gets about
    ``SAMPLE`` keys for each range. Equal ids are split by the hash, so a range is about as large as others."""
    order = F.struct(F.col("doc_id").isNotNull().cast("int").alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.xxhash64("text").alias("c"))
    docs = docs.withColumn("o", order)
    total = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.min("o")).first()
    ranges = min(RANGES, range_count(int(total[0] or 0), block_bytes))
    bounds: list[tuple[int, int, int]] = []
    if ranges > 1:
        share = min(1.0, SAMPLE * ranges / total[1])
        keys = sorted(tuple(r) for r in docs.filter(F.pmod(F.xxhash64("o"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))).select("o.a", "o.b", "o.c").collect())
        bounds = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)} - {tuple(total[2])}) if keys else []
    block = range_of("o", bounds)
    last = F.lit(len(bounds))
    heads = F.when(at_bound("o", bounds, block), block - 1).when(F.col("o") == F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(total[2] or (0, 0, 0), ("int", "long", "long"), "abc", strict=True))), last)
    places = F.array_compact(F.array(F.struct(block.cast("int").alias("block"), F.lit(False).alias("tail")), F.when(heads.isNotNull(), F.struct(heads.cast("int").alias("block"), F.lit(True).alias("tail")))))
    return docs.select("doc_id", "text", "o", F.explode(places).alias("p")).select("doc_id", "text", "p.block", "p.tail", "o")


def fingerprints(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """Fingerprint of each row's text and of its edited text, and their likenesses."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = with_next(docs, block_bytes).repartition("block").sortWithinPartitions("block", "tail", "o")
    return dealt.drop("o").mapInArrow(_in_order, _OUT)
