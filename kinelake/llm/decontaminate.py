"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned over document windows.

Texts are lower-cased (A-Z only) and cut into words of letters, digits and non-ASCII characters. A window is ``size``
consecutive words of one item; an item with fewer words, but not none, is one window. Hits are verified by the bytes of
their words. The set is sorted arrays, made once on the driver and broadcast; it takes 8 bytes for each window's hash, 4
for its place, 4 for its group and the normalised texts, which is under 13 bytes for each byte of benchmark text. A
benchmark of over ``MAX_BYTES`` is not collected: its windows become a table, and only a bitmap of their hashes (at most
``BITS`` bits) is broadcast. One scan of the documents emits the windows whose bit is set, these are joined with the table
by hash and words, the table's side put beside ``SALTS`` numbers for windows that very many documents hold, and the hits
are merged by row. ``drop_contaminated`` removes documents, ``cut_contaminated`` only the spans.

Defined cases: a null has no words and no windows; a null or repeated item_id is an id like others (null: empty text);
an empty benchmark hits nothing; an empty table gives no rows; invalid UTF-8 is bytes like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .frames import release, written

SIZE = 10
MAX_BYTES = 8 << 20
#: bits of the map of a large benchmark's windows, bits of one of its chunks, salts of a window, windows in a batch
BITS, CHUNK, SALTS, ROWS = 1 << 27, 1 << 15, 16, 1 << 14
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows:
    """Item windows by their number of words: sorted distinct hashes; for each, groups of windows of equal words; for
    each group, its words and its items."""

    def __init__(self, items: list[tuple[str, str]], size: int = SIZE):
        self.ids = [i for i, _ in items]
        self.known: dict[int, tuple[np.ndarray, ...]] = {}
        words = T.Words(pa.array([t for _, t in items], pa.large_string()), T.ALNUM_WORDS)
        lengths = words.ends - words.starts
        #: words of all items, one blank after each
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.buf = np.full(int(self.at[-1]), 32, np.uint8)
        to = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
        self.buf[to] = words.buf[to + np.repeat(words.starts - self.at[:-1], lengths)]
        for width in range(1, size + 1):
            at, hashes = T.ngrams(words, width)
            if width < size:
                own = words.counts[words.doc[at]] == width if len(at) else np.zeros(0, bool)
                at, hashes = at[own], hashes[own]
            if len(at):
                self.known[width] = self._grouped(width, at, hashes, words.doc[at])

    def text(self, first: int, width: int) -> bytes:
        return self.buf[self.at[first] : self.at[first + width] - 1].tobytes()

    def _grouped(self, width: int, at: np.ndarray, hashes: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((item, hashes))
        at, hashes, item = at[order], hashes[order], item[order]
        new = np.ones(len(at), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        heads = np.flatnonzero(new)
        twins = np.flatnonzero(~new)
        odd = [k for k in twins.tolist() if self.text(int(at[k]), width) != self.text(int(at[heads[np.searchsorted(heads, k, "right") - 1]]), width)]
        if odd:  # two runs of words share a hash: order those by their words as well
            mixed = np.flatnonzero(np.isin(hashes, hashes[odd]))
            sorted_ = sorted(mixed.tolist(), key=lambda k: (int(hashes[k]), self.text(int(at[k]), width), int(item[k])))
            at[mixed], item[mixed], hashes[mixed] = at[sorted_], item[sorted_], hashes[sorted_]
            for a, b in zip(mixed[:-1], mixed[1:], strict=True):
                new[b] = new[b] or self.text(int(at[a]), width) != self.text(int(at[b]), width)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        once = np.ones(len(at), bool)
        once[1:] = new[1:] | (item[1:] != item[:-1])
        found = hashes[starts]
        known, first = np.unique(found, return_index=True)
        owners = np.searchsorted(group[once], np.arange(len(starts) + 1))
        return known, np.append(first, len(starts)), at[starts].astype(np.int32), item[once].astype(np.int32), owners

    def scan(self, column) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text: number of words, flags of the words inside a window, ids of the items found."""
        words = T.Words(column, T.ALNUM_WORDS)
        flags, items = self.flags(words)
        for d, n in enumerate(words.counts):
            yield int(n), flags[words.first[d] : words.first[d + 1]], items.get(d, set())

    def flags(self, words: T.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Flags of all words, and the ids found by document."""
        edge = np.zeros(len(words.starts) + 1, np.int64)
        groups: dict[int, set[tuple[int, int]]] = {}
        for width, (known, first, at, _, _) in self.known.items():
            places, own = T.ngrams(words, width)
            k = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[k] == own
            for i, h in zip(places[hit].tolist(), k[hit].tolist(), strict=True):
                text = b" ".join(words.word(j) for j in range(i, i + width))
                for g in range(int(first[h]), int(first[h + 1])):
                    if self.text(int(at[g]), width) == text:
                        edge[i] += 1
                        edge[i + width] -= 1
                        groups.setdefault(int(words.doc[i]), set()).add((width, g))
        items = {}
        for d, found in groups.items():
            items[d] = {self.ids[k] for width, g in found for k in self.known[width][3][self.known[width][4][g] : self.known[width][4][g + 1]].tolist()}
        return np.cumsum(edge[:-1]) > 0, items


def cut(words: T.Words, flags: np.ndarray, raw: np.ndarray, d: int) -> bytes:
    """The bytes of text d without its runs of flagged words, from the first to the last byte of each run."""
    a, b = int(words.first[d]), int(words.first[d + 1])
    own = flags[a:b].astype(np.int8)
    begins, stops = np.flatnonzero(np.diff(own, prepend=0) == 1) + a, np.flatnonzero(np.diff(own, append=0) == -1) + a
    keep, at = [], int(words.offsets[d])
    for i, j in zip(begins.tolist(), stops.tolist(), strict=True):
        keep.append(raw[at : words.starts[i]].tobytes())
        at = int(words.ends[j])
    return b"".join([*keep, raw[at : words.offsets[d + 1]].tobytes()])


def _summary(hits: int, items: set[str]) -> tuple:
    return hits, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hits > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256 (ids sorted as strings, comma-joined)
    and contaminated, for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    if _bytes(items) <= max_bytes:
        shared = _shared(items, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch):
                    rows = [(n, *_summary(int(flags.sum()), found)) for n, flags, found in shared.value.scan(piece.column(1))]
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))],
                        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                    )

        return docs.mapInArrow(run, _OUT)
    merged = _by_table(written(docs.withColumn("row", F.monotonically_increasing_id())), items, size)
    return merged.select("doc_id", "n_words", F.size("h").cast("long").alias("n_hit"), F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), (F.size("h") > 0).alias("contaminated"))


def _by_table(rows: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, n_words, h: flagged words, i: item ids) of the rows (doc_id, text, row), through a table of windows."""
    windows = written(items.distinct().mapInArrow(_emit_windows(size), "item_id string, width int, hash long, words string").distinct())
    known = windows.select("width", "hash", "words").distinct()
    bits = min(BITS, max(CHUNK, 1 << (16 * windows.count()).bit_length()))
    cell = F.shiftrightunsigned("hash", 64 - (bits.bit_length() - 1))
    chunks = windows.select(F.floor(cell / CHUNK).cast("int").alias("chunk"), (cell % CHUNK).cast("int").alias("bit")).groupBy("chunk").agg(F.collect_set("bit").alias("bits"))
    mask = np.zeros(bits // 8, np.uint8)
    for r in chunks.mapInArrow(_packed, "chunk int, bits binary").collect():  # at most bits / 8 bytes
        mask[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    shared = rows.sparkSession.sparkContext.broadcast((mask, bits, widths))
    seen = written(rows.mapInArrow(_scan_windows(shared), "row long, doc_id long, n_words long, at int, width int, hash long, words string"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = written(seen.filter("width > 0").withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["width", "hash", "words", "salt"]).select("row", "at", "width", "hash", "words"))
    flagged = hits.select("row", F.explode(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("j")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("j")).alias("h"))
    owners = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = hits.select("row", "width", "hash", "words").distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(owners, ["width", "hash", "words", "salt"])
    named = found.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("i"))
    merged = seen.filter("width = 0").select("row", "doc_id", "n_words").join(flagged, "row", "left").join(named, "row", "left")
    merged = written(merged.select("row", "doc_id", "n_words", F.coalesce("h", F.array().cast("array<int>")).alias("h"), F.coalesce("i", F.array().cast("array<string>")).alias("i")))
    release(windows, seen, hits)
    return merged


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs, all columns, that no window occurs in; one scan without shuffle while the benchmark can be
    broadcast."""
    return _cleaned(docs, benchmark, size, max_bytes, whole=True)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All rows of docs, all columns, with the runs of words inside windows cut out of the text."""
    return _cleaned(docs, benchmark, size, max_bytes, whole=False)


def _cleaned(docs: DataFrame, benchmark: DataFrame, size: int, max_bytes: int, whole: bool) -> DataFrame:
    items, names = _items(benchmark), docs.columns
    at = names.index("text")
    if _bytes(items) > max_bytes:
        key, other, flags_ = (_free(docs, n) for n in ("row", "found_row", "found"))
        rows = written(docs.withColumn(key, F.monotonically_increasing_id()))
        found = _by_table(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(key).alias("row")), items, size).filter("size(h) > 0").select(F.col("row").alias(other), F.col("h").alias(flags_))
        if whole:
            return rows.join(found, rows[key] == found[other], "left_anti").drop(key)
        joined = rows.join(found, rows[key] == found[other], "left").drop(key, other)

        def cut_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch):
                    words = T.Words(piece.column(at), T.ALNUM_WORDS, hashes=False)
                    flags = np.zeros(len(words.starts), bool)
                    hits = piece.column(piece.num_columns - 1)
                    for d in range(piece.num_rows):
                        flags[int(words.first[d]) + np.array(hits[d].as_py() or [], np.int64)] = True
                    yield _replaced(piece.select(names), at, words, flags)

        return joined.mapInArrow(cut_known, docs.schema)
    shared = _shared(items, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                words = T.Words(piece.column(at), T.ALNUM_WORDS)
                flags, _ = shared.value.flags(words)
                if whole:
                    hits = np.concatenate([[0], np.cumsum(flags)])[words.first]
                    yield piece.filter(pa.array(np.diff(hits) == 0, pa.bool_()))
                else:
                    yield _replaced(piece, at, words, flags)

    return docs.mapInArrow(run, docs.schema)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def _replaced(piece: pa.RecordBatch, at: int, words: T.Words, flags: np.ndarray) -> pa.RecordBatch:
    if not flags.any():
        return piece
    raw, own = T.flat(piece.column(at))[0], piece.column(at)
    hits = np.diff(np.concatenate([[0], np.cumsum(flags)])[words.first])
    kept = [cut(words, flags, raw, d) if hits[d] else own[d].cast(pa.binary()).as_py() for d in range(piece.num_rows)]
    columns = [pa.array(kept, pa.binary()).view(pa.string()).cast(own.type) if k == at else piece.column(k) for k in range(piece.num_columns)]
    return pa.RecordBatch.from_arrays(columns, names=piece.schema.names)


def _shared(items: DataFrame, size: int):
    """The set of items whose bytes were checked, as a broadcast."""
    return items.sparkSession.sparkContext.broadcast(Windows([(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()], size))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _bytes(items: DataFrame) -> int:
    return int(items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0)


def _emit_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                words = T.Words(piece.column(1), T.ALNUM_WORDS)
                for width in range(1, size + 1):
                    at, hashes = T.ngrams(words, width)
                    if width < size and len(at):  # an item of fewer words is one window
                        own = words.counts[words.doc[at]] == width
                        at, hashes = at[own], hashes[own]
                    for k in range(0, len(at), ROWS):
                        some = at[k : k + ROWS]
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(0).take(pa.array(words.doc[some])), pa.array(np.full(len(some), width), pa.int32()), pa.array(hashes[k : k + ROWS].view(np.int64)), _joined(words, some, width)],
                            names=["item_id", "width", "hash", "words"],
                        )

    return run


def _joined(words: T.Words, at: np.ndarray, width: int) -> pa.Array:
    """The words of windows, one blank between two."""
    return pa.array([b" ".join(words.word(j) for j in range(i, i + width)) for i in at.tolist()], pa.binary()).view(pa.string())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bits in batch.column(1):
            own = np.zeros(CHUNK, bool)
            own[bits.values.to_numpy()] = True
            out.append(np.packbits(own).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "bits"])


def _scan_windows(shared):
    """One row (width 0) for each document, and one for each of its windows whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, bits, widths = shared.value
        shift = np.uint64(64 - (bits.bit_length() - 1))
        names = ["row", "doc_id", "n_words", "at", "width", "hash", "words"]
        for batch in batches:
            for piece in T.pieces(batch):
                words = T.Words(piece.column(1), T.ALNUM_WORDS)
                n = piece.num_rows
                none = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(2), piece.column(0), pa.array(words.counts, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none), pa.array([""] * n, pa.string())], names=names)
                for width in widths:
                    at, hashes = T.ngrams(words, width)
                    cell = (hashes >> shift).astype(np.int64)
                    hit = (mask[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                    at, hashes = at[hit], hashes[hit]
                    for k in range(0, len(at), ROWS):
                        some = at[k : k + ROWS]
                        doc = words.doc[some]
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(2).take(pa.array(doc)), piece.column(0).take(pa.array(doc)), pa.array(words.counts[doc], pa.int64()), pa.array(some - words.first[doc], pa.int32()), pa.array(np.full(len(some), width), pa.int32()), pa.array(hashes[k : k + ROWS].view(np.int64)), _joined(words, some, width)],
                            names=names,
                        )

    return run
