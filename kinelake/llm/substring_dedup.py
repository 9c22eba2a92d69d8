"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier in the corpus. Suffixes need an
order only to that depth, and any total order that puts equal prefixes side by side serves, so suffixes are sorted by
a fingerprint of their first ``length`` bytes. Steps, each bounded by one block of documents or one bucket:

1. documents are dealt in order of doc_id and packed into blocks of about ``BLOCK`` bytes, once; whole copies of an
   earlier text are settled before by one hash of the text, and only a mark of them goes to their place;
2. cover sample: positions of each document in a difference cover modulo ``PERIOD`` get the rank class (a fingerprint)
   of their next ``length - PERIOD + 1`` bytes. For any two equal strings of ``length`` bytes there is one shift below
   PERIOD at which both have a sample, so a suffix none of whose samples recurs cannot recur;
3. the suffixes that this leaves are dealt into buckets by fingerprint, and one bucket at a time is sorted, which gives
   for each its first occurrence. Ties in the first 64 bits are resolved by further bytes of the fingerprint, of a
   second base; there are as many as keep the chance that any two suffixes of the corpus are mistaken under 2^-20;
4. every block gets a bit for each of its suffixes, and marks and cuts the covered bytes.

What is shuffled between blocks and buckets are sorted, delta-coded fingerprints, each once for a block (so a passage
that a third of the documents hold counts once for each block), and one bit for each in reply.

Defined cases: a null text is empty; texts under ``length`` bytes keep all; rows that share a doc_id are separate
documents in the order of Spark's xxhash64 of their texts, equal ones in the order they are read in; rows without
doc_id come first. Other columns are ignored.
"""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as T
from .frames import placed, range_count, release, remove, shared_dir, text_bytes, written

LENGTH = 100
#: fixed values: a perfect difference set modulo 57 (every residue is a difference of two members)
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK = 4 << 20
#: sorted fingerprints of one bucket, at most about this many
BUCKET = 4 << 20
#: most tasks that blocks are dealt to; a task handles its blocks one after another
TASKS = 20_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_SENT = "bucket int, block long, n int, blob binary, checks binary"

_STEP = 12
_kept: dict[int, list[np.ndarray]] = {}


def _tables(base: int, n: int) -> list[np.ndarray]:
    """Powers of the base, and of its 2**_STEP-th power, that make those of the first n places; two short tables."""
    known = _kept.get(base)
    if known is None or len(known[1]) << _STEP < n:
        out = []
        for factor, size in ((base, 1 << _STEP), (pow(base, 1 << _STEP, 1 << 64), max(n, BLOCK) + (2 << _STEP) >> _STEP)):
            steps = np.full(size, factor, T._U)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        known = _kept[base] = out
    return known


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo 2**64."""
    small, large = _tables(base, n)
    return np.multiply.outer(large[: (n >> _STEP) + 1], small).reshape(-1)[:n]


def power_at(base: int, at: np.ndarray, n: int) -> np.ndarray:
    """The powers of some places below n."""
    small, large = _tables(base, n)
    return large[at >> _STEP] * small[at & (1 << _STEP) - 1]


def coded(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane by byte plane, compressed; few ones as they are."""
    if len(values) < 32:
        return b"\0" + values.tobytes()
    steps = np.diff(values, prepend=np.uint64(0))
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def decoded(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\0":
        return np.frombuffer(blob, T._U, offset=1)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(T._U).reshape(-1), dtype=T._U)


def check_bytes(total: int) -> int:
    """Bytes of a fingerprint beyond 64 bits, so that n^2 / 2 pairs of ``total`` suffixes leave a chance of 2^-20."""
    return min(8, max(0, math.ceil((2 * math.log2(total + 1) - 1 + 20 - 64) / 8)))


def distinct(values: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Distinct fingerprints in ascending order, their checks, the place of the first of each, and for each fingerprint
    the number of its like."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    if checks is not None:
        c = checks[order]
        if (~new[1:] & (c[1:] != c[:-1])).any():
            order = np.lexsort((checks, values))
            v, c = values[order], checks[order]
            new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(new) - 1
    return v[new], checks[order[new]] if checks is not None else None, order[new], number


def _pack(block_bytes: int):
    """Blocks of the documents of a partition, which come in order; a mark announces that the next row is a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        marked: tuple[int, int] | None = None

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            places = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            stays = np.ones(batch.num_rows, bool)
            for k, mark in enumerate(batch.column(4).to_pylist()):
                if mark:
                    marked, stays[k] = places[k], False
                elif places[k] == marked:
                    stays[k] = False
            own = batch.filter(pa.array(stays)).select([0, 1])
            for piece in T.pieces(own, limit=max(1, block_bytes // 8)):
                n = int(T.flat(piece.column(1))[1][-1])
                if held and size + n > block_bytes:
                    yield block()
                    made, held, size = made + 1, [], 0
                held.append(pa.RecordBatch.from_arrays([piece.column(0), piece.column(1).cast(pa.large_string())], names=["doc_id", "text"]))
                size += n
        if held:
            yield block()

    return run


class Block:
    """The documents of one block, with prefix sums for fingerprints."""

    def __init__(self, payload: bytes, more: int):
        table = pa.ipc.open_stream(payload).read_all()
        self.ids = table["doc_id"].combine_chunks()
        self.buf, self.offsets = T.flat(table["text"])
        self.more = more
        self.sums = self._sums(0)

    def _sums(self, k: int) -> np.ndarray:
        """P with P[j]-P[i] = sum of (byte+1) * base**-k over i <= k < j, modulo 2**64."""
        terms = powers(pow(_BASES[k], -1, 1 << 64), len(self.buf))
        terms *= self.buf.astype(np.uint16) + np.uint16(1)
        sums = np.zeros(len(self.buf) + 1, T._U)
        np.cumsum(terms, out=sums[1:])
        return sums

    def prints(self, at: np.ndarray, length: int) -> np.ndarray:
        return T.mix64((self.sums[at + length] - self.sums[at]) * power_at(_BASES[0], at, len(self.sums)))

    def checks(self, at: np.ndarray, length: int) -> np.ndarray | None:
        """Further ``more`` bytes of the fingerprints."""
        if not self.more:
            return None
        sums = self._sums(1)
        return T.mix64((sums[at + length] - sums[at]) * power_at(_BASES[1], at, len(sums))) >> T._U(64 - 8 * self.more)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions whose window stays inside the document, with 48-bit rank classes."""
        width = LENGTH - PERIOD + 1
        found = []
        for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True):
            if b - a >= LENGTH:
                grid = (np.arange(a, b - width + 1, PERIOD)[:, None] + np.array(COVER)).reshape(-1)
                found.append(grid[grid <= b - width])
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return at, self.prints(at, width) >> T._U(16)

    def suffixes(self, recurs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions with a recurring sample in their first PERIOD bytes."""
        near = np.zeros(len(self.buf) + 1, np.int32)  # begins minus ends of the stretches before a recurring sample
        hit = at[recurs]
        starts = self.offsets[np.searchsorted(self.offsets, hit, "right") - 1]
        np.add.at(near, np.maximum(hit - PERIOD + 1, starts), 1)
        np.add.at(near, hit + 1, -1)
        marked = np.cumsum(near[:-1], dtype=np.int32) > 0
        for b, a in zip(self.offsets[1:], self.offsets[:-1], strict=True):
            marked[max(a, b - LENGTH + 1) : b] = False
        return np.flatnonzero(marked)


def _dealt(block: int, values: np.ndarray, checks: np.ndarray | None, more: int, bits: int, buckets: int) -> Iterator[tuple]:
    """The distinct values of a block, ascending, cut by bucket."""
    edges = np.searchsorted(values, np.array([-(-(k << bits) // buckets) for k in range(1, buckets)], T._U)) if buckets > 1 else np.zeros(0, int)
    cuts = np.concatenate([[0], edges, [len(values)]])
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[k]), int(cuts[k + 1])
        yield k, block, b - a, coded(values[a:b]), b"" if checks is None else checks[a:b].view(np.uint8).reshape(-1, 8)[:, :more].tobytes()


def _bits(replies, n: int) -> np.ndarray:
    """The reply bits of a block, in the order of its ascending distinct values."""
    parts = [np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8), count=r["n"]) for r in sorted(replies or [], key=lambda r: r["bucket"])]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(out) != n:
        raise RuntimeError("a block and its replies differ")
    return out


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "block", "n", "blob", "checks"])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array | list:
    k = batch.schema.get_field_index(name)
    return batch.column(k) if k >= 0 else [None] * batch.num_rows


def _each(batches, *names: str) -> Iterator[list]:
    """The named values row by row; a missing column has None. One row's payload at a time leaves Arrow."""
    for batch in batches:
        columns = [_column(batch, n) for n in names]
        for k in range(batch.num_rows):
            yield [c[k].as_py() if c[k] is not None else None for c in columns]


def _send_samples(buckets: int):
    def run(batches):
        for block, payload in _each(batches, "block", "payload"):
            yield _rows(list(_dealt(block, np.unique(Block(payload, 0).samples()[1]), None, 0, 48, buckets)))

    return run


def _recurring(own: Block, replies) -> tuple[np.ndarray, np.ndarray]:
    """Sample positions, and which of them recur in this block or another."""
    at, values = own.samples()
    known, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    return at, ((counts > 1) | _bits(replies, len(known)))[number]


def _send_suffixes(buckets: int, more: int):
    def run(batches):
        for block, payload, replies in _each(batches, "block", "payload", "samples"):
            own = Block(payload, more)
            at, recurs = _recurring(own, replies)
            where = own.suffixes(recurs, at)
            values, checks, *_ = distinct(own.prints(where, LENGTH), own.checks(where, LENGTH))
            yield _rows(list(_dealt(block, values, checks, more, 64, buckets)))

    return run


def _answer(later_only: bool, more: int):
    """Sorts one bucket; the reply to each block has a bit for each of its values: it occurs in another block (or, if
    later_only, in an earlier one)."""

    def run(key, table):
        order = np.argsort(table["block"].to_numpy(), kind="stable")
        blobs, sizes = table["blob"].combine_chunks(), table["n"].to_numpy()[order]
        values = np.concatenate([decoded(blobs[int(k)].as_py()) for k in order])
        rank = np.argsort(values, kind="stable")
        ordered = values[rank]
        twin = ordered[1:] == ordered[:-1]
        if more:
            raw = table["checks"].combine_chunks()
            checks = np.concatenate([np.frombuffer(raw[int(k)].as_py(), np.uint8).reshape(-1, more) for k in order])
            c = checks[rank]
            if (twin & (c[1:] != c[:-1]).any(axis=1)).any():
                wide = np.zeros((len(checks), 8), np.uint8)
                wide[:, :more] = checks
                wide = wide.view(T._U)[:, 0]
                rank = np.lexsort((wide, values))
                ordered, c = values[rank], wide[rank]
                twin = (ordered[1:] == ordered[:-1]) & (c[1:] == c[:-1])
        same = np.zeros(len(values), bool)
        same[1:] = twin
        if not later_only:
            same[:-1] |= twin
        flags = np.empty(len(values), bool)
        flags[rank] = same
        ends = np.cumsum(sizes)
        press = zstandard.ZstdCompressor(level=1)
        blocks = table["block"].to_numpy()[order]
        bucket = table["bucket"][0].as_py()
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()),
                "bucket": pa.array([bucket] * len(blocks), pa.int32()),
                "n": pa.array(sizes, pa.int32()),
                "bits": pa.array([press.compress(np.packbits(flags[e - n : e]).tobytes()) for n, e in zip(sizes, ends, strict=True)], pa.binary()),
            }
        )

    return run


def _finish(more: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for payload, samples, replies in _each(batches, "payload", "samples", "suffixes"):
            own = Block(payload, more)
            at, recurs = _recurring(own, samples)
            where = own.suffixes(recurs, at)
            values, _, first, number = distinct(own.prints(where, LENGTH), own.checks(where, LENGTH))
            late = _bits(replies, len(values))[number]
            late |= np.arange(len(where)) != first[number]
            edge = np.zeros(len(own.buf) + 1, np.int32)
            np.add.at(edge, where[late], 1)
            np.add.at(edge, where[late] + LENGTH, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            begins, stops = gone.copy(), gone.copy()
            begins[1:] &= ~gone[:-1]
            stops[:-1] &= ~gone[1:]
            heads, tails = own.offsets[:-1][own.offsets[:-1] < len(gone)], own.offsets[1:] - 1
            begins[heads], stops[tails[tails >= 0]] = gone[heads], gone[tails[tails >= 0]]
            starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            cuts = np.searchsorted(starts, own.offsets)
            base = np.repeat(own.offsets[:-1], np.diff(cuts))
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], fields=list(kind.value_type)))
            left = np.concatenate([[0], np.cumsum(~gone, dtype=np.int32)])[own.offsets]
            rest = own.buf[~gone]
            kept = pa.Array.from_buffers(pa.binary(), len(own.ids), [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(rest)])
            yield pa.RecordBatch.from_arrays([own.ids, pa.array(np.diff(own.offsets)), spans, kept], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


_made: list[tuple[SparkSession, str, str]] = []


@atexit.register
def _clean() -> None:
    for spark, name, folder in _made:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, folder)
        except Exception:  # noqa: BLE001, PERF203 - the session may be gone at exit
            return


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal removed run, in bytes) and kept (the bytes that stay) for
    each row."""
    spark = docs.sparkSession
    docs = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    total = text_bytes(docs)
    more, tasks = check_bytes(total), min(TASKS, range_count(total, block_bytes))

    h = F.coalesce(F.xxhash64("text"), F.lit(0))
    keyed = written(docs.filter(F.octet_length("text") >= LENGTH).select("doc_id", "file_key", "row_at", F.md5("text").alias("k"), h.alias("h"), F.octet_length("text").cast("long").alias("n_bytes")))
    firsts = keyed.groupBy("k", "h", "n_bytes").agg(F.min(F.struct("doc_id", "file_key", "row_at")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    firsts = written(firsts.select("k", "h", "n_bytes", F.col("first.file_key").alias("file"), F.col("first.row_at").alias("at")))
    copies = written(keyed.join(firsts, ["k", "h", "n_bytes"]).filter("file_key <> file or row_at <> at").select("doc_id", "file_key", "row_at", "h", "n_bytes"))
    release(keyed, firsts)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "file_key", "row_at", F.lit(False).alias("mark"), h.alias("h"))
    marks = copies.select("doc_id", F.lit("").alias("text"), "file_key", "row_at", F.lit(True).alias("mark"), "h")
    dealt = rows.unionByName(marks).repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h", "file_key", "row_at", F.col("mark").desc())
    packed = dealt.drop("h").mapInArrow(_pack(block_bytes), "block long, payload binary")
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    _made.append((spark, name, folder))
    if tasks == TASKS:  # a task holds many blocks: one file for each bucket instead of one for each block
        packed = packed.repartition(tasks, "block")
    # bucketed by block: joins with the replies leave the texts where they are
    packed.write.bucketBy(tasks, "block").option("compression", "none").option("path", folder).format("parquet").saveAsTable(name)
    blocks = spark.table(name).select("block", "payload")
    buckets = range_count(total * len(COVER) // PERIOD, BUCKET)

    def replies(sent: DataFrame, later_only: bool, checked: int, alias: str) -> DataFrame:
        answered = sent.groupBy("bucket").applyInArrow(_answer(later_only, checked), "block long, bucket int, n int, bits binary")
        return written(answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(alias)))

    one = replies(blocks.mapInArrow(_send_samples(buckets), _SENT), False, 0, "samples")
    known = blocks.join(one, "block", "left")
    two = replies(known.mapInArrow(_send_suffixes(range_count(total, BUCKET), more), _SENT), True, more, "suffixes")
    rest = known.join(two, "block", "left").mapInArrow(_finish(more), _OUT)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return rest.unionByName(copies.select("doc_id", "n_bytes", span.alias("spans"), F.lit(b"").alias("kept")))
