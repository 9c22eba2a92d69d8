"""Vectorised byte-level text primitives shared by the corpus operators.

Everything works on flat UTF-8 buffers of Arrow string columns: no per-word Python objects, and memory is bounded
by ``CHUNK`` bytes of text (one longer document is handled alone). Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes outside the inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: words separated by blanks: [^\x20\x09-\x0D]+
BLANK_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: words of letters, digits and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text)
ALNUM_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and offsets (one more than there are texts); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not n or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column) -> Iterator[str]:
    """The texts one by one; a null is empty, and bytes that are no UTF-8 become U+FFFD."""
    buf, offsets = flat(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield buf[a:b].tobytes().decode("utf-8", "replace")


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most ``limit`` bytes of text each, or one row."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit words."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: masks of the bytes of a block that belong to a range, by their number
_PARTS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: ranges beyond this many bytes are hashed one by one
LONG = 256


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range; depends on its content and length only.

    Blocks of eight bytes go through a bijective mixer one after another, so ranges of one length up to eight bytes
    never collide and no arithmetic structure of a longer one cancels out; long ranges go through xxh3.
    """
    size = ends - starts
    h = mix64((size.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93) + _U(seed))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG)
    at, left = starts[live], size[live]
    while len(live):
        h[live] = mix64((h[live] ^ (blocks[at] & _PARTS[np.minimum(left, 8)])) * _U(0x9E3779B97F4A7C15))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed)
    return h


class Words:
    """Words of a slice of texts: start and end bytes, document index and 64-bit hash of each; ``first[d]`` is the
    index of document d's first word (one entry more than there are documents)."""

    def __init__(self, column, table: np.ndarray, lower: bool = True, hashes: bool = True):
        raw, self.offsets = flat(column)
        self.buf = LOWER[raw] if lower else raw
        inside = table[self.buf]
        n = len(inside)
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        first = self.offsets[:-1]
        first = first[first < n]
        begins[first] = inside[first]
        last = self.offsets[1:] - 1
        last = last[last >= 0]
        stops[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets, "left")
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hash = hash_ranges(self.buf, self.starts, self.ends) if hashes else None

    def points(self) -> np.ndarray:
        """Code points before each byte (one entry more than there are bytes)."""
        return np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every run of n words inside one document."""
    total = len(words.starts)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(words.doc[: total - n + 1] == words.doc[n - 1 :])
    h = np.full(len(at), n, _U)
    for k in range(n):
        h = h * _U(0xC2B2AE3D27D4EB4F) + words.hash[at + k]
    return at, mix64(h)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """The same hashes as ``Words.hash`` for single words (each a non-empty byte string)."""
    joined = pa.array([t.decode("utf-8", "surrogateescape") if isinstance(t, bytes) else t for t in tokens], pa.string())
    buf, offsets = flat(joined)
    return hash_ranges(buf, offsets[:-1], offsets[1:])


def sequence_hash(tokens: list[bytes]) -> int:
    """The same hash as ``ngrams`` for one run of words."""
    h = _U(len(tokens))
    with np.errstate(over="ignore"):
        for w in word_hashes(tokens):
            h = h * _U(0xC2B2AE3D27D4EB4F) + w
    return int(mix64(np.array([h], _U))[0])
