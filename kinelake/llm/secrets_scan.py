"""Secret scans by dictionary-primed zstandard novelty.

Candidates are strings after words that announce a secret, with what dots join to them. Each is measured by the bytes
it adds when it is compressed with a dictionary of common identifiers and the text around it, where copies of itself are
blanked out: what repeats its surroundings or is put together from identifiers costs little. Those whose added bytes
reach ``NOVELTY`` of what random strings of the same alphabet and length cost under the same compressor are reported as
kind "novel". Spans of the three base kinds (assign, access, hex) always stay; a novel span that overlaps one is not
reported again. Strings without a digit are no candidates: a plain word of 16 letters costs as much as a random string.

What the novelty measure sees is set by two parameters of ``spans``: ``around`` characters on both sides are the
surroundings, and a string is in sensitive context if it starts within ``reach`` characters after a context word.

Defined cases: null and empty texts have no spans; spans count code points, end exclusive; bytes that are no UTF-8 are
taken, and written by the redaction, as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
NOVELTY, AROUND, REACH = 0.8, 512, 48
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: fixed values: words that announce a secret
CONTEXT = ("password", "passwd", "secret", "token", "key", "credential", "bearer", "auth", "private", "signature")
_CONTEXT = re.compile("|".join(CONTEXT))
_RUN, SHORTEST = re.compile(r"[A-Za-z0-9+/_=-]+"), 16
#: fixed values: identifiers that code around secrets is made of
IDENTIFIERS = b" ".join(
    b"password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret authorization bearer basic credential username user_name account "
    b"config configuration settings environment production development staging default example placeholder changeme connection connection_string database endpoint localhost server "
    b"function return import export class public static final const value string number boolean true false null undefined request response header content type application json "
    b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ https http www com org net github manager service controller handler factory builder repository signature".split()
)


def added_bytes(candidate: bytes, around: bytes) -> int:
    """Bytes that the candidate adds to the compressed form of what stands around it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(19, source_size=len(candidate), dict_size=len(primed.as_bytes()), write_content_size=False, write_checksum=False, write_dict_id=False)
    press = zstandard.ZstdCompressor(dict_data=primed, compression_params=parameters)
    return len(press.compress(candidate)) - len(press.compress(b""))


#: classes of characters that a random string draws from as a whole; any other character is a class of its own
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
#: random strings that are measured for a cost, and the length from which the cost grows in proportion
_DRAWS, _LONG = 5, 4096


def alphabet(candidate: str) -> str:
    """The characters of all classes that the candidate has members of."""
    own = set(candidate)
    known = "".join(c for c in _CLASSES if own.intersection(c))
    return known + "".join(sorted(own.difference(known)))


@lru_cache(maxsize=1 << 14)
def random_cost(letters: str, length: int) -> float:
    """Bytes that random strings of this alphabet and length add, on average over fixed draws: short ones their length,
    longer ones what their entropy code and its table take."""
    if length > _LONG:
        return random_cost(letters, _LONG) * length / _LONG
    draw = random.Random(length)
    return sum(added_bytes("".join(draw.choices(letters, k=length)).encode(), b"") for _ in range(_DRAWS)) / _DRAWS


def novelty(candidate: str, before: str, after: str) -> float:
    """Added bytes over those of random strings of the same alphabet and length (at most 1)."""
    added = added_bytes(candidate.encode(), (before + " " + after).encode("utf-8", "replace"))
    return min(1.0, added / max(1.0, random_cost(alphabet(candidate), len(candidate))))


def surroundings(text: str, a: int, b: int, around: int = AROUND) -> tuple[str, str]:
    """The ``around`` characters on both sides of text[a:b], with copies of it (cut ones at the edges too) blanked out."""
    core = text[a:b].strip("+/_=-") or text[a:b]
    blank, more = " " * len(core), around + len(core) - 1
    return text[max(0, a - more) : a].replace(core, blank)[-around:], text[b : b + more].replace(core, blank)[:around]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def spans(text: str, reach: int = REACH, around: int = AROUND) -> list[tuple[str, int, int]]:
    """All spans, by start, then kind as listed."""
    found = base_spans(text)
    taken = sorted((a, b) for _, a, b in found)
    starts, reached = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    folded = text.translate(_FOLD)
    end = walked = -1
    for c in _CONTEXT.finditer(folded):
        for m in _RUN.finditer(text, c.end()):
            if m.start() > c.end() + reach:
                break
            # parts joined by dots are one token: what announces the first announces all
            while m:
                a, b = m.span()
                own = m[0]
                if b - a >= SHORTEST and a >= end and any(x.isdigit() for x in own) and any(x.isalpha() for x in own) and not _meets(starts, reached, a, b):
                    end = b
                    if novelty(own, *surroundings(text, a, b, around)) >= NOVELTY:
                        found.append(("novel", a, b))
                m = _RUN.match(text, b + 1) if b >= walked and text[b : b + 1] == "." else None
                walked = max(walked, b)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _meets(starts: list[int], reached: list[int], a: int, b: int) -> bool:
    """Whether a span overlaps one of those that begin at ``starts``; ``reached`` are their running largest ends."""
    k = bisect_left(starts, b)
    return k > 0 and reached[k - 1] > a


_FOLD = {k: k + 32 for k in range(65, 91)}


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, redacted: bool = False, reach: int = REACH, around: int = AROUND) -> DataFrame:
    """doc_id and spans (array of kind, start, end) for each row, or the columns of docs with the secrets in text
    replaced by marks (redacted)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    hexes = np.zeros(256, bool)
    hexes[[ord(c) for c in "0123456789abcdef"]] = True
    words = [w.encode() for w in ("passw", "secret", "token", "key", "credential", "bearer", "auth", "private", "signature")]

    def found_in(texts) -> list[list[tuple[str, int, int]]]:
        buf, offsets = T.flat(texts)
        # documents with a run of 16 hexadecimal digits
        sums = np.concatenate([[0], np.cumsum(hexes[buf])])
        full = np.concatenate([[0], np.cumsum(sums[16:] - sums[:-16] == 16)]) if len(buf) >= 16 else np.zeros(1, np.int64)
        low = T.LOWER[buf]
        out = []
        for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            raw, folded = buf[a:b].tobytes(), low[a:b].tobytes()
            long_hex = b - a >= 16 and full[b - 15] > full[a]
            out.append(spans(raw.decode("utf-8", "replace"), reach, around) if long_hex or b"AKIA" in raw or any(w in folded for w in words) else [])
        return out

    if redacted:
        names = docs.columns
        at = names.index("text")

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch):
                    texts = [t if v else None for t, v in zip(T.texts(piece.column(at)), piece.column(at).is_valid().to_pylist(), strict=True)]
                    new = [redact(t, s) if s else t for t, s in zip(texts, found_in(piece.column(at)), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(new, piece.column(at).type) if k == at else piece.column(k) for k in range(len(names))], names=names)

        return docs.mapInArrow(replace, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                found = found_in(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
