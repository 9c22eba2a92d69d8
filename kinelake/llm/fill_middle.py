"""Fill-in-middle transformation by run-length classes.

A text is stored as maximal runs of code points of one class (blank or not, and bytes in UTF-8), each with the units that
end in it; their running count is kept beside. A cut after u units is found by binary search for the run that holds the
u-th unit, and its place there by arithmetic: within a run all units have one size. Nothing is looked up unit by unit, and
code points are counted the same way.

Units are ``token`` (blanks and the word after them, or the blanks at the end of a text) or ``char`` (code points).

Defined cases: a null text is empty and stays plain; a row without doc_id stays plain, as nothing can be drawn for it;
rows with one doc_id draw the same numbers; bytes that are no UTF-8 are kept as they are, each byte that begins no code
point belonging to the one before; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as T

SEED, RATE, SPM = 42, 50, 80
#: marks of prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("token", "char")
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Runs:
    """Runs of a slice of texts: first byte, bytes, bytes of a code point, units that end there, and running counts."""

    def __init__(self, column, unit: str = "token"):
        self.buf, self.offsets = T.flat(column)
        offsets, total = self.offsets, len(self.buf)
        lead = (self.buf & 0xC0) != 0x80
        lead[offsets[:-1][offsets[:-1] < total]] = True
        points = np.flatnonzero(lead)
        width = np.diff(points, append=total)
        blank = ~T.BLANK_WORDS[self.buf[points]]
        kind = 2 * width + blank
        first = np.searchsorted(points, offsets)  # of each text, in code points
        begins = np.ones(len(points), bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins[first[:-1][first[:-1] < len(points)]] = True
        at = np.flatnonzero(begins)
        self.start, self.width = points[at], width[at]
        self.size = np.diff(self.start, append=total)
        self.first = np.searchsorted(self.start, offsets)  # of each text, in runs
        self.points = np.concatenate([[0], np.cumsum(np.diff(at, append=len(points)))])
        if unit == "char":
            units = np.diff(self.points)
        else:
            ends = np.zeros(len(at), bool)
            ends[self.first[1:][self.first[1:] > self.first[:-1]] - 1] = True  # the last run of a text ends a token
            word = ~blank[at]
            units = (ends | (word & np.append(~word[1:], True))).astype(np.int64)
        self.units = units
        self.before = np.concatenate([[0], np.cumsum(units)])
        self.n = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def cut(self, d: int, u: int) -> tuple[int, int]:
        """Byte and code point, both from the text's start, after the first u units of text d."""
        if not u:
            return 0, 0
        low = self.first[d]
        r = int(np.searchsorted(self.before, self.before[low] + u)) - 1
        step = int(self.size[r] // self.units[r])
        inside = int(self.before[low] + u - self.before[r]) * step
        return int(self.start[r] + inside - self.offsets[d]), int(self.points[r] - self.points[low]) + inside // int(self.width[r])


def draws(doc_id: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the seed and the row's id alone."""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that can be found again: of their first characters, none occurs later in any mark."""
    if len(set(marks)) < 3 or not all(marks) or any(c[0] in m[1:] for c in marks for m in marks):
        raise ValueError(f"marks {marks} cannot be told apart in an output")
    return marks


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, unit: str = "token") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points), output for each row.

    ``rate`` percent of the rows are cut, ``spm`` percent of these with the suffix first. A text that holds a mark stays
    plain. One scan of the rows; memory is bounded by a slice of texts, or one text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    p, s, m = (x.encode() for x in checked(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                runs = Runs(piece.column(1), unit)
                out: list[list] = [[], [], [], []]
                for d, doc_id in enumerate(piece.column(0).to_pylist()):
                    text = runs.buf[runs.offsets[d] : runs.offsets[d + 1]].tobytes()
                    h = draws(doc_id, seed)
                    if doc_id is None or not text or h[2] % 100 >= rate or any(x in text for x in (p, s, m)):
                        row = ("plain", None, None, text)
                    else:
                        low, high = sorted(x % (int(runs.n[d]) + 1) for x in h[:2])
                        (a, a_points), (b, b_points) = runs.cut(d, low), runs.cut(d, high)
                        spm_form = h[3] % 100 < spm
                        output = s + text[b:] + p + text[:a] if spm_form else p + text[:a] + s + text[b:]
                        row = ("spm" if spm_form else "psm", a_points, b_points - a_points, output + m + text[a:b])
                    for values, value in zip(out, row, strict=True):
                        values.append(value)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(runs.n, pa.int64()), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()).view(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    p, s, m = checked(marks)

    def halves(of: Column, mark: str) -> tuple[Column, Column]:
        at = F.instr(of, mark)
        return F.substring(of, F.lit(1), at - 1), F.substring(of, at + len(mark), F.length(of))

    def body(mark: str) -> Column:
        return F.substring(output, F.lit(len(mark) + 1), F.length(output))

    prefix, rest = halves(body(p), s)
    suffix, middle = halves(rest, m)
    suffix_first, rest_first = halves(body(s), p)
    prefix_last, middle_last = halves(rest_first, m)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_last, middle_last, suffix_first))
