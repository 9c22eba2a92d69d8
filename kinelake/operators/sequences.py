"""Sequences of several kinds as one, and back: unions with a tag and a position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, by column name; repeated rows stay."""
    return reduce(DataFrame.unionByName, parts)


def _starts(lengths: dict[str, int]) -> dict[str, int]:
    out, at = {}, 0
    for kind, n in lengths.items():
        out[kind] = at
        at += n
    return out


def joined(streams: dict[str, DataFrame], lengths: dict[str, int], place: str) -> DataFrame:
    """Streams with one row for each token, one after another: column ``place`` counts inside a kind, ``position`` over
    all, ``kind`` names the kind."""
    starts = _starts(lengths)
    return bag([streams[kind].withColumns({"kind": F.lit(kind), "position": (F.col(place) + start).cast("int")}).drop(place) for kind, start in starts.items()])


def split(tokens: DataFrame, lengths: dict[str, int], place: str) -> dict[str, DataFrame]:
    """The streams again, told apart by position."""
    starts = _starts(lengths)
    return {kind: tokens.filter((F.col("position") >= a) & (F.col("position") < a + lengths[kind])).withColumn(place, F.col("position") - a).drop("position") for kind, a in starts.items()}


def stacked(parts: dict[str, DataFrame], row: Column, height: int) -> DataFrame:
    """Images of one height, one above another: ``row`` of the stack, and the ``source`` of each."""
    return bag([part.withColumns({"source": F.lit(name), "row": row + k * height}) for k, (name, part) in enumerate(parts.items())])
