"""Absolute poses from steps: an inclusive prefix scan with any associative product, also a non-commutative one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as Q
from ..sources.tables import written

Parts = dict[str, Column]
#: steps that one row folds
WIDTH = 64
POSE = ("x", "y", "z", "gripper", "qw", "qx", "qy", "qz")


def scan(rows: DataFrame, by: list[str], n: str, values: list[str], product: Callable[[Parts, Parts], Parts], width: int = WIDTH) -> DataFrame:
    """(by, n, values): the product of all rows of a group up to each row, in the order of ``n`` (numbers from 0).

    ``product(old, new)`` takes and gives columns by name; it must be associative, but not commutative. Segments of
    ``width`` rows are folded on their own, their products are scanned the same way, level by level, and what stands
    before a segment is put in front of each of its rows. So no row or task holds more than a segment, a group of n rows
    takes log(n) / log(width) levels, and a group's segments are spread over all tasks.
    """
    segment = F.floor(F.col(n) / width).cast("long").alias("_segment")
    lists = rows.groupBy(*by, segment).agg(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), *values))).alias("s"))

    def put(out: Column, new: Column) -> Column:
        old = F.element_at(out, -1)
        made = product({v: old[v] for v in values}, {v: new[v] for v in values})
        return F.concat(out, F.array(F.struct(new["n"].alias("n"), *(made[v].alias(v) for v in values))))

    folded = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.slice("s", 1, 1), put)
    local = written(lists.select(*by, "_segment", folded.alias("s")), "segments")
    opened = lambda frame, *more: frame.select(*by, *more, F.explode_outer("s").alias("s")).select(*by, *more, F.col("s.n").alias(n), *(F.col(f"s.{v}").alias(v) for v in values))
    if not local.agg(F.max("_segment")).first()[0]:
        return opened(local)
    last = F.element_at("s", -1)
    totals = local.select(*by, F.col("_segment").alias(n), *(last[v].alias(v) for v in values))
    upto = scan(totals, by, n, values, product, width)
    before = upto.select(*(F.col(b).alias(f"_by_{b}") for b in by), (F.col(n) + 1).alias("_next"), *(F.col(v).alias(f"_{v}") for v in values))
    same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by), F.col("_segment") == F.col("_next"))
    joined = opened(local.join(before, same, "left"), "_next", *(f"_{v}" for v in values))
    whole = product({v: F.col(f"_{v}") for v in values}, {v: F.col(v) for v in values})
    return joined.select(*by, n, *(F.when(F.col("_next").isNull(), F.col(v)).otherwise(whole[v]).alias(v) for v in values))


def _moved(old: Parts, new: Parts) -> Parts:
    """The pose after another step: positions and grippers add up, rotations multiply from the left."""
    q = Q.multiply(*(tuple(p[k] for k in POSE[4:]) for p in (new, old)))
    return {k: old[k] + new[k] for k in POSE[:4]} | dict(zip(POSE[4:], q, strict=True))


def pose_track(steps: DataFrame, by: list[str], n: str, position: Q.Vector, turn: Q.Vector, gripper: Column, start: tuple[Q.Vector, Q.Quaternion, Column], width: int = WIDTH) -> DataFrame:
    """(by, n, x, y, z, gripper, qw, qx, qy, qz): the absolute pose after each step.

    A step moves the position, turns by a rotation vector in the global frame (new * old) and opens the gripper. ``start``
    (position, quaternion of any length, gripper) is taken from the row with n = 0 of each group.
    """
    names = [f"_s{k}" for k in range(3)], [f"_t{k}" for k in range(3)], [f"_u{k}" for k in range(4)]
    where, spin, open_ = start
    length = F.sqrt(reduce(lambda x, y: x + y, (c * c for c in spin)))
    rows = steps.select(*by, n, *(c.alias(k) for c, k in zip((*position, *turn), names[0] + names[1], strict=True)), gripper.alias("_g"), *(c.alias(f"_w{k}") for k, c in enumerate(where)), *((c / length).alias(k) for c, k in zip(spin, names[2], strict=True)), open_.alias("_o"))
    rows, q = Q.staged(rows, "_q", Q.from_rotvec(tuple(F.col(k) for k in names[1])))
    step = dict(zip(POSE, (*(F.col(k) for k in names[0]), F.col("_g"), *q), strict=True))
    first = dict(zip(POSE, (*(F.col(f"_w{k}") for k in range(3)), F.col("_o"), *(F.col(k) for k in names[2])), strict=True))
    moved = _moved(first, step)
    rows = rows.select(*by, n, *(F.when(F.col(n) == 0, moved[k]).otherwise(step[k]).alias(k) for k in POSE))
    return scan(rows, by, n, list(POSE), _moved, width)
