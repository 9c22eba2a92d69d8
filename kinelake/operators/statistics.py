"""Exact quantile statistics of trajectories in long form (key, axis, value): two passes, deltas, symmetric bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rotation as Q
from ..sources.tables import written

LOW, HIGH, FLOOR = 0.01, 0.99, 1e-6
#: fixed value: least scaled gripper delta that counts as a move
STATIC = 0.01

#: values of a group, or between the bounds of one of its quantiles, that one task ranks
LIMIT = 100_000
#: cells that a group's values are cut into by a sketch where they are more, and the sketch's relative error
GRID, ACCURACY = 256, 10_000
#: a round cannot leave fewer values than some cells hold
FEWEST = 16


def quantiles(pool: DataFrame, by: list[str], few: bool = True, limit: int = LIMIT, accuracy: int | None = None) -> DataFrame:
    """(by, n, q01, q99): exact quantiles by linear interpolation for each group; null keys are a group like others.

    The values are written once. Groups of at most ``limit`` values are ranked as they are. Else each end of a group has
    bounds, at first the least and the greatest value: one scan counts what lies below, at and between them and cuts the
    values strictly between by a mergeable sketch, and the cells around the wanted rank are the next bounds, so each round
    leaves some 4 / ``GRID`` of the values, or makes a value that fills cells a bound, until at most ``limit`` are left.
    Ranks follow from running counts. So no task ranks a group, or more than ``limit`` different values of it.
    ``few`` says that the groups are a fixed set, such as components by axis, so that their bounds can be broadcast;
    ``accuracy`` is the former name of ``limit``.
    """
    limit = limit if accuracy is None else accuracy
    kept = written(pool.filter(F.col("value").isNotNull()).select(*by, F.col("value").cast("double").alias("value")), "pool")
    sizes = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("z")).filter("n > 0")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= limit:
        whole = kept.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(LOW), F.lit(HIGH))).alias("q")).filter("n > 0")
        return whole.select(*by, "n", F.col("q")[0].alias("q01"), F.col("q")[1].alias("q99"))

    def end(k: int, p: float) -> Column:
        place = (F.col("n") - 1) * p
        return F.struct(F.lit(k).alias("k"), F.floor(place).cast("long").alias("at"), (place - F.floor(place)).alias("part"))

    ends = sizes.select(*by, "n", "a", "z", F.explode(F.array(*(end(k, p) for k, p in enumerate((LOW, HIGH))))).alias("p")).select(*by, "n", "p.*", "a", "z")
    own = [*by, "k", "n", "at", "part", "a", "z"]
    while True:
        ends = written(ends, "bounds")
        inside = (F.col("value") > F.col("a")) & (F.col("value") < F.col("z"))
        grid = F.percentile_approx(F.when(inside, F.col("value")), [k / GRID for k in range(GRID + 1)], ACCURACY)
        counts = F.count_if(F.col("value") < F.col("a")).alias("below"), F.count_if(F.col("value") == F.col("a")).alias("least"), F.count_if(inside).alias("m")
        seen = written(_beside(kept, ends, by, few).groupBy(*own).agg(*counts, grid.alias("cells")), "cells")
        if (seen.agg(F.max("m")).first()[0] or 0) <= max(limit, FEWEST):
            break
        # the cells of both wanted ranks, and one more on each side for the sketch's error; beyond them the bounds stay
        rank = F.col("at") - F.col("below") - F.col("least")
        low = (F.floor(rank * GRID / F.col("m")) - 1).cast("int")
        high = (F.ceil((rank + 2) * GRID / F.col("m")) + 1).cast("int")
        open_ = F.col("m") > max(limit, FEWEST)
        a, z = F.when(open_ & (low > 0), F.get("cells", F.least(low, F.lit(GRID)))).otherwise(F.col("a")), F.when(open_ & (high < GRID), F.get("cells", F.greatest(high, F.lit(0)))).otherwise(F.col("z"))
        ends = seen.select(*own[:-2], a.alias("a"), z.alias("z"))

    bounds = seen.drop("cells", "m", "least")
    counted = _beside(kept, bounds, by, few).filter("value >= a and value <= z").groupBy(*own, "below", "value").agg(F.count("*").alias("c"))
    running = Window.partitionBy(*by, "k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.col("below") + F.sum("c").over(running))
    of = lambda k, value, when=True: F.when((F.col("k") == k) & when, value)
    found = []
    for k in range(2):
        low, high = (F.min(of(k, F.col("value"), F.col("upto") > F.col("at") + step)) for step in (0, 1))
        part = F.max(of(k, F.col("part")))
        found.append(low + F.when(part > 0, part * (high - low)).otherwise(0.0))
    return placed.groupBy(*by, "n").agg(*(q.alias(name) for q, name in zip(found, ("q01", "q99"), strict=True)))


def _beside(values: DataFrame, bounds: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Every value with the bounds of both ends of its group; null keys meet."""
    named = bounds.select(*(F.col(b).alias(f"_{b}") for b in by), *(c for c in bounds.columns if c not in by))
    named = F.broadcast(named) if few else named
    if not by:
        return values.crossJoin(named)  # two rows
    same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by))
    return values.join(named, same).drop(*(f"_{b}" for b in by))


def symmetric(stats: DataFrame, when: Column) -> DataFrame:
    """Bounds -M and M with M = max(|q01|, |q99|) where the condition holds."""
    most = F.greatest(F.abs("q01"), F.abs("q99"))
    return stats.withColumns({"q01": F.when(when, -most).otherwise(F.col("q01")), "q99": F.when(when, most).otherwise(F.col("q99"))})


def ahead(column: str, offset: int, episode: str = "episode", frame: str = "frame") -> Column:
    """The value ``offset`` frames later in the episode, or NULL."""
    return F.lead(column, offset).over(Window.partitionBy(episode).orderBy(frame))


def moving(delta: Column, low: Column, high: Column, threshold: float) -> Column:
    """Static filter: the scaled delta is at least the threshold."""
    return F.abs(delta * 2 / F.greatest(high - low, F.lit(FLOOR))) >= threshold


def gripper_two_pass(frames: DataFrame, skip: int, threshold: float) -> DataFrame:
    """(key, q01, q99, n) of gripper positions and of their deltas. Pass 1 takes quantiles of the positions; pass 2
    those of the raw deltas that move, as symmetric bounds. The pool is written once; pass 1's single row is broadcast."""
    both = F.array(*(F.struct(F.lit(key).alias("key"), F.lit(0).alias("axis"), F.col(c).alias("value")) for key, c in (("gripper_pos", "value"), ("gripper_action", "delta"))))
    pool = frames.withColumn("delta", ahead("value", skip) - F.col("value")).select(F.explode(both).alias("p")).select("p.*")
    return two_passes(written(pool, "pool"), threshold).select("key", "q01", "q99", "n")


def two_passes(pool: DataFrame, threshold: float = STATIC) -> DataFrame:
    """(key, axis, q01, q99, n) of a written pool (key, axis, value). Pass 1: every key but the gripper's deltas. Pass 2:
    of those deltas the ones that move, measured by pass 1's range of positions. Bounds of actions are symmetric; a key
    without values has no rows, and without positions of the gripper there are no deltas of it."""
    first = written(quantiles(pool.filter("key <> 'gripper_action'"), ["key", "axis"]), "pass")
    grip = first.filter("key = 'gripper_pos'").select("q01", "q99")  # one row or none
    deltas = pool.filter("key = 'gripper_action' and value is not null").crossJoin(F.broadcast(grip))
    moved = deltas.filter(moving(F.col("value"), F.col("q01"), F.col("q99"), threshold)).select("key", "axis", "value")
    both = first.unionByName(quantiles(moved, ["key", "axis"]))
    return symmetric(both, F.col("key").startswith("action_") | (F.col("key") == "gripper_action")).select("key", "axis", "q01", "q99", "n")


def rows_of(text: Column, width: int | None = None) -> Column:
    """Rows of numbers from a JSON array: of rows, of matrices (each a row), or of ``width`` numbers after one another."""
    head = F.regexp_replace(F.regexp_extract(text, r"^([\s\[]*)", 1), r"\s", "")
    deep = F.transform(F.from_json(text, "array<array<array<double>>>"), F.flatten)
    rows = F.when(F.length(head) == 2, F.from_json(text, "array<array<double>>")).when(F.length(head) == 3, deep)
    if width is None:
        return rows
    flat = F.from_json(text, "array<double>")
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / width).cast("int") - 1), lambda k: F.slice(flat, k * width + 1, F.lit(width)))
    return F.when((F.length(head) == 1) & (F.size(flat) >= width), cut).otherwise(rows)


def turned(rows: DataFrame, name: str, array: str) -> tuple[DataFrame, Q.Quaternion]:
    """Scalar columns of the quaternion of a rotation vector (3 numbers) or a matrix (9); NULL otherwise."""
    size = F.size(array)
    rows, v = Q.staged(rows, f"{name}v", [F.when((size == 3) | (size == 9), F.get(array, F.lit(k))) for k in range(3)])
    rows, m = Q.staged(rows, f"{name}m", [F.when(size == 9, F.get(array, F.lit(k))) for k in range(9)])
    rows, f = Q.staged(rows, f"{name}f", Q.from_matrix([list(m[3 * i : 3 * i + 3]) for i in range(3)], signed=False))
    return Q.staged(rows, f"{name}q", [F.when(size == 9, x).when(size == 3, y) for x, y in zip(f, Q.from_rotvec(v), strict=True)])


def episode_pool(episodes: DataFrame, action_skip: int = 1, arms: tuple[str, ...] = ("left", "right")) -> DataFrame:
    """(key, axis, value) of all statistics from episodes with ``proprios`` and ``actions`` as maps of JSON texts.

    For each arm: positions; grippers; position and rotation deltas to the action ``action_skip`` - 1 frames later, or
    the parts of raw actions where an episode brings such; gripper deltas over ``action_skip`` frames (all of them, the
    second pass filters). What an episode lacks gives no rows. Rotations are rotation vectors or matrices. Each arm's
    arrays are zipped to frames before they are unfolded, so no row carries its episode.
    """
    if action_skip < 1:
        raise ValueError("action_skip must be positive")
    later = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    arms_ = []
    for k, arm in enumerate(arms):
        made = {"p": rows_of(F.col("proprios")[f"{arm}_ee_pos"], 3), "a": rows_of(F.col("actions")[f"{arm}_ee_pos"], 3), "rp": rows_of(F.col("proprios")[f"{arm}_ee_rotm"]), "ra": rows_of(F.col("actions")[f"{arm}_ee_rotm"]), "g": rows_of(F.col("proprios")[f"{arm}_gripper_pos"], 1), "raw": rows_of(F.col("actions")["raw_actions"])}
        made = {name: F.coalesce(c, F.array().cast("array<array<double>>")) for name, c in made.items()}
        arms_.append(F.struct(F.lit(arm).alias("arm"), F.lit(k).alias("side"), *(c.alias(name) for name, c in made.items())))
    rows = episodes.filter("proprios is not null").select(F.coalesce(F.map_contains_key("actions", F.lit("raw_actions")), F.lit(False)).alias("given"), F.explode_outer(F.array(*arms_)).alias("s")).select("given", "s.*")
    frames = F.arrays_zip(F.col("p"), later(F.col("a"), action_skip - 1).alias("a"), F.col("rp"), later(F.col("ra"), action_skip - 1).alias("ra"), F.col("g"), later(F.col("g"), action_skip).alias("h"), F.col("raw"))
    rows = rows.select("arm", "side", "given", F.explode_outer(frames).alias("x")).select("arm", "side", "given", "x.p", "x.a", "x.rp", "x.ra", F.get("x.g", F.lit(0)).alias("g"), F.get("x.h", F.lit(0)).alias("h"), "x.raw")
    rows, qp = turned(rows, "_p", "rp")
    rows, qa = turned(rows, "_a", "ra")
    rows, q = Q.staged(rows, "_d", Q.multiply(qa, Q.conjugate(qp)))
    rows, c = Q.staged(rows, "_c", Q.canonical(q))
    rows, v = Q.staged(rows, "_v", Q.to_rotvec(c, own=True))
    block = F.when((F.size("raw") % 7 == 0) & (F.size("raw") >= 7 * (F.col("side") + 1)), F.slice("raw", F.col("side") * 7 + 1, F.lit(7)))
    name = lambda kind, what: F.concat(F.lit(f"{kind}_"), F.col("arm"), F.lit(f"_ee_{what}"))
    item = lambda key, axis, value: F.struct(key.alias("key"), F.lit(axis).alias("axis"), value.alias("value"))
    items = [item(name("proprio", "xyz"), k, F.get("p", F.lit(k))) for k in range(3)]
    items += [item(name("action", "xyz"), k, F.when(F.col("given"), F.get(block, F.lit(k))).otherwise(F.get("a", F.lit(k)) - F.get("p", F.lit(k)))) for k in range(3)]
    items += [item(name("action", "axisangle"), k, F.when(F.col("given"), F.get(block, F.lit(3 + k))).otherwise(v[k])) for k in range(3)]
    items += [item(F.lit("gripper_pos"), 0, F.col("g")), item(F.lit("gripper_action"), 0, F.col("h") - F.col("g"))]
    return rows.select(F.explode_outer(F.array(*items)).alias("i")).select("i.*").filter("value is not null")


def statistics_job(episodes: DataFrame, action_skip: int = 1, threshold: float = STATIC) -> DataFrame:
    """(key, axis, q01, q99, n) of all keys: one scan of the episodes writes their pool, which both passes read."""
    return two_passes(written(episode_pool(episodes, action_skip), "pool"), threshold)


def raw_action_pool(rows: DataFrame, array: str, arm_width: int = 7) -> DataFrame:
    """Positions (columns 0-2) and rotations (3-5) of each arm's block of a raw action; the gripper is not pooled. A width
    that is no multiple of an arm's is an error."""
    whole = F.when(F.size(array) % arm_width == 0, F.col(array)).otherwise(F.raise_error(F.format_string(f"raw actions of width %d, not a multiple of {arm_width}", F.size(array))).cast(rows.schema[array].dataType))
    long = rows.select("*", F.posexplode(whole).alias("column", "v"))
    place = F.col("column") % arm_width
    key = F.when(place < 3, "action_ee_pos").when(place < 6, "action_ee_rotm")
    return long.withColumns({"key": key, "axis": (place % 3).cast("int"), "value": F.col("v").cast("double")}).filter("key is not null")
