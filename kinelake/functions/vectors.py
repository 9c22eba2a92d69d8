"""Fixed-width vectors: normalisation, masks, arrays as small tensors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-6


def normalise(x: Column, low: Column, high: Column) -> Column:
    """2 (x - q01) / max(q99 - q01, 1e-6) - 1, not clipped."""
    return 2 * (x - low) / F.greatest(high - low, F.lit(FLOOR)) - 1


def normalise_unguarded(x: Column, low: Column, high: Column) -> Column:
    """The same without the floor: NULL where q01 = q99."""
    return F.try_divide(2 * (x - low), high - low) - 1


def denormalise(y: Column, low: Column, high: Column) -> Column:
    return (y + 1) / 2 * (high - low) + low


def present(vector: Column, width: int) -> tuple[Column, Column]:
    """(values, mask): an absent vector is zeros with mask 0."""
    zeros, ones = F.array_repeat(F.lit(0.0), width), F.array_repeat(F.lit(1.0), width)
    return F.coalesce(vector, zeros), F.when(vector.isNull(), zeros).otherwise(ones)


def masked(values: Column, mask: Column) -> Column:
    """Values forced to 0 where the mask is 0."""
    return F.zip_with(values, mask, lambda v, m: F.when(m == 0, 0.0).otherwise(v))


def gather(array: Column, ids: Column, strict: bool = False) -> Column:
    """Elements by a list of 0-based ids; out of range is an error (strict) or NULL."""
    return F.transform(ids, lambda k: array[k] if strict else F.get(array, k))


def head(array: Column, rows: int) -> Column:
    return F.slice(array, 1, rows)


def pad_zeros(array: Column, count: int) -> Column:
    return F.concat(array, F.array_repeat(F.lit(0.0), count))


def zero_from(array: Column, first: int) -> Column:
    """Elements from ``first`` on forced to 0 (an arm without statistics)."""
    return F.transform(array, lambda x, k: F.when(k >= first, 0.0).otherwise(x))


def first_fixed(values: Column, given: Column) -> Column:
    """The first element comes from ``given`` (conditioning frame)."""
    return F.transform(values, lambda x, k: F.when(k == 0, given).otherwise(x))


def scale_depth(x: Column, low: Column, high: Column) -> Column:
    """To -1..1 by the range; 0 if the range is at most 1e-6."""
    return F.when(high - low <= FLOOR, 0.0).otherwise(2 * (x - low) / F.greatest(high - low, F.lit(FLOOR)) - 1)


def mix(x: Column, noise: Column, t: Column) -> Column:
    """(1 - t) x + t noise, element by element."""
    return F.zip_with(x, noise, lambda a, b: (1 - t) * a + t * b)


def velocity(x: Column, noise: Column) -> Column:
    return F.zip_with(x, noise, lambda a, b: b - a)


def guide(unconditional: Column, conditional: Column, scale: Column) -> Column:
    """u + c (k - u) for c > 0; c = 0 means conditional only."""
    return F.when(scale > 0, unconditional + scale * (conditional - unconditional)).otherwise(conditional)


def sinusoid(position: Column, dim: int, base: float = 10000.0) -> Column:
    """cos then sin of position * base^(-k / (dim/2))."""
    ks = F.sequence(F.lit(0), F.lit(dim // 2 - 1))
    angle = lambda k: position * F.pow(F.lit(base), -k.cast("double") / (dim // 2))
    return F.concat(F.transform(ks, lambda k: F.cos(angle(k))), F.transform(ks, lambda k: F.sin(angle(k))))


def rotate_pairs(array: Column, position: Column, dim: int, base: float = 10000.0) -> Column:
    """Rotary embedding: pair k is turned by position * base^(-2k/dim)."""

    def turned(k: Column) -> Column:
        angle = position * F.pow(F.lit(base), -2.0 * k.cast("double") / dim)
        a, b = F.get(array, 2 * k).cast("double"), F.get(array, 2 * k + 1).cast("double")
        return F.array(a * F.cos(angle) - b * F.sin(angle), a * F.sin(angle) + b * F.cos(angle))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), turned))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row; a function of elements would compute it for each element."""
    return F.transform(F.array(value), body)[0]


def rms_norm(array: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(total(F.transform(array, lambda x: x.cast("double") * x)) / F.size(array) + eps)
    return let(scale, lambda s: F.transform(array, lambda x: x / s))


def layer_norm(array: Column, eps: float = 1e-6) -> Column:
    centred = let(total(array) / F.size(array), lambda mean: F.transform(array, lambda x: x - mean))
    spread = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + eps)
    return let(centred, lambda c: let(spread(c), lambda s: F.transform(c, lambda x: x / s)))


def softmax(array: Column) -> Column:
    powers = let(F.array_max(array), lambda top: F.transform(array, lambda x: F.exp(x.cast("double") - top)))
    return let(powers, lambda p: let(total(p), lambda z: F.transform(p, lambda x: x / z)))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def reparameterise(mean: Column, log_variance: Column, noise: Column) -> Column:
    """mean + std * noise with the log-variance clamped to -30..20."""
    return mean + F.exp(0.5 * F.greatest(F.least(log_variance, F.lit(20.0)), F.lit(-30.0))) * noise


#: fixed values: number of buckets of relative positions, and the distance from which all share the last one
BUCKETS, FURTHEST = 32, 128


def relative_bucket(distance: Column, buckets: int = BUCKETS, furthest: int = FURTHEST, both_ways: bool = True) -> Column:
    """Bucket of a relative position. Of the buckets of one sign the first half hold one distance each; the others
    divide the distances up to ``furthest`` evenly on a log scale. Forward positions take the upper half of all buckets."""
    own = buckets // 2 if both_ways else buckets
    alone = own // 2
    size = F.abs(distance) if both_ways else F.greatest(-distance, F.lit(0))
    octaves = F.ln(F.greatest(size, F.lit(alone)) / F.lit(float(alone))) / math.log(furthest / alone)
    bucket = F.least(size, F.lit(alone) + F.floor(octaves * (own - alone)), F.lit(own - 1))
    return (bucket + (F.when(distance > 0, own).otherwise(0) if both_ways else 0)).cast("long")


def latent_block(frame: Column) -> Column:
    """Block of a frame in a chunked cache: the first alone, then blocks of four."""
    return F.when(frame == 0, 0).otherwise(1 + F.floor((frame - 1) / 4)).cast("long")


def best_size(width: Column, height: Column, step_w: int, step_h: int, area: int) -> Column:
    """Output size (w, h) of at most ``area`` pixels, both in steps, whose aspect ratio deviates least.

    The candidates come from one side rounded down in steps from its ideal length and the other one filling up the area;
    of those with equal deviation the one whose height was rounded counts."""

    def steps(x: Column, step: int) -> Column:
        return F.floor(x / step) * step

    ideal = F.sqrt(F.lit(float(area)) * width / height)
    sides = ((step_w, step_h, ideal, lambda a, b: (a, b)), (step_h, step_w, area / ideal, lambda a, b: (b, a)))
    found = []
    for rank, (own, other, length, as_size) in enumerate(sides):
        rounded = steps(length, own)
        w, h = as_size(rounded, steps(area / rounded, other))
        off = F.abs(F.ln(w.cast("double") / h) - F.ln(width / height))
        found.append(F.struct(F.round(off, 12).alias("off"), F.lit(-rank).alias("tie"), w.cast("long").alias("w"), h.cast("long").alias("h")))
    best = F.array_min(F.array(*found))
    return F.struct(best["w"].alias("w"), best["h"].alias("h"))


def repeat_each(array: Column, times: int) -> Column:
    return F.flatten(F.transform(array, lambda v: F.array_repeat(v, times)))


def average_groups(array: Column, size: int) -> Column:
    """Means of consecutive groups; zeros in front fill up the first."""
    n = F.size(array)
    full = F.concat(F.array_repeat(F.lit(0.0), F.pmod(-n, F.lit(size)).cast("int")), F.transform(array, lambda x: x.cast("double")))
    starts = F.sequence(F.lit(0), (F.size(full) / size).cast("int") - 1)
    return F.transform(starts, lambda k: total(F.slice(full, k * size + 1, size)) / size)


def latent_scaled(array: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std by channel."""
    return F.zip_with(array, F.arrays_zip(F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, std)).alias("s")), lambda x, c: (x.cast("double") - c["m"]) / c["s"])


def latent_unscaled(array: Column, mean: list[float], std: list[float]) -> Column:
    """x std + mean by channel."""
    return F.zip_with(array, F.arrays_zip(F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, std)).alias("s")), lambda x, c: x * c["s"] + c["m"])


#: fixed values: first number that half precision rounds to infinity, and the bound that values are cut to then
HALF_OVERFLOW, HALF_BOUND = 65520.0, 65504.0 - 1000.0


def half_clamped(array: Column) -> Column:
    """Values as half precision could hold them: if one of them overflows, all are cut to a bound below the largest."""
    cut = F.transform(array, lambda x: F.greatest(F.least(x, F.lit(HALF_BOUND)), F.lit(-HALF_BOUND)))
    return F.when(F.exists(array, lambda x: F.abs(x) >= HALF_OVERFLOW), cut).otherwise(array)


def repeat_over_time(first: Column, frames: int) -> Column:
    """The first frame or state at every step."""
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda _: first)


def zeros(steps: int, width: int) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0.0), width), steps)


def like_masks(array: Column, chance: Column | None = None, level: Column | None = None) -> tuple[Column, Column]:
    """Two masks of ones whose first place is 0; with a ``chance`` condition, only where it holds, and then the first
    mask has ``level`` there."""
    ones = F.transform(array, lambda x: F.lit(1.0))
    head = lambda v: F.transform(ones, lambda x, k: F.when(k == 0, v).otherwise(x))
    if chance is None:
        return head(F.lit(0.0)), head(F.lit(0.0))
    return F.when(chance, head(level)).otherwise(ones), F.when(chance, head(F.lit(0.0))).otherwise(ones)
