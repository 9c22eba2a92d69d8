"""Repeatable sampling, shuffles, noise levels and augmentation parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import beta_15_1, order_key, seed32, uniform


def cap(rows: DataFrame, key: str, n: int, seed=0) -> DataFrame:
    """n rows without replacement, the same on every run: the first n by a hash of the key (a top-n, no full sort)."""
    return rows.withColumn("_o", order_key(seed, F.col(key))).orderBy("_o", key).limit(n).drop("_o")


def shuffle_batches(rows: DataFrame, key: str, size: int, seed=0, drop_last: bool = True, shards: int = 1) -> DataFrame:
    """Batch numbers after a repeatable shuffle. Each shard (by hash) is shuffled and batched alone, as data-parallel
    loaders do, so with enough shards no task sorts all rows; batch numbers of a shard are its own."""
    hashed = rows.withColumn("_o", order_key(seed, F.col(key))).withColumn("shard", F.pmod(F.conv(F.substring("_o", 1, 8), 16, 10).cast("bigint"), F.lit(shards)))
    w = Window.partitionBy("shard").orderBy("_o", key)
    numbered = hashed.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    if drop_last:
        numbered = numbered.withColumn("_n", F.count("*").over(Window.partitionBy("shard", "batch"))).filter(F.col("_n") == size).drop("_n")
    return numbered.drop("_o")


def pick(array: Column, *key) -> Column:
    """One element by hash."""
    return F.get(array, F.pmod(seed32(*key), F.size(array).cast("bigint")).cast("int"))


def dropout(text: Column, chance: float, *key) -> Column:
    return F.when(uniform(*key) < chance, "").otherwise(text)


def shift(t: Column, s: float) -> Column:
    return s * t / (1 + (s - 1) * t)


def noise_levels(mode: str, s: float, clean_ratio: float, *key) -> tuple[Column, Column, Column]:
    """(video level, action level, weight of action and state losses) in one of the modes joint, independent, uniform
    and beta."""
    one = F.lit(1.0)
    if mode == "joint":
        clean = uniform(*key, "c") < clean_ratio
        action = uniform(*key, "a")
        high = action + beta_15_1(*key, "b") * (1 - action)
        return shift(F.when(clean, uniform(*key, "v")).otherwise(high), s), shift(F.when(clean, 0.0).otherwise(action), s), F.when(clean, 0.0).otherwise(1.0)
    if mode == "independent":
        return shift(uniform(*key, "v"), s), shift(uniform(*key, "a"), s), one
    if mode in ("uniform", "beta"):
        t = shift(uniform(*key, "v") if mode == "uniform" else beta_15_1(*key, "b"), s)
        return t, t, one
    raise ValueError(f"unknown mode {mode!r}")


def crop_origin(size: int, cropped: int, *key) -> Column:
    """Top or left of a random crop."""
    return F.floor(uniform(*key) * (size - cropped + 1)).cast("long")


def jitter(low: float, high: float, *key) -> Column:
    return low + uniform(*key) * (high - low)


def permute(items: Column, *key) -> Column:
    """Elements of an array in the order of hashes of their places."""
    tagged = F.transform(items, lambda x, k: F.struct(order_key("_".join(str(p) for p in key if not isinstance(p, Column)), F.concat_ws("_", *(p.cast("string") for p in key if isinstance(p, Column)), k.cast("string"))).alias("o"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])
