"""Error metrics of predictions in long form: one row for each predicted number."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked_mse(p: Column, t: Column, m: Column) -> Column:
    return F.sum(F.pow((p - t) * m, 2)) / (F.sum(m) + 1e-8)


def mse(p: Column, t: Column) -> Column:
    return F.avg(F.pow(p - t, 2))


def psnr(rows: DataFrame, image: list[str], p: Column, t: Column) -> DataFrame:
    """Mean over images of 10 log10(1 / (mse + 1e-8)); two aggregations."""
    each = rows.groupBy(*image).agg(mse(p, t).alias("mse"))
    return each.agg(F.avg(10 * F.log10(1 / (F.col("mse") + 1e-8))).alias("psnr"))


def fully_valid(masks: DataFrame, sample: list[str], time: str, m: Column) -> DataFrame:
    """Samples of which every step has some valid number."""
    each = masks.groupBy(*sample, time).agg(F.bool_or(m > 0).alias("some"))
    return each.groupBy(*sample).agg(F.bool_and("some").alias("valid"))


def frequency_loss(rows: DataFrame, series: list[str], time: str, p: Column, t: Column, length: int, valid: DataFrame | None = None, sample: list[str] | None = None) -> DataFrame:
    """Mean absolute difference of the real discrete Fourier transforms along time; with ``valid`` (columns ``sample`` and
    valid, from ``fully_valid``) over its valid samples only. The table of cosines and sines is small (length times
    length/2+1 rows), so the transform is one broadcast join and one aggregation."""
    spark = rows.sparkSession
    if valid is not None:
        rows = rows.join(valid.filter("valid").select(*sample), sample, "left_semi")
    wave = spark.createDataFrame([(j, k, math.cos(2 * math.pi * j * k / length), -math.sin(2 * math.pi * j * k / length)) for j in range(length) for k in range(length // 2 + 1)], "_t long, _f int, _c double, _s double")
    joined = rows.join(F.broadcast(wave), rows[time].cast("long") == wave["_t"])
    gap = p - t
    parts = joined.groupBy(*series, "_f").agg(F.sum(gap * F.col("_c")).alias("re"), F.sum(gap * F.col("_s")).alias("im"))
    return parts.agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("freq_loss"))


def mean_over_ranks(rows: DataFrame, *names: str) -> DataFrame:
    """Means of metrics that each rank (row) has reported; a rank without one does not count."""
    return rows.agg(*(F.avg(n).alias(n) for n in names))


def total_loss(parts: dict[str, tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for column, weight in parts.values():
        out = out + column * weight
    return out


def dynamic_threshold(rows: DataFrame, sample: str, value: str, ratio: float = 0.995, most: float = 1.0) -> DataFrame:
    """Clips each sample to s and divides by s, where s is a quantile of its absolute values, at least 1 and at most ``most``."""
    bound = rows.groupBy(sample).agg(F.percentile(F.abs(value), F.lit(ratio)).alias("q")).withColumn("s", F.least(F.greatest(F.col("q"), F.lit(1.0)), F.lit(most)))
    joined = rows.join(bound.select(sample, "s"), sample)
    return joined.withColumn("clipped", F.greatest(F.least(F.col(value), F.col("s")), -F.col("s")) / F.col("s"))


def ssim(images: DataFrame, p: str, t: str, height: int, width: int, window: int = 11, sigma: float = 1.5) -> DataFrame:
    """Structural similarity of two flat images in each row (column ``ssim``): Gaussian window, valid places, mean.
    Sliding windows over two axes have no built-in, so numpy works on Arrow batches."""
    g = np.exp(-((np.arange(window) - window // 2) ** 2) / (2 * sigma**2))
    g /= g.sum()
    one, two = 0.01**2, 0.03**2

    def blur(x: np.ndarray) -> np.ndarray:
        x = np.lib.stride_tricks.sliding_window_view(x, window, axis=1) @ g
        return np.lib.stride_tricks.sliding_window_view(x, window, axis=2) @ g

    @F.pandas_udf("double")
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            if not len(a):
                yield pd.Series([], dtype=float)
                continue
            x, y = (np.stack([np.asarray(v, float) for v in s]).reshape(-1, height, width) for s in (a, b))
            mx, my = blur(x), blur(y)
            vx, vy, xy = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
            yield pd.Series((((2 * mx * my + one) * (2 * xy + two)) / ((mx**2 + my**2 + one) * (vx + vy + two))).mean(axis=(1, 2)))

    return images.withColumn("ssim", each(F.col(p), F.col(t)))
