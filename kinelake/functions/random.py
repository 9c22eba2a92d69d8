"""Repeatable random numbers from hashes: the same on every engine, order and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(parts: tuple) -> Column:
    return F.concat_ws("_", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def seed32(*parts) -> Column:
    """Last 32 bits of the md5 of the parts joined by underscores, as BIGINT."""
    return F.conv(F.substring(F.md5(_text(parts)), 25, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform on [0, 1)."""
    return seed32(*parts) / F.lit(4294967296.0)


def beta_15_1(*parts) -> Column:
    """Beta(1.5, 1): its distribution function is x^1.5, so u^(2/3)."""
    return F.pow(uniform(*parts), F.lit(2 / 3))


def normal(*parts) -> Column:
    """Standard normal by Box and Muller."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(*parts, "r")))
    return radius * F.cos(2 * math.pi * uniform(*parts, "a"))


def order_key(seed, key: Column) -> Column:
    """Sort key of a repeatable shuffle."""
    return F.md5(_text((seed, key)))
