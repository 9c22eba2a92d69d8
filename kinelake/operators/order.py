"""Row numbers of a whole table or of its groups, without a task that sorts one of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

_PLACE = 33  # bits of a row's place in its partition, as monotonically_increasing_id lays them out


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place (from 0) of each row in its group ``by``, or in the whole table where that is empty.

    Rows are dealt to ranges of (by, order) and sorted there, so a group of any size is spread over as many tasks as it
    fills; a row's number is its place in the range plus the rows of the ranges before, less the group's first number.
    One count for each range reaches the driver. ``order`` must tell rows of a group apart for repeatable numbers.
    """
    spark = rows.sparkSession
    keys = [*by, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part, at = F.shiftrightunsigned("_id", _PLACE).cast("int"), F.col("_id").bitwiseAND((1 << _PLACE) - 1)
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy(part.alias("_part")).count().collect())
    before = [(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))  # one row for each range
    placed = ranged.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + at).drop("_part", "_before", "_id")
    if not by:
        return placed
    firsts = placed.groupBy(*by).agg(F.min(name).alias("_first"))
    firsts = firsts.select(*(F.col(b).alias(f"_by_{b}") for b in by), "_first")
    same: Column = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by))
    return placed.join(firsts, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *(f"_by_{b}" for b in by))
