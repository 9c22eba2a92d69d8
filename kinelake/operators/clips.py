"""Fixed-length training clips over episodes: counts, expansion, flat ids, frame ids and gathers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span(sequence_length: int, frame_skip: int) -> int:
    if sequence_length < 1 or frame_skip < 1:
        raise ValueError("sequence_length and frame_skip must be positive")
    return (sequence_length - 1) * frame_skip


def clip_counts(metadata: DataFrame, sequence_length: int, frame_skip: int) -> DataFrame:
    """Episodes with at least one clip: num_frames - span of them."""
    return metadata.withColumn("clips", F.col("num_frames") - span(sequence_length, frame_skip)).filter("clips > 0")


def expand(counts: DataFrame) -> DataFrame:
    """One row for each clip: (episode, start). Generated lazily, no shuffle."""
    return counts.select("episode", F.explode(F.sequence(F.lit(0).cast("long"), F.col("clips") - 1)).alias("start"))


def prefix_sums(counts: DataFrame, parts: int = 64) -> DataFrame:
    """(episode, clips, prev, cum) in key order. The running sum is taken inside ranges of keys and then over the sums
    of the ranges, so no task sees more than one range of episodes."""
    spark = counts.sparkSession
    ranged = counts.repartitionByRange(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "episode").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("episode").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("own", F.sum("clips").over(inside))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").agg(F.sum("clips").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    placed = own.join(F.broadcast(base.select("part", "base")), "part")  # one row for each range: at most ``parts``
    return placed.select("episode", "clips", (F.col("base") + F.col("own") - F.col("clips")).alias("prev"), (F.col("base") + F.col("own")).alias("cum"))


def lookup(ids: DataFrame, sums: DataFrame, width: int = 4096, strict: bool = False) -> DataFrame:
    """Episode and start of flat clip ids (column ``id``; negative ones count from the end). Bins of ``width`` ids turn
    the range join into an equi-join on the bin, checked exactly. Ids out of range are dropped, or an error if strict."""
    total = sums.agg(F.max("cum").alias("n"))
    at = ids.crossJoin(F.broadcast(total)).withColumn("flat", F.when(F.col("id") < 0, F.col("id") + F.col("n")).otherwise(F.col("id")))  # one row
    inside = (F.col("flat") >= 0) & (F.col("flat") < F.col("n"))
    at = at.withColumn("flat", F.when(inside, F.col("flat")).otherwise(F.raise_error(F.lit("clip id out of range")))) if strict else at.filter(inside)
    at = at.withColumn("bin", F.floor(F.col("flat") / width))
    ranges = sums.select("episode", "prev", "cum", F.explode(F.sequence(F.floor(F.col("prev") / width), F.floor((F.col("cum") - 1) / width))).alias("bin"))
    return at.join(ranges, "bin").filter("flat >= prev and flat < cum").select("id", "episode", (F.col("flat") - F.col("prev")).alias("start"))


def frame_ids(start: Column, sequence_length: int, frame_skip: int) -> Column:
    return F.sequence(start, start + (sequence_length - 1) * frame_skip, F.lit(frame_skip).cast("long"))


def action_ids(start: Column, sequence_length: int, frame_skip: int, action_skip: int) -> Column:
    """The last frame of each block of action_skip."""
    return F.sequence(start + action_skip - 1, start + span(sequence_length, frame_skip) - 1, F.lit(action_skip).cast("long"))


def raw_action_ids(start: Column, sequence_length: int, frame_skip: int) -> Column:
    return F.sequence(start, start + span(sequence_length, frame_skip) - 1)


def gather_frames(clips: DataFrame, frames: DataFrame, sequence_length: int, frame_skip: int) -> DataFrame:
    """(episode, start, k, frame, columns of frames): long-form gather, an equi-join on (episode, frame)."""
    wanted = clips.select("episode", "start", F.posexplode(frame_ids(F.col("start"), sequence_length, frame_skip)).alias("k", "frame"))
    return wanted.join(frames, ["episode", "frame"])
