"""The driver's tables as episodes: events of a user are an episode of scalar frames, embeddings of a label one of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "value", "event_type", "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "vec_id", F.col("embedding").alias("e"))


def e(k: int, of: str = "e") -> Column:
    return F.col(of)[k].cast("double")


def r6(c: Column) -> Column:
    """Six digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


FRAMES = "frames AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type, ts, event_id, epoch_us(ts) / 1e6 AS seconds FROM events)"
VECTORS = "vectors AS (SELECT label AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def r6s(x: str) -> str:
    return f"round({x}, 6) + 0.0"
