"""Recorded messages replayed as a stream."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import scratch
from ..streaming import log

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: messages of a batch at most, so that what a task holds of one key does not grow with the log
PART = 4_000_000
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark: SparkSession, messages: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str, order: tuple[str, ...] = ("ts", "id"), runs: int = 2, alone: int = 0, clock: bool = False) -> DataFrame:
    """Writes the messages to a log in the order given, shows it to a stream part by part (``runs``, or more where these
    would be over ``PART`` messages), and returns what came out of the operator. Each part is a run of its own that goes on from the checkpoint; the last ``alone`` messages are a further
    one. State lives in RocksDB under the shared folder. ``clock`` says that the operator waits for processing time, so
    that a stream would never end by itself."""
    folder = scratch(spark, name)
    schema = StructType([*messages.schema.fields, StructField("at", LongType())])
    end = log.append(messages, f"{folder}/in", list(order), shown=False)
    runs = max(runs, math.ceil((end - alone) / PART))
    # a query copies the settings when it starts; the caller's are put back
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE)
    try:
        for upto in [(end - alone) * k // runs for k in range(1, runs + 1)] + [end] * bool(alone):
            log.show(spark, f"{folder}/in", upto)
            made = operator(log.read_log(spark, f"{folder}/in", schema))
            run = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            run = run.trigger(**({"once": True} if clock else {"availableNow": True})).start()
            run.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(made.schema).parquet(f"{folder}/out")
