"""A message log and the streaming source that reads it by offset.

A log is a folder of segments of ``size`` messages as Parquet, each message with its offset ``at``, and of markers that
name the offsets up to which the log is complete. A segment is written by one task and read as one partition, so a batch
reads as many segments in parallel as it covers; nothing is seen before its marker is there, and the same offsets always
give the same messages, so a stream goes on from its checkpoint without loss or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.order import numbered

SIZE = 100_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def end_of(path: str) -> int:
    """Number of messages that are complete."""
    files, folder = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{folder}/ends", allow_not_found=True))
    return max((int(f.base_name) for f in found if f.base_name.isdigit()), default=0)


def append(messages: DataFrame, path: str, order: list[str], size: int = SIZE, shown: bool = True) -> int:
    """Adds messages in their order after those that are there; gives the new end. One writer at a time. What a writer
    left behind that failed before its marker is overwritten. ``shown`` is False where the caller sets the markers."""
    spark, start = messages.sparkSession, end_of(path)
    placed = numbered(messages, [], order, "at").withColumn("at", F.col("at") + start)
    placed = placed.withColumns({"segment": F.floor(F.col("at") / size), "first": F.lit(start)})
    placed.repartition("segment").sortWithinPartitions("segment", "at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("first", "segment").parquet(f"{path}/log")
    end = start + spark.read.parquet(f"{path}/log").filter(F.col("first") == start).count()
    if shown:
        show(spark, path, end)
    return end


def show(spark: SparkSession, path: str, end: int) -> None:
    """Marks the messages before ``end`` as complete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ends/{end}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True).close()


class Span(InputPartition):
    """Messages from ``low`` to before ``high`` of one file."""

    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class LogReader(DataSourceStreamReader):
    """Option: path. A batch takes all messages that are complete."""

    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names = options["path"], names

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": end_of(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        files, folder = _open(self.path)
        found = files.get_file_info(fs.FileSelector(f"{folder}/log", recursive=True, allow_not_found=True))
        spans = []
        for f in sorted(x.path for x in found if x.path.endswith(".parquet")):
            meta = pq.read_metadata(f, filesystem=files)
            column = meta.schema.names.index("at")
            groups = [meta.row_group(k).column(column).statistics for k in range(meta.num_row_groups)]
            low, high = max(start["at"], min(g.min for g in groups)), min(end["at"], max(g.max for g in groups) + 1)
            if low < high:
                spans.append(Span(f, low, high))
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        file = pq.ParquetFile(partition.file, filesystem=files)
        for batch in file.iter_batches(columns=self.names if "at" in self.names else [*self.names, "at"]):
            at = batch.column(batch.schema.get_field_index("at")).to_numpy()
            kept = batch.filter(pa.array((at >= partition.low) & (at < partition.high)))
            if kept.num_rows:
                yield kept.select(self.names)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options), schema.names)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log as a stream; ``schema`` may add ``at``, the offset."""
    try:
        spark.dataSource.register(MessageLog)
    except AnalysisException as e:  # the session this one was made of has it
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
    return spark.readStream.format("message_log").schema(schema).option("path", path).load()
