"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: only used where all executors are threads of one process and the session names no folder (tests)
DEFAULT_DIR = "/tmp/checkpoints"
_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors. A local session without one (tests) uses a folder of this machine; on a
    cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or DEFAULT_DIR


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _folders.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_folders.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table: computed once however often they are read, and not again when an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
