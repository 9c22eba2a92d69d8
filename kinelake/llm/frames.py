"""Spark helpers of the corpus operators: shared work folder, written intermediate tables, document ranges."""

from __future__ import annotations

import atexit
import math
import re
import uuid
import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: only used where all executors are threads of one process and the session names no folder (tests)
DEFAULT_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of this machine serves
    a local session; a cluster would not find files there, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = DEFAULT_DIR
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: folders of the written tables that are still there, and those behind a table
_folders: dict[str, SparkSession] = {}
_behind: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _folders.items():
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - the session may be gone at exit
            return


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[path], _behind[table] = spark, path
    return table


def release(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        path = _behind.pop(table, None)
        if path:
            remove(_folders.pop(path), path)


def placed(docs: DataFrame, file: str = "file_key", at: str = "row_at") -> DataFrame:
    """The rows with two numbers that tell them apart: the hashed name of the file that a row is read from, and its
    place there. They are the same at every read; a table that is not read from Parquet files is written first."""
    try:
        place = docs.metadataColumn("_metadata")
        found = docs.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(at))
    except AnalysisException:
        docs = written(docs)
        place = docs.metadataColumn("_metadata")
        found = docs.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(at))
    return found


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def range_count(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))


def _keys(values: list[tuple[int, int, int]]) -> str:
    return f"array({','.join(f"named_struct('a',{a},'b',{b}L,'c',{c}L)" for a, b, c in values)})".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")


def range_of(key: str, bounds: list[tuple[int, int, int]]):
    """Column: how many of the ascending bounds are at or below the key, a struct of three numbers. Two levels of search,
    so the cost is about twice the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    top = f"size(filter({_keys([g[0] for g in groups])}, b -> b <= {key}))"
    own = f"size(filter(element_at(array({','.join(map(_keys, groups))}), {top}), b -> b <= {key}))"
    return F.expr(f"CASE WHEN {key} < element_at({_keys(bounds[:1])}, 1) THEN 0 ELSE ({top} - 1) * {step} + {own} END")


def at_bound(key: str, bounds: list[tuple[int, int, int]], block):
    """Column: whether the key is the bound that its block begins with."""
    return (block > 0) & (F.col(key) == F.element_at(F.expr(_keys(bounds)), F.greatest(block, F.lit(1)))) if bounds else F.lit(False)
