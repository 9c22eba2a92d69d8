"""Sinks: metadata, statistics and result files in the formats that the sources read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def metadata_json(metadata: DataFrame) -> DataFrame:
    """One row, one JSON object with sorted keys, indented by two. The file is one document by format, so one task
    renders it; keep metadata as Parquet where it is large."""
    entries = F.array_sort(F.collect_list(F.struct("episode", "num_frames")))
    lines = F.transform(entries, lambda x: F.concat(F.lit("  "), _quoted(x["episode"].cast("string")), F.lit(": "), x["num_frames"].cast("string")))
    return metadata.agg(lines.alias("l")).select(F.when(F.size("l") == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join("l", ",\n"), F.lit("\n}"))).alias("value"))


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata_json(metadata).coalesce(1).write.mode("overwrite").text(path)


def statistics_json(stats: DataFrame) -> DataFrame:
    """One row {q01: {key: [...]}, q99: {key: [...]}} of a small (key, axis, q01, q99) table."""
    lists = stats.groupBy("key").agg(*(F.transform(F.array_sort(F.collect_list(F.struct("axis", q))), lambda s, q=q: s).alias(q) for q in ("q01", "q99")))
    low, high = (F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("key"), F.expr(f"transform({q}, s -> s.{q})"))))) for q in ("q01", "q99"))
    return lists.agg(F.to_json(F.struct(low.alias("q01"), high.alias("q99"))).alias("value"))


def statistics_yaml(stats: DataFrame) -> DataFrame:
    """One row: the same table as a block of q01 and q99, each a list of numbers for every key."""
    one = lambda q: F.concat(F.lit("  "), F.col("key"), F.lit(":\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("axis", q))), lambda s: F.concat(F.lit("  - "), s[q].cast("string"))), "\n"))
    lists = stats.groupBy("key").agg(*(one(q).alias(q) for q in ("q01", "q99")))
    block = lambda q: F.concat(F.lit(f"{q}:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", q))), lambda s: s[q]), "\n"))
    return lists.agg(F.concat(block("q01"), F.lit("\n"), block("q99"), F.lit("\n")).alias("value"))


def write_statistics(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(f"{path}/parquet")
    statistics_json(stats).coalesce(1).write.mode("overwrite").text(f"{path}/json")
    statistics_yaml(stats).coalesce(1).write.mode("overwrite").text(f"{path}/yaml")


def summary_json(rollup: DataFrame) -> DataFrame:
    """One row with a JSON object by task, __overall__ among them; no row for no task."""
    entries = F.array_sort(F.collect_list(F.struct("task", F.struct("num_success_rollouts", "num_rollouts", "success_rate"))))
    return rollup.agg(F.count("*").alias("n"), F.to_json(F.map_from_entries(entries)).alias("value")).filter("n > 1").select("value")


def write_rank_results(rows: DataFrame, path: str) -> None:
    """Rows (rank, task, num_success_rollouts, num_rollouts, success_rate) as one document by rank, one folder each."""
    entry = F.struct("task", F.struct("num_success_rollouts", "num_rollouts", "success_rate"))
    by = rows.groupBy("rank").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    by.write.mode("overwrite").partitionBy("rank").text(path)


def result_text(rates: DataFrame, stamp: str) -> DataFrame:
    """(task, value): the text of a task's result file, its rate in the last line."""
    return rates.select("task", F.format_string(f"Timestamp: {stamp}\n\n%s", F.col("success_rate").cast("string")).alias("value"))


def write_result_texts(rates: DataFrame, folder: str, stamp: str) -> None:
    """<task>/_result.txt for every task. Spark's writers cannot give a file a name; there is one short text for each
    task, so they go through the file system that the path names."""
    put_texts(rates.sparkSession, folder, [(f"{r['task']}/_result.txt", r["value"]) for r in result_text(rates, stamp).collect()])


def put_texts(spark: SparkSession, folder: str, texts: list[tuple[str, str]]) -> None:
    """A few small named files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in texts:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
