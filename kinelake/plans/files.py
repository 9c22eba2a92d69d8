"""Queries of sources and sinks: events of a user become an episode document, lines of orders results of ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import config, episodes, sinks
from ..sources.episodes import EpisodeSource, StatisticsSource
from .reference import _META, _meta
from .registry import query
from .standins import FRAMES, frames, r6, r6s, table
from ..sources.tables import shared_folder
from .wholes import BLOCK

ROOT = "/made/up/root"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _documents(spark, d, nested=False):
    """(path, value) of the episode of each user. Of seven users one has no number of frames, and of three one has it
    behind a long text; every fifth file has a name that the pattern of datasets leaves out."""
    rows = frames(spark, d).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("v"))
    k, values = F.col("episode"), F.transform("v", lambda x: F.array(x["value"], x["value"] * 2, x["frame"].cast("double")))
    n = F.concat(F.lit('"num_frames" :  '), F.size("v").cast("string"), F.lit(", "))
    n = F.when(k % 7 == 0, "").when(k % 3 == 0, F.concat(F.lit(f'"instructions": ["{"x" * episodes.PEEK}"], '), n)).otherwise(n)
    value = F.concat(F.lit("{"), n, F.lit('"proprios": '), F.to_json(F.create_map(F.lit("left_ee_pos"), values)), F.lit(', "actions": {}}'))
    name = F.concat(F.lit("chunk-"), F.lpad(F.floor(k / 100).cast("string"), 3, "0"), F.lit("/"), F.when(k % 5 == 0, "take_").otherwise("episode_"), F.lpad(k.cast("string"), 7, "0"), F.lit(".json"))
    head = F.concat(F.lit(f"{ROOT}/sub"), (k % 2).cast("string"), F.lit("/data/")) if nested else F.lit(f"{ROOT}/data/")
    return rows.select(F.concat(head, name).alias("path"), value.alias("value"))


_NAME = "'chunk-' || lpad(CAST(episode // 100 AS VARCHAR), 3, '0') || '/' || CASE WHEN episode % 5 = 0 THEN 'take_' ELSE 'episode_' END || lpad(CAST(episode AS VARCHAR), 7, '0')"


@query(f"WITH {_META} SELECT {_NAME} AS episode, CAST(num_frames AS INTEGER) AS num_frames FROM meta WHERE episode % 5 <> 0 AND episode % 7 <> 0")
def source_frame_counts(spark, d):
    """Files of a dataset, their keys, and their numbers of frames from the head or from the whole document."""
    return EpisodeSource(spark, ROOT, strict=False, documents=_documents(spark, d)).frame_counts()


@query(f"WITH {_META} SELECT 'sub' || (episode % 2) || '/' || {_NAME} AS episode, CAST(num_frames AS INTEGER) AS num_frames FROM meta WHERE episode % 7 <> 0")
def source_nested(spark, d):
    """The statistics job's files of several sub-datasets under one root, which it finds out by itself."""
    return StatisticsSource(spark, ROOT, documents=_documents(spark, d, nested=True)).frame_counts()


@query(f"WITH {_META} SELECT {_NAME} AS episode, CAST(num_frames AS INTEGER) AS num_frames FROM meta WHERE episode % 7 <> 0")
def source_metadata(spark, d):
    """Metadata that is missing at first, so it is built and written, and then read from its file."""
    source, path = StatisticsSource(spark, ROOT, documents=_documents(spark, d)), _folder(spark, "metadata")
    source.metadata(path)
    return StatisticsSource(spark, ROOT, documents=_documents(spark, d).limit(0)).metadata(path)


@query(f"WITH {FRAMES}, {_META} SELECT {_NAME} AS episode, frame, {r6s('value')} AS x, {r6s('2 * value')} AS y FROM frames WHERE episode % 5 <> 0 AND episode % 4 = 1")
def source_payloads(spark, d):
    """Whole documents of the wanted keys; one that is missing would be an error."""
    source = EpisodeSource(spark, ROOT, documents=_documents(spark, d))
    wanted = _documents(spark, d).filter("path like '%episode_%'").select(source.key(F.col("path")).alias("episode")).filter("cast(right(episode, 7) as int) % 4 = 1")
    rows = source.payloads(wanted).select("episode", F.posexplode(F.col("proprios")["left_ee_pos"]).alias("frame", "v"))
    return rows.select("episode", F.col("frame").cast("long").alias("frame"), r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '/made/up/root/' || p_name ELSE p_name END AS path FROM part), w AS (SELECT DISTINCT CASE WHEN path LIKE '/%' THEN path ELSE '/made/up/root/' || path END AS path FROM p),
h AS (SELECT '/made/up/root/' || p_name AS path FROM part WHERE p_partkey % 3 = 0) SELECT path FROM w WHERE path NOT IN (SELECT path FROM h)""")
def missing_media(spark, d):
    """Media paths, absolute or below the root, that a listing of the files lacks."""
    part = table(spark, d, "part")
    wanted = part.select(episodes.media_path(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(f"{ROOT}/"), "p_name")).otherwise(F.col("p_name")), ROOT).alias("path")).distinct()
    listing = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit(f"file:{ROOT}/"), "p_name").alias("path"))
    return episodes.missing_media(wanted, listing)


_ROWS = [(key, axis, v, BLOCK["q99"][key][axis]) for key, values in BLOCK["q01"].items() for axis, v in enumerate(values)]


@query(f"SELECT key, axis, CAST(q01 AS DOUBLE) AS q01, CAST(q99 AS DOUBLE) AS q99 FROM (VALUES {', '.join(map(str, _ROWS))}) v(key, axis, q01, q99)")
def statistics_block(spark, d):
    """A block of statistics as rows, each key checked against its other half."""
    schema = "q01 map<string,array<double>>, q99 map<string,array<double>>"
    return episodes.statistics_rows(spark.createDataFrame([(BLOCK["q01"], BLOCK["q99"])], schema))


CONFIG = """
# training
model: {size}
seed: 42
data:
  frame_skip: 4
  size: [256, 320]
  paths:
  - one
  - two
sampling:
  clean_ratio: 0.5
  joint: true
""".replace("{size}", "'5b'")


@query("""SELECT * FROM (VALUES ('data.frame_skip', '8'), ('data.paths', '["one", "two"]'), ('data.size', '[256, 320]'), ('model', '"5b"'), ('run.name', '"first"'), ('sampling.clean_ratio', '0.25'), ('sampling.joint', 'true'), ('seed', '42')) v(path, value)""")
def config_overrides(spark, d):
    """A configuration with overrides of the command line, after its snapshot was written and read."""
    folder = _folder(spark, "run")
    config.snapshot(spark, config.merged(config.parse(CONFIG), config.dotted(["data.frame_skip=8", "sampling.clean_ratio=0.25", "run.name=first"])), folder)
    return config.leaves(spark, config.load(spark, f"{folder}/config.json"))


# --- sinks -----------------------------------------------------------------------------------------------------------
@query(f"""WITH {_META}, k AS (SELECT CAST(episode AS VARCHAR) AS episode, num_frames FROM meta)
SELECT '{{' || chr(10) || string_agg('  "' || episode || '": ' || num_frames, ',' || chr(10) ORDER BY episode) || chr(10) || '}}' AS value FROM k""")
def sink_metadata(spark, d):
    return sinks.metadata_json(_meta(spark, d).withColumn("episode", F.col("episode").cast("string")))


@query(f"""WITH v AS (SELECT * FROM (VALUES {', '.join(map(str, _ROWS))}) v(key, axis, q01, q99)), k AS (SELECT key, string_agg('  - ' || printf('%.4f', q01), chr(10) ORDER BY axis) AS a, string_agg('  - ' || printf('%.4f', q99), chr(10) ORDER BY axis) AS b FROM v GROUP BY 1)
SELECT 'q01:' || chr(10) || string_agg('  ' || key || ':' || chr(10) || a, chr(10) ORDER BY key) || chr(10) || 'q99:' || chr(10) || string_agg('  ' || key || ':' || chr(10) || b, chr(10) ORDER BY key) || chr(10) AS value FROM k""")
def sink_statistics(spark, d):
    rows = spark.createDataFrame(_ROWS, "key string, axis int, q01 double, q99 double")
    return sinks.statistics_yaml(rows.select("key", "axis", *(F.format_string("%.4f", q).alias(q) for q in ("q01", "q99"))))


_RESULTS = """r AS (SELECT l_suppkey % 4 AS rank, l_shipmode_ AS task, CAST(count(*) FILTER (l_linestatus = 'F') AS INTEGER) AS s, CAST(count(*) AS INTEGER) AS n FROM (SELECT *, 'task' || (l_linenumber % 5) AS l_shipmode_ FROM lineitem) GROUP BY 1, 2)"""


def _rank_rows(spark, d):
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("rank"), F.concat(F.lit("task"), (F.col("l_linenumber") % 5).cast("string")).alias("task"))
    counted = rows.agg(F.count_if(F.col("l_linestatus") == "F").cast("int").alias("num_success_rollouts"), F.count("*").cast("int").alias("num_rollouts"))
    return counted.withColumn("success_rate", F.bround(F.col("num_success_rollouts") / F.col("num_rollouts"), 4))


@query(f"WITH {_RESULTS} SELECT task, s AS num_success_rollouts, n AS num_rollouts, round_even(s / n, 4) AS success_rate FROM r")
def sink_rank_results(spark, d):
    """Results written by rank and read again from all ranks."""
    folder = _folder(spark, "results")
    sinks.write_rank_results(_rank_rows(spark, d), folder)
    return episodes.rank_results(spark, folder, "*", below=True)


@query(f"""WITH {_RESULTS}, t AS (SELECT task, CAST(sum(s) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1), o AS (SELECT * FROM t UNION ALL SELECT '__overall__', CAST(sum(s) AS BIGINT), CAST(sum(n) AS BIGINT) FROM t)
SELECT task, s AS num_success_rollouts, n AS num_rollouts, round_even(s / n, 4) AS success_rate FROM o""")
def sink_summary(spark, d):
    """The summary document of all tasks, read back."""
    from ..operators import evaluation

    rolled = evaluation.success_rollup(_rank_rows(spark, d), "task", F.col("num_success_rollouts"), F.col("num_rollouts"))
    kind = "map<string, struct<num_success_rollouts: bigint, num_rollouts: bigint, success_rate: double>>"
    return sinks.summary_json(rolled).select(F.explode(F.from_json("value", kind)).alias("task", "r")).select("task", "r.*")


@query(f"WITH {_RESULTS} SELECT task, round_even(sum(s) / sum(n), 4) AS success_rate, 'B' AS layout, 'A' AS other FROM r GROUP BY 1")
def sink_result_texts(spark, d):
    """Result texts by task, written and read again, and the layouts that such a folder and one of results by rank have."""
    folder, other = _folder(spark, "texts"), _folder(spark, "ranks")
    rates = _rank_rows(spark, d).groupBy("task").agg(F.bround(F.sum("num_success_rollouts") / F.sum("num_rollouts"), 4).alias("success_rate"))
    sinks.write_result_texts(rates, folder, "2026-01-01")
    sinks.put_texts(spark, other, [("eval_results_0.json", '{"a": {"num_success_rollouts": 1, "num_rollouts": 2, "success_rate": 0.5}}')])
    found = episodes.text_results(spark, folder)
    return found.withColumns({"layout": F.lit(episodes.result_layout(spark, folder)), "other": F.lit(episodes.result_layout(spark, other))})
