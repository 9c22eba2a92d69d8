"""Queries of training and evaluation runs: unions of token streams, metrics over ranks, dispatch, workers and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluation, metrics, sampling, sequences
from ..streaming import broker
from .reference import _PAIR, _QUEUE, _SPEED, _long, _messages
from .registry import query
from .standins import VECTORS, e, frames, r6, r6s, table, vectors
from .streams import replay


# --- unions --------------------------------------------------------------------------------------------------------
_TOKENS = f"""{VECTORS}, v AS (SELECT vec_id, 'video' AS kind, unnest(range(8)) AS k, unnest(e[1:8]) AS x FROM vectors), a AS (SELECT vec_id, 'action' AS kind, unnest(range(4)) AS k, unnest(e[9:12]) AS x FROM vectors),
p AS (SELECT vec_id, 'state' AS kind, unnest(range(2)) AS k, unnest(e[13:14]) AS x FROM vectors)"""


def _streams(spark, d):
    rows = vectors(spark, d)
    return {kind: rows.select("vec_id", F.posexplode(F.slice("e", at, n).cast("array<double>")).alias("k", "x")) for kind, at, n in (("video", 1, 8), ("action", 9, 4), ("state", 13, 2))}


@query(f"WITH {_TOKENS}, u AS (SELECT *, k AS position FROM v UNION ALL SELECT *, k + 8 FROM a UNION ALL SELECT *, k + 12 FROM p) SELECT vec_id, kind, CAST(position AS INTEGER) AS position, {r6s('x')} AS x FROM u")
def token_stream(spark, d):
    """Tokens of three kinds as one sequence for each sample."""
    joined = sequences.joined(_streams(spark, d), {"video": 8, "action": 4, "state": 2}, "k")
    return joined.select("vec_id", "kind", "position", r6(F.col("x")).alias("x"))


@query(f"WITH {_TOKENS} SELECT vec_id, CAST(k AS INTEGER) AS k, {r6s('x')} AS x FROM a")
def token_split(spark, d):
    """The actions of the joined sequence, by its lengths alone."""
    lengths = {"video": 8, "action": 4, "state": 2}
    joined = sequences.joined(_streams(spark, d), lengths, "k").drop("kind")
    return sequences.split(joined, lengths, "k")["action"].select("vec_id", "k", r6(F.col("x")).alias("x"))


@query(f"""WITH {_PAIR}, g AS (SELECT vec_id, i, CAST(s AS VARCHAR) AS source, s AS band, p + s * 0.125 AS v FROM lg, (VALUES (0), (3), (7)) w(s)), u AS (SELECT vec_id, i, source, CASE band WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS band, v FROM g UNION ALL SELECT vec_id, i, 'truth', 3, t FROM lg)
SELECT vec_id, source, CAST(band * 8 + i // 8 AS INTEGER) AS "row", CAST(i % 8 AS INTEGER) AS "column", {r6s('least(greatest((v + 1) * 127.5, 0), 255)')} AS pixel FROM u""")
def prediction_stack(spark, d):
    """Predictions of three guidance values and the truth, one above another."""
    rows = _long(spark, d)
    parts = {str(g): rows.select("vec_id", "i", (F.col("p") + g * 0.125).alias("v")) for g in (0, 3, 7)} | {"truth": rows.select("vec_id", "i", F.col("t").alias("v"))}
    stacked = sequences.stacked(parts, F.floor(F.col("i") / 8), 8)
    pixel = F.least(F.greatest((F.col("v") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))
    return stacked.select("vec_id", "source", F.col("row").cast("int").alias("row"), (F.col("i") % 8).alias("column"), r6(pixel).alias("pixel"))


@query("SELECT lang AS part, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT role, count(*) FROM conversations GROUP BY 1")
def buffer_union(spark, d):
    """Buffers of several files as one bag; repeated rows stay."""
    both = sequences.bag([table(spark, d, "documents").select(F.col("lang").alias("part")), table(spark, d, "conversations").select(F.col("role").alias("part"))])
    return both.groupBy("part").agg(F.count("*").alias("n"))


# --- metrics -------------------------------------------------------------------------------------------------------
@query(f"WITH {_PAIR}, m AS (SELECT episode, avg(pow(p - t, 2)) AS v FROM lg GROUP BY 1) SELECT {r6s('avg(v)')} AS mse FROM m")
def metric_mean(spark, d):
    """Mean over ranks (episodes) of a metric of each."""
    return metrics.mean_over_ranks(_long(spark, d).groupBy("episode").agg(metrics.mse(F.col("p"), F.col("t")).alias("mse")), "mse").select(r6(F.col("mse")).alias("mse"))


@query(f"""WITH {_PAIR}, m AS (SELECT *, i // 8 AS ti, CASE WHEN vec_id % 5 = 0 AND i // 8 = 3 THEN 0 WHEN (vec_id + i) % 3 = 0 THEN 0 ELSE 1 END AS m FROM lg), s AS (SELECT vec_id, ti, max(m) AS has FROM m GROUP BY 1, 2), v AS (SELECT vec_id FROM s GROUP BY 1 HAVING min(has) = 1),
f AS (SELECT vec_id, i % 8 AS c, k, sum((p - t) * cos(2 * pi() * (i // 8) * k / 8)) AS a, sum(-(p - t) * sin(2 * pi() * (i // 8) * k / 8)) AS b FROM m SEMI JOIN v USING (vec_id), range(5) r(k) GROUP BY 1, 2, 3) SELECT {r6s('avg(sqrt(a * a + b * b))')} AS freq_loss FROM f""")
def freq_loss_valid(spark, d):
    """Frequency loss over samples of which every step has some valid number."""
    rows = _long(spark, d).select("vec_id", "i", (F.col("i") % 8).alias("c"), F.floor(F.col("i") / 8).alias("time"), "p", "t")
    m = F.when((F.col("vec_id") % 5 == 0) & (F.col("time") == 3), 0).when((F.col("vec_id") + F.col("i")) % 3 == 0, 0).otherwise(1)
    valid = metrics.fully_valid(rows, ["vec_id"], "time", m)
    return metrics.frequency_loss(rows, ["vec_id", "c"], "time", F.col("p"), F.col("t"), 8, valid, ["vec_id"]).select(r6(F.col("freq_loss")).alias("freq_loss"))


@query("""WITH h AS (SELECT doc_id, md5(concat_ws('_', '7', doc_id)) AS o FROM documents), b AS (SELECT doc_id, (row_number() OVER (ORDER BY o, doc_id) - 1) // 16 AS batch FROM h)
SELECT doc_id, CAST(batch AS BIGINT) AS batch FROM b WHERE batch < 5""")
def validation_batches(spark, d):
    batches = sampling.shuffle_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 16, 7, drop_last=False)
    return evaluation.first_batches(batches, 5).select("doc_id", "batch")


# --- dispatch ------------------------------------------------------------------------------------------------------
_RANKED = f"{_QUEUE}, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, id) AS k FROM ev WHERE event_type = 'click'), w AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, id) AS k FROM ev WHERE event_type = 'view')"


@query(f"WITH {_RANKED} SELECT r.id AS request_id, round(greatest(r.ts, w.ts) - w.ts, 3) + 0.0 AS idle, round(greatest(r.ts, w.ts) - r.ts, 3) + 0.0 AS waited FROM r JOIN w ON w.queue = r.queue AND w.k = r.k")
def broker_waiting(spark, d):
    m = _messages(spark, d)
    pairs = evaluation.waiting(evaluation.dispatch(m.filter("kind = 'request'"), m.filter("kind = 'ready'"))).filter("worker_id is not null")
    return pairs.select("request_id", (F.round("idle", 3) + F.lit(0.0)).alias("idle"), (F.round("waited", 3) + F.lit(0.0)).alias("waited"))


@query(f"WITH {_RANKED} SELECT CAST(r.queue AS VARCHAR) AS queue, r.id AS request_id, w.id AS worker_id, r.ts AS request_ts, w.ts AS ready_ts, greatest(r.ts, w.ts) AS dispatch_ts FROM r JOIN w ON w.queue = r.queue AND w.k = r.k")
def broker_stream(spark, d):
    """The pairs of requests and workers by the stateful stream, from a message log read by offset."""
    return replay(spark, _messages(spark, d), broker.dispatch_stream, "pairs")


@query(f"WITH {_RANKED} SELECT CAST(r.queue AS VARCHAR) AS queue, r.id AS request_id, w.id AS worker_id FROM r JOIN w ON w.queue = r.queue AND w.k = r.k")
def broker_late(spark, d):
    """The same pairs where the messages arrive in a random order: they wait for the watermark."""
    rows = _messages(spark, d).withColumn("arrival", F.md5(F.col("id").cast("string")))
    last = rows.agg(F.max("ts"), F.min("ts")).first()
    delay = int(last[0] - last[1]) + 60  # the messages of all days come at once
    # the first mark moves the watermark behind all messages, the second one starts the batch that sees it
    marks = spark.createDataFrame([(0, "end", -k, float(last[0] + delay + k), "z" * k) for k in (1, 2)], "queue long, kind string, id long, ts double, arrival string")
    out = replay(spark, rows.unionByName(marks), lambda m: broker.dispatch_late(m, delay), "late", ("arrival", "id"), alone=1)
    return out.select("queue", "request_id", "worker_id")


_SERVED = """m AS (SELECT user_id % 16 AS client, event_id AS id, ts, value, event_type = 'purchase' AS setup FROM events),
s AS (SELECT *, max(CASE WHEN setup THEN [epoch_us(ts), id] END) OVER (PARTITION BY client ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS last FROM m),
o AS (SELECT client, id, ts, value, last[2] AS from_, row_number() OVER (PARTITION BY client ORDER BY ts, id) AS ordinal FROM s WHERE NOT setup),
b AS (SELECT *, [-1.0 - from_ % 3, -1.0 - from_ % 2] AS low, [2.0 + from_ % 5, 3.0 + from_ % 4] AS high FROM o),
z AS (SELECT *, 2 * (value - low[1]) / (high[1] - low[1]) - 1 AS x, 2 * (value / 2 - low[2]) / (high[2] - low[2]) - 1 AS y FROM b)"""


@query(f"""WITH {_SERVED} SELECT CAST(client AS VARCHAR) AS client, ordinal, id AS request_id,
  CASE WHEN from_ IS NOT NULL THEN {r6s('(0.4871317173137 * x + 0.2313193931937 * y + 1) / 2 * (high[1] - low[1]) + low[1]')} END AS a, CASE WHEN from_ IS NOT NULL THEN {r6s('(0.9173317331713 * x - 0.7717131913173 * y + 1) / 2 * (high[2] - low[2]) + low[2]')} END AS b FROM z""")
def worker_stream(spark, d):
    """Requests answered by a server that keeps each client's statistics: purchases bring new ones, all else observations."""
    k, setup = F.col("event_id"), F.col("event_type") == "purchase"
    pair = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    rows = table(spark, d, "events").select(
        (F.col("user_id") % 16).alias("client"), F.when(setup, "setup").otherwise("observe").alias("kind"), k.alias("id"), "ts", F.when(~setup, pair(F.col("value"), F.col("value") / 2)).alias("state"),
        F.when(setup, pair(-1 - k % 3, -1 - k % 2)).alias("q01"), F.when(setup, pair(2 + k % 5, 3 + k % 4)).alias("q99"),
    )
    out = replay(spark, rows, lambda m: broker.serve(m, _linear), "served")
    return out.select("client", "ordinal", "request_id", *(r6(F.get("action", F.lit(j))).alias(n) for j, n in enumerate("ab")))


def _linear(states):
    return np.stack([0.4871317173137 * states[:, 0] + 0.2313193931937 * states[:, 1], 0.9173317331713 * states[:, 0] - 0.7717131913173 * states[:, 1]], axis=1)


@query("""WITH r AS (SELECT user_id % 20 AS run, event_id % 16 AS rank FROM events WHERE event_type = 'purchase'), n AS (SELECT run, count(DISTINCT rank) AS n FROM r GROUP BY 1)
SELECT CAST(run AS VARCHAR) AS run, CAST(5 AS BIGINT) AS ranks, true AS complete FROM n WHERE n >= 5""")
def completion_stream(spark, d):
    """One row for each run, at its fifth distinct rank, however often ranks report."""
    rows = table(spark, d, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 20).alias("run"), (F.col("event_id") % 16).alias("rank"), "ts", F.col("event_id").alias("id"))
    return replay(spark, rows, lambda m: broker.completed_stream(m, 5), "done", clock=True)


@query("""WITH q AS (SELECT user_id AS client_id, event_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'),
a AS (SELECT user_id AS client_id, event_id AS result_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase') SELECT q.client_id, q.request_id, a.result_id FROM q LEFT JOIN a USING (client_id, k)""")
def broker_replies(spark, d):
    """Each client's k-th result answers its k-th request."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("client_id"), "event_id", "event_type", "ts")
    asked = broker.numbered(rows.filter("event_type = 'click'").withColumnRenamed("event_id", "request_id"), "client_id", ["ts", "request_id"])
    given = broker.numbered(rows.filter("event_type = 'purchase'").withColumnRenamed("event_id", "result_id"), "client_id", ["ts", "result_id"])
    return broker.replies(given.select("client_id", "ordinal", "result_id"), asked.select("client_id", "ordinal", "request_id")).select("client_id", "request_id", "result_id")


@query(f"WITH {VECTORS} SELECT vec_id, {r6s('2 * e[1] + e[2]')} AS prediction FROM vectors")
def worker_loop(spark, d):
    """Requests answered by a predictor that is registered by name."""
    broker.register("double", _double, "vec_id long, prediction double")
    return broker.run_named(vectors(spark, d).select("vec_id", e(0).alias("a"), e(1).alias("b")), "double").select("vec_id", r6(F.col("prediction")).alias("prediction"))


def _double(batch):
    return batch.assign(prediction=2 * batch["a"] + batch["b"])[["vec_id", "prediction"]]


@query("SELECT count(DISTINCT user_id % 16) AS ranks, count(DISTINCT user_id % 16) >= 16 AS complete FROM events WHERE event_type = 'purchase'")
def completion(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 16).alias("rank"))
    return broker.completed(rows, 16)


@query(f"WITH {_SPEED} SELECT episode, frame, {r6s('speed')} AS speed FROM s")
def speed_stream(spark, d):
    """Speeds over the last ten entries of each run, as a stateful stream."""
    rows = frames(spark, d).filter("frame > 0").select(F.col("episode").alias("run"), F.col("frame").alias("step"), F.col("seconds").alias("ts"))
    out = replay(spark, rows, broker.speed_stream, "speeds", ("ts", "run", "step"))
    return out.select(F.col("run").cast("long").alias("episode"), F.col("step").alias("frame"), r6(F.col("speed")).alias("speed"))
