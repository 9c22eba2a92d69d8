"""Whole jobs over episode documents made of the embeddings: pose tracks, statistics, training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rotation as Q
from ..operators import order, samples, statistics, tracks
from ..sources.episodes import StatisticsSource
from ..sources.tables import written
from .reference import _MUL, _STEP, _q
from .registry import query
from .standins import VECTORS, e, r6, r6s, table
from .wholes import _STATE, STATS, _canon, _delta_sql, _raw_sql, _state_sql, _turn_sql

# --- pose tracks -----------------------------------------------------------------------------------------------------
_UNIT = "sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6] + e[7] * e[7])"


@query(f"""WITH RECURSIVE {VECTORS}, s AS (SELECT vec_id, episode, frame, e, {_q('e', 11)} AS q FROM vectors),
w AS (SELECT vec_id, episode, frame, [e[1] + e[8], e[2] + e[9], e[3] + e[10]] AS p, e[20] + e[14] AS g, {_STEP.replace('new[', 'q[').replace('old[1]', f'(e[4] / {_UNIT})').replace('old[2]', f'(e[5] / {_UNIT})').replace('old[3]', f'(e[6] / {_UNIT})').replace('old[4]', f'(e[7] / {_UNIT})')} AS r FROM s WHERE frame = 0
  UNION ALL SELECT s.vec_id, s.episode, s.frame, [w.p[1] + s.e[8], w.p[2] + s.e[9], w.p[3] + s.e[10]], w.g + s.e[14], {_STEP.replace('new[', 's.q[').replace('old[', 'w.r[')} FROM w JOIN s ON s.episode = w.episode AND s.frame = w.frame + 1)
SELECT vec_id, frame, {r6s('p[1]')} AS x, {r6s('p[2]')} AS y, {r6s('p[3]')} AS z, {r6s('g')} AS gripper, {r6s('r[1]')} AS qw, {r6s('r[2]')} AS qx, {r6s('r[3]')} AS qy, {r6s('r[4]')} AS qz FROM w""")
def pose_track(spark, d):
    """Absolute pose at every frame of every episode; frames are numbered and multiplied up without a task for each episode."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("episode"), "vec_id", F.col("embedding").alias("e"))
    steps = order.numbered(rows, ["episode"], ["vec_id"], "frame")
    start = Q.vector(F.col("e")), tuple(e(3 + k) for k in range(4)), e(19)
    poses = tracks.pose_track(steps, ["episode"], "frame", Q.vector(F.col("e"), 7), Q.vector(F.col("e"), 10), e(13), start, width=8)
    named = steps.select("vec_id", "episode", "frame").join(poses, ["episode", "frame"])
    return named.select("vec_id", "frame", *(r6(F.col(c)).alias(c) for c in tracks.POSE))


# --- the statistics job ----------------------------------------------------------------------------------------------
#: frames of an episode, and of a block of actions
LENGTH, SKIP = 25, 4
ROOT = "/made/up/robots"


def _text(*parts):
    """A JSON array of numbers, or of arrays."""
    return F.concat(F.lit("["), F.array_join(F.array(*parts).cast("array<string>"), ","), F.lit("]"))


def _episodes(spark, d):
    """(path, value) of episodes of 25 embeddings. Odd ones have no right arm, every third brings raw actions (of two arms
    where it has them). Positions, grippers and rotations come in all forms that documents have; of eleven documents one
    is broken, and one has no proprios."""
    rows = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / LENGTH).alias("k"), F.col("embedding").cast("array<double>").alias("e"))
    for at in (3, 10, 17, 24):
        rows, q = Q.staged(rows, f"_q{at}", Q.from_rotvec(Q.vector(F.col("e"), at)))
        rows = rows.withColumn(f"m{at}", _text(*(x for row in Q.to_matrix(q) for x in row)))
    k = F.col("k")
    one = {"pos": lambda at: _text(*(e(at + j) for j in range(3))), "grip": lambda at: F.when(k % 2 == 0, e(at).cast("string")).otherwise(_text(e(at)))}
    turn = lambda at: F.when(k % 4 == 1, F.col(f"m{at}")).when(k % 4 == 2, F.concat(F.lit("["), F.regexp_replace(F.substring(F.col(f"m{at}"), F.lit(2), F.length(f"m{at}")), r"(-?[0-9.E-]+,-?[0-9.E-]+,-?[0-9.E-]+)(,?)", "[$1]$2"))).otherwise(one["pos"](at + 0))
    raw = F.when(k % 2 == 0, _text(*(e(29 + j) for j in range(14)))).otherwise(_text(*(e(29 + j) for j in range(7))))
    parts = {"lp": one["pos"](0), "lr": turn(3), "lg": one["grip"](6), "rp": one["pos"](7), "rr": turn(10), "rg": one["grip"](13), "la": one["pos"](14), "lt": turn(17), "ra": one["pos"](21), "rt": turn(24), "raw": raw}
    lists = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("vec_id", *(c.alias(n) for n, c in parts.items())))).alias("s"))
    row = lambda n: F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x[n]), ", "), F.lit("]"))
    flat = lambda n: F.when(k % 5 == 0, F.concat(F.lit("["), F.regexp_replace(F.array_join(F.transform("s", lambda x: x[n]), ","), r"[\[\]]", ""), F.lit("]"))).otherwise(row(n))
    field = lambda name, text: F.concat(F.lit(f'"{name}": '), text)
    two = k % 2 == 0
    proprios = F.concat_ws(", ", field("left_ee_pos", flat("lp")), field("left_ee_rotm", row("lr")), field("left_gripper_pos", row("lg")), F.when(two, F.concat_ws(", ", field("right_ee_pos", flat("rp")), field("right_ee_rotm", row("rr")), field("right_gripper_pos", row("rg")))))
    actions = F.concat_ws(", ", field("left_ee_pos", row("la")), field("left_ee_rotm", row("lt")), F.when(two, F.concat_ws(", ", field("right_ee_pos", row("ra")), field("right_ee_rotm", row("rt")))), F.when(k % 3 == 0, field("raw_actions", row("raw"))))
    cameras = F.concat_ws(", ", F.lit('"wrist": {"type": "dynamic"}'), F.lit('"back": {"type": "static"}'), F.when(two, F.lit('"front": {"type": "static"}')))
    texts = F.concat(F.lit('"instructions": ["  take it ", " ", "put it '), k.cast("string"), F.lit('", "move"]'))
    value = F.concat(F.lit('{"num_frames": '), F.size("s").cast("string"), F.lit(', "observations": {'), cameras, F.lit("}, "), texts, F.when(k % 11 == 10, F.lit("")).otherwise(F.concat(F.lit(', "proprios": {'), proprios, F.lit("}"))), F.lit(', "actions": {'), actions, F.when(k % 11 == 9, F.lit("}")).otherwise(F.lit("}}")))
    named = lists.select(F.concat(F.lit(f"{ROOT}/data/chunk-000/episode_"), F.lpad(k.cast("string"), 7, "0"), F.lit(".json")).alias("path"), value.alias("value"))
    return written(named, "documents")  # stands for the files: what reads them must not plan how they were made


def _pool_sql() -> str:
    """The values of all keys, straight from the embeddings."""
    head = f"f AS (SELECT vec_id // {LENGTH} AS k, vec_id % {LENGTH} AS t, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE (vec_id // {LENGTH}) % 11 < 9),"
    head += f" p AS (SELECT *, lead(e, {SKIP - 1}) OVER w AS later, lead(e, {SKIP}) OVER w AS next FROM f WINDOW w AS (PARTITION BY k ORDER BY t)),"
    parts = []
    for arm, at, when in (("left", 0, "true"), ("right", 7, "k % 2 = 0")):
        head += f""" {arm}_q AS (SELECT k, {_q('later', 18 + at)} AS a, {_q('e', 4 + at)} AS c FROM p WHERE later IS NOT NULL AND k % 3 <> 0 AND {when}), {arm}_b AS (SELECT a, [c[1], -c[2], -c[3], -c[4]] AS b FROM {arm}_q),
{arm}_m AS (SELECT {_MUL} AS q FROM {arm}_b), {arm}_c AS (SELECT CASE WHEN q[1] < 0 THEN list_transform(q, lambda x: -x) ELSE q END AS q FROM {arm}_m), {arm}_n AS (SELECT q, sqrt(q[2]*q[2]+q[3]*q[3]+q[4]*q[4]) AS n FROM {arm}_c),"""
        for j in range(3):
            parts.append(f"SELECT 'proprio_{arm}_ee_xyz', {j}, e[{1 + at + j}] FROM p WHERE {when}")
            parts.append(f"SELECT 'action_{arm}_ee_xyz', {j}, CASE WHEN k % 3 = 0 THEN e[{30 + at + j}] ELSE later[{15 + at + j}] - e[{1 + at + j}] END FROM p WHERE {when}")
            parts.append(f"SELECT 'action_{arm}_ee_axisangle', {j}, e[{33 + at + j}] FROM p WHERE k % 3 = 0 AND {when}")
            parts.append(f"SELECT 'action_{arm}_ee_axisangle', {j}, q[{2 + j}] * CASE WHEN n < 1e-12 THEN 2.0 ELSE 2 * atan2(n, q[1]) / n END FROM {arm}_n")
        parts.append(f"SELECT 'gripper_pos', 0, e[{7 + at}] FROM p WHERE {when}")
        parts.append(f"SELECT 'gripper_action', 0, next[{7 + at}] - e[{7 + at}] FROM p WHERE next IS NOT NULL AND {when}")
    return f"{head} pool(key, axis, value) AS ({' UNION ALL '.join(parts)})"


@query(f"""WITH {_pool_sql()}, one AS (SELECT key, axis, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b, count(*) AS n FROM pool WHERE key <> 'gripper_action' AND value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT a AS low, b AS high FROM one WHERE key = 'gripper_pos'), moved AS (SELECT key, axis, value FROM pool, g WHERE key = 'gripper_action' AND abs(value * 2 / greatest(high - low, 1e-6)) >= 0.3),
q AS (SELECT * FROM one UNION ALL SELECT key, axis, quantile_cont(value, 0.01), quantile_cont(value, 0.99), count(*) FROM moved GROUP BY 1, 2)
SELECT key, CAST(axis AS INTEGER) AS axis, n, {r6s("CASE WHEN key LIKE '%action%' THEN -greatest(abs(a), abs(b)) ELSE a END")} AS q01, {r6s("CASE WHEN key LIKE '%action%' THEN greatest(abs(a), abs(b)) ELSE b END")} AS q99 FROM q""")
def statistics_job(spark, d):
    """All keys and axes from episode documents, both passes over one pool."""
    source = StatisticsSource(spark, ROOT, nested=False, documents=_episodes(spark, d))
    found = statistics.statistics_job(source.parts(), SKIP, 0.3)
    return found.select("key", "axis", "n", r6(F.col("q01")).alias("q01"), r6(F.col("q99")).alias("q99"))


# --- training samples ------------------------------------------------------------------------------------------------
SEQ, FRAME_SKIP, WIDTH = 3, 4, 6
_REACH = (SEQ - 1) * FRAME_SKIP


def _sample_sql() -> str:
    assert _STATE["left"][0] == 0  # the stand-in's layout: left arm first
    two = "k % 2 = 0"
    masked = lambda items: [x if j < len(items) // 2 else f"CASE WHEN {two} THEN {x} ELSE 0.0 END" for j, x in enumerate(items)]
    state = masked([x.replace("left[", '"left"[').replace("right[", '"right"[') for arm in ("left", "right") for x in _state_sql(arm)])
    delta, raw = masked(_delta_sql("left") + _delta_sql("right")), masked(_raw_sql("left") + _raw_sql("right"))
    mask = lambda n: f"[{', '.join('1.0' if j < n // 2 else f'CASE WHEN {two} THEN 1.0 ELSE 0.0 END' for j in range(n))}]"
    return f"""WITH vectors AS (SELECT vec_id, vec_id // {LENGTH} AS episode, vec_id // {LENGTH} AS k, vec_id % {LENGTH} AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE (vec_id // {LENGTH}) % 11 < 9),
pairs AS (SELECT *, lead(e, {SKIP - 1}) OVER w AS later, lead(e, {SKIP}) OVER w AS grip FROM vectors WINDOW w AS (PARTITION BY episode ORDER BY frame)),
q AS (SELECT vec_id, {_q('e', 4)} AS l, {_q('e', 11)} AS r FROM vectors), c AS (SELECT vec_id, {_canon('l')} AS "left", {_canon('r')} AS "right" FROM q),
{_turn_sql('left')}, {_turn_sql('right')},
s AS (SELECT v.vec_id, v.k, v.frame, [{', '.join(state)}] AS state, {mask(16)} AS state_mask, [{', '.join(raw)}] AS raw, {mask(14)} AS action_mask FROM vectors v JOIN c USING (vec_id)),
a AS (SELECT vec_id, [{', '.join(delta)}] AS delta FROM pairs JOIN left_t USING (vec_id) JOIN right_t USING (vec_id) WHERE grip IS NOT NULL),
n AS (SELECT k, count(*) AS n FROM vectors GROUP BY 1), starts AS (SELECT k, unnest(range(n - {_REACH})) AS start FROM n WHERE n > {_REACH}),
ids AS (SELECT k, start, 'state' AS part, unnest(range({SEQ})) AS j, {FRAME_SKIP} AS step FROM starts UNION ALL
  SELECT k, start, 'action', unnest(range(CASE WHEN k % 3 = 0 THEN {_REACH} ELSE {_REACH // SKIP} END)), CASE WHEN k % 3 = 0 THEN 1 ELSE {SKIP} END FROM starts),
long AS (SELECT i.*, unnest(range(CASE part WHEN 'state' THEN 16 ELSE 14 END)) AS axis, unnest(CASE WHEN part = 'state' THEN s.state WHEN i.k % 3 = 0 THEN s.raw ELSE a.delta END) AS value, unnest(CASE part WHEN 'state' THEN s.state_mask ELSE s.action_mask END) AS mask
  FROM ids i JOIN s ON s.k = i.k AND s.frame = i.start + i.j * i.step LEFT JOIN a ON a.vec_id = s.vec_id),
name AS (SELECT k, start, 'chunk-000/episode_' || lpad(CAST(k AS VARCHAR), 7, '0') AS episode FROM starts),
shown AS (SELECT *, unnest(range(CASE WHEN {two} THEN 3 ELSE 2 END)) AS p, unnest(CASE WHEN {two} THEN ['back:0', 'front:0', 'wrist:1'] ELSE ['back:0', 'wrist:1'] END) AS v FROM name),
views AS (SELECT k, start, string_agg(v, ',' ORDER BY md5(concat_ws('_', '', concat_ws('_', episode, start, p)))) AS views FROM shown GROUP BY 1, 2),
prompts AS (SELECT k, start, episode, ['take it', 'put it ' || k, 'move'][CAST(CAST(concat('0x', substr(md5(concat_ws('_', '5', episode, start)), 25, 8)) AS BIGINT) % 3 AS INTEGER) + 1] AS prompt FROM name)
SELECT prompts.episode, l.start, part, CAST(j AS INTEGER) AS k, CAST(axis AS INTEGER) AS axis, value, mask, views, prompt FROM long l JOIN views USING (k, start) JOIN prompts USING (k, start)"""


def _clips(spark, d):
    source = StatisticsSource(spark, ROOT, nested=False, documents=_episodes(spark, d))
    usable = source.parts().filter("proprios is not null")
    return samples.training_samples(usable, STATS, SEQ, FRAME_SKIP, SKIP, lambda t: written(t, "blocks"), seed=5, width=WIDTH)


@query(_sample_sql())
def training_sample(spark, d):
    """State, actions, masks, views and prompt of every clip, cut out of blocks of frames."""
    part = lambda name, values, masks: F.transform(F.arrays_zip(F.col(values).alias("v"), F.col(masks).alias("m")), lambda x: F.struct(F.lit(name).alias("part"), x["v"].alias("v"), x["m"].alias("m")))
    rows = _clips(spark, d).withColumns({"shown": F.array_join(F.zip_with("views", "cameras", lambda v, c: F.concat_ws(":", v, c.cast("string"))), ",")})
    both = rows.select("episode", "start", "shown", "prompt", F.explode(F.array(part("state", "states", "state_masks"), part("action", "actions", "action_masks"))).alias("p"))
    steps = both.select("episode", "start", "shown", "prompt", F.posexplode("p").alias("k", "x"))
    long = steps.select("episode", "start", F.col("shown").alias("views"), "prompt", F.col("x.part").alias("part"), "k", F.posexplode(F.arrays_zip(F.col("x.v").alias("v"), F.col("x.m").alias("m"))).alias("axis", "y"))
    return long.select("episode", "start", "part", "k", "axis", r6(F.col("y.v")).alias("value"), F.col("y.m").alias("mask"), "views", "prompt")
