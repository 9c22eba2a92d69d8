"""Queries of the trajectory operators over the driver's tables, and their SQL counterparts."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import random as R
from ..functions import rotation as Q
from ..functions import text as X
from ..functions import vectors as V
from ..operators import clips, evaluation, metrics, sampling, schedule, statistics
from .registry import query
from .standins import FRAMES, VECTORS, e, frames, r6, r6s, table, vectors

# --- clips ---------------------------------------------------------------------------------------------------------
SEQ, SKIP = 9, 8
_META = "meta AS (SELECT user_id AS episode, count(*) AS num_frames FROM events GROUP BY 1)"
_COUNTS = f"{_META}, counts AS (SELECT episode, num_frames, num_frames - 64 AS clips FROM meta WHERE num_frames > 64)"
_CLIPS = f"{_COUNTS}, clips AS (SELECT episode, unnest(range(clips)) AS start FROM counts)"


def _meta(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("num_frames"))


def _counts(spark, d):
    return clips.clip_counts(_meta(spark, d), SEQ, SKIP)


def _clips(spark, d):
    return clips.expand(_counts(spark, d))


@query("SELECT user_id AS episode, count(*) AS num_frames FROM events GROUP BY 1")
def episode_metadata(spark, d):
    return _meta(spark, d)


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def clip_counts(spark, d):
    return _counts(spark, d)


@query(f"WITH {_CLIPS} SELECT * FROM clips")
def clip_expand(spark, d):
    return _clips(spark, d)


@query(f"""WITH {_COUNTS}, sums AS (SELECT episode, sum(clips) OVER (ORDER BY episode) - clips AS prev, sum(clips) OVER (ORDER BY episode) AS cum FROM counts),
n AS (SELECT CAST(max(cum) AS BIGINT) AS n FROM sums), ids AS (SELECT unnest(range(-n, n)) AS id FROM n),
flat AS (SELECT id, CASE WHEN id < 0 THEN id + n ELSE id END AS flat FROM ids, n)
SELECT id, episode, CAST(flat - prev AS BIGINT) AS start FROM flat JOIN sums ON flat >= prev AND flat < cum""")
def clip_lookup_flat_id(spark, d):
    """Every flat id of the table, counted from the front and from the back."""
    sums = clips.prefix_sums(_counts(spark, d))
    ids = _counts(spark, d).select(F.sum("clips").alias("n")).select(F.explode(F.sequence(-F.col("n"), F.col("n") - 1)).alias("id"))
    return clips.lookup(ids.repartition("id"), sums)


def _join(c):
    return F.array_join(c.cast("array<string>"), ",")


@query(f"WITH {_CLIPS} SELECT episode, start, array_to_string(range(start, start + 65, 8), ',') AS frame_ids, array_to_string(range(start + 3, start + 64, 4), ',') AS action_ids, array_to_string(range(start, start + 64), ',') AS raw_ids FROM clips")
def clip_ids(spark, d):
    s = F.col("start")
    return _clips(spark, d).select("episode", "start", _join(clips.frame_ids(s, SEQ, SKIP)).alias("frame_ids"), _join(clips.action_ids(s, SEQ, SKIP, 4)).alias("action_ids"), _join(clips.raw_action_ids(s, SEQ, SKIP)).alias("raw_ids"))


_STATS = "stats AS (SELECT quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM events)"


@query(f"""WITH {FRAMES}, {_CLIPS}, {_STATS}, wanted AS (SELECT episode, start, unnest(range(9)) AS k FROM clips)
SELECT w.episode, w.start, CAST(w.k AS INTEGER) AS k, f.frame, {r6s('2 * (f.value - q01) / greatest(q99 - q01, 1e-6) - 1')} AS state
FROM wanted w JOIN frames f ON f.episode = w.episode AND f.frame = w.start + 8 * w.k, stats""")
def clip_gather_state(spark, d):
    stats = statistics.quantiles(table(spark, d, "events"), [])
    rows = clips.gather_frames(_clips(spark, d), frames(spark, d), SEQ, SKIP).crossJoin(F.broadcast(stats))  # one row
    return rows.select("episode", "start", "k", "frame", r6(V.normalise(F.col("value"), F.col("q01"), F.col("q99"))).alias("state"))


# --- statistics ----------------------------------------------------------------------------------------------------
@query(f"SELECT CASE WHEN event_type IN ('click', 'view') THEN 'gripper_pos' ELSE event_type END AS key, {r6s('quantile_cont(value, 0.01)')} AS q01, {r6s('quantile_cont(value, 0.99)')} AS q99 FROM events GROUP BY 1")
def stats_quantiles(spark, d):
    keyed = table(spark, d, "events").withColumn("key", F.when(F.col("event_type").isin("click", "view"), "gripper_pos").otherwise(F.col("event_type")))
    return statistics.quantiles(keyed, ["key"]).select("key", r6(F.col("q01")).alias("q01"), r6(F.col("q99")).alias("q99"))


@query(f"WITH {VECTORS}, long AS (SELECT unnest(range(64)) AS axis, unnest(e) AS value FROM vectors) SELECT CAST(axis AS INTEGER) AS axis, {r6s('quantile_cont(value, 0.01)')} AS q01, {r6s('quantile_cont(value, 0.99)')} AS q99 FROM long GROUP BY 1")
def stats_quantiles_vector(spark, d):
    long = vectors(spark, d).select(F.posexplode(F.col("e").cast("array<double>")).alias("axis", "value"))
    return statistics.quantiles(long, ["axis"]).select("axis", r6(F.col("q01")).alias("q01"), r6(F.col("q99")).alias("q99"))


_AHEAD = f"{VECTORS}, pairs AS (SELECT *, lead(e, 3) OVER (PARTITION BY episode ORDER BY frame) AS later FROM vectors)"


def _pairs(spark, d, k=3):
    return vectors(spark, d).withColumn("later", statistics.ahead("e", k))


@query(f"""WITH {_AHEAD}, long AS (SELECT unnest(range(3)) AS axis, unnest([later[8] - e[1], later[9] - e[2], later[10] - e[3]]) AS value FROM pairs WHERE later IS NOT NULL),
q AS (SELECT axis, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM long GROUP BY 1)
SELECT 'action_ee_pos' AS key, CAST(axis AS INTEGER) AS axis, {r6s('-greatest(abs(a), abs(b))')} AS q01, {r6s('greatest(abs(a), abs(b))')} AS q99 FROM q""")
def stats_symmetric(spark, d):
    rows = _pairs(spark, d).filter("later is not null").select(F.lit("action_ee_pos").alias("key"), F.posexplode(F.array(*(e(7 + k, "later") - e(k) for k in range(3)))).alias("axis", "value"))
    q = statistics.symmetric(statistics.quantiles(rows, ["key", "axis"]), F.col("key").startswith("action_"))
    return q.select("key", "axis", r6(F.col("q01")).alias("q01"), r6(F.col("q99")).alias("q99"))


@query(f"""WITH {FRAMES}, p1 AS (SELECT quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high, count(value) AS n FROM frames),
dl AS (SELECT lead(value, 4) OVER (PARTITION BY episode ORDER BY frame) - value AS delta FROM frames),
kept AS (SELECT delta FROM dl, p1 WHERE delta IS NOT NULL AND abs(delta * 2 / greatest(high - low, 1e-6)) >= 0.1),
p2 AS (SELECT greatest(abs(quantile_cont(delta, 0.01)), abs(quantile_cont(delta, 0.99))) AS m, count(*) AS n FROM kept)
SELECT 'gripper_pos' AS key, {r6s('low')} AS q01, {r6s('high')} AS q99, n FROM p1 UNION ALL SELECT 'gripper_action', {r6s('-m')}, {r6s('m')}, n FROM p2""")
def stats_gripper_two_pass(spark, d):
    return statistics.gripper_two_pass(frames(spark, d), 4, 0.1).select("key", r6(F.col("q01")).alias("q01"), r6(F.col("q99")).alias("q99"), "n")


def _q(of: str, k: int) -> str:
    """SQL of the quaternion [w, x, y, z] of the rotation vector at elements k.. (1-based)."""
    n = f"sqrt({of}[{k}] * {of}[{k}] + {of}[{k + 1}] * {of}[{k + 1}] + {of}[{k + 2}] * {of}[{k + 2}])"
    s = f"(CASE WHEN {n} < 1e-12 THEN 0.5 ELSE sin({n} / 2) / {n} END)"
    return f"[cos({n} / 2), {of}[{k}] * {s}, {of}[{k + 1}] * {s}, {of}[{k + 2}] * {s}]"


_MUL = "[a[1]*b[1]-a[2]*b[2]-a[3]*b[3]-a[4]*b[4], a[1]*b[2]+a[2]*b[1]+a[3]*b[4]-a[4]*b[3], a[1]*b[3]-a[2]*b[4]+a[3]*b[1]+a[4]*b[2], a[1]*b[4]+a[2]*b[3]-a[3]*b[2]+a[4]*b[1]]"
_DELTA = f"""{_AHEAD}, ab AS (SELECT vec_id, {_q('later', 11)} AS a, {_q('e', 4)} AS p FROM pairs WHERE later IS NOT NULL),
conj AS (SELECT vec_id, a, [p[1], -p[2], -p[3], -p[4]] AS b FROM ab), prod AS (SELECT vec_id, {_MUL} AS q FROM conj),
can AS (SELECT vec_id, CASE WHEN q[1] < 0 THEN list_transform(q, lambda x: -x) ELSE q END AS q FROM prod),
nn AS (SELECT vec_id, q, sqrt(q[2]*q[2]+q[3]*q[3]+q[4]*q[4]) AS n FROM can),
rv AS (SELECT vec_id, unnest(range(3)) AS axis, unnest(list_transform(q[2:4], lambda x: x * CASE WHEN n < 1e-12 THEN 2.0 ELSE 2 * atan2(n, q[1]) / n END)) AS value FROM nn)"""


def _turns(spark, d):
    """Delta rotations. The array is never null; explode it by the outer form, since the plain one adds a filter on its
    size, which is pushed below the projections and unfolds their expressions."""
    return Q.with_delta(_pairs(spark, d).filter("later is not null"), Q.vector(F.col("later"), 10), Q.vector(F.col("e"), 3))


@query(f"WITH {_DELTA} SELECT CAST(axis AS INTEGER) AS axis, {r6s('quantile_cont(value, 0.01)')} AS q01, {r6s('quantile_cont(value, 0.99)')} AS q99 FROM rv GROUP BY 1")
def stats_rotation_delta(spark, d):
    long = _turns(spark, d).select(F.posexplode_outer("delta").alias("axis", "value"))
    return statistics.quantiles(long, ["axis"]).select("axis", r6(F.col("q01")).alias("q01"), r6(F.col("q99")).alias("q99"))


@query(f"""WITH {VECTORS}, long AS (SELECT unnest(range(14)) AS c, unnest(e[8:21]) AS v FROM vectors),
p AS (SELECT CASE WHEN c % 7 < 3 THEN 'action_ee_pos' ELSE 'action_ee_rotm' END AS key, CAST((c % 7) % 3 AS INTEGER) AS axis, v FROM long WHERE c % 7 < 6)
SELECT key, axis, count(*) AS n, {r6s('quantile_cont(v, 0.01)')} AS q01, {r6s('quantile_cont(v, 0.99)')} AS q99 FROM p GROUP BY 1, 2""")
def stats_raw_action_pool(spark, d):
    pool = statistics.raw_action_pool(vectors(spark, d).withColumn("raw", F.slice("e", 8, 14)), "raw")
    return statistics.quantiles(pool, ["key", "axis"]).select("key", "axis", "n", r6(F.col("q01")).alias("q01"), r6(F.col("q99")).alias("q99"))


# --- vectors -------------------------------------------------------------------------------------------------------
@query(f"""WITH {VECTORS}, q AS (SELECT axis, quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.99) AS q99 FROM (SELECT unnest(range(7)) AS axis, unnest(e[1:7]) AS v FROM vectors) GROUP BY 1),
long AS (SELECT vec_id, episode, unnest(range(7)) AS axis, unnest(e[1:7]) AS v FROM vectors)
SELECT vec_id, CAST(l.axis AS INTEGER) AS axis, CASE WHEN episode % 2 = 0 THEN {r6s('2 * (v - q01) / greatest(q99 - q01, 1e-6) - 1')} ELSE 0.0 END AS state, CASE WHEN episode % 2 = 0 THEN 1.0 ELSE 0.0 END AS mask FROM long l JOIN q ON q.axis = l.axis""")
def state_vector_masked(spark, d):
    rows = vectors(spark, d)
    stats = statistics.quantiles(rows.select(F.posexplode(F.slice("e", 1, 7).cast("array<double>")).alias("axis", "value")), ["axis"])
    arm = F.when(F.col("episode") % 2 == 0, F.slice("e", 1, 7).cast("array<double>"))
    values, mask = V.present(arm, 7)
    long = rows.select("vec_id", F.posexplode(F.arrays_zip(values.alias("v"), mask.alias("m"))).alias("axis", "x"))
    joined = long.join(F.broadcast(stats), "axis")  # one row for each of 7 axes
    state = F.when(F.col("x.m") == 0, 0.0).otherwise(r6(V.normalise(F.col("x.v"), F.col("q01"), F.col("q99"))))
    return joined.select("vec_id", "axis", state.alias("state"), F.col("x.m").alias("mask"))


@query(f"WITH {_DELTA} SELECT vec_id, CAST(axis AS INTEGER) AS axis, {r6s('value')} AS rotation FROM rv")
def action_vector_delta(spark, d):
    rows = _turns(spark, d).select("vec_id", F.posexplode_outer("delta").alias("axis", "v"))
    return rows.select("vec_id", "axis", r6(F.col("v")).alias("rotation"))


@query(f"WITH {VECTORS}, q AS (SELECT vec_id, {_q('e', 4)} AS q FROM vectors), c AS (SELECT vec_id, CASE WHEN q[1] < 0 THEN list_transform(q, lambda x: -x) ELSE q END AS q FROM q) SELECT vec_id, {r6s('q[1]')} AS w, {r6s('q[2]')} AS x, {r6s('q[3]')} AS y, {r6s('q[4]')} AS z FROM c")
def quaternion_canonical(spark, d):
    rows, q = Q.staged(vectors(spark, d).select("vec_id", "e"), "_q", Q.from_rotvec(Q.vector(F.col("e"), 3)))
    turned = Q.with_quaternion(rows, Q.to_matrix(q), "q")
    return turned.select("vec_id", *(r6(F.col("q")[k]).alias(n) for k, n in enumerate("wxyz")))


#: fixed values: the world base turned by a quarter about z, and the tool axes (x' = z, y' = -y, z' = x)
BASE, TOOL = [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [[0.0, 0.0, 1.0], [0.0, -1.0, 0.0], [1.0, 0.0, 0.0]]


@query(f"WITH {VECTORS} SELECT vec_id, {r6s('1.5 + sum(e[8]) OVER w')} AS x, {r6s('sum(e[14]) OVER w')} AS gripper FROM vectors WINDOW w AS (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING)")
def pose_accumulate_xyz(spark, d):
    w = Window.partitionBy("episode").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return vectors(spark, d).select("vec_id", r6(1.5 + F.sum(e(7)).over(w)).alias("x"), r6(F.sum(e(13)).over(w)).alias("gripper"))


_STEP = re.sub(r"\b([ab])\[", lambda m: {"a": "new", "b": "old"}[m[1]] + "[", _MUL)


@query(f"""WITH {VECTORS}, q AS (SELECT episode, frame, {_q('e', 11)} AS q FROM vectors), s AS (SELECT episode, list(q ORDER BY frame) AS s FROM q GROUP BY episode),
p AS (SELECT episode, list_reduce(s, lambda old, new: {_STEP}) AS q FROM s)
SELECT episode, {r6s('q[1]')} AS w, {r6s('q[2]')} AS x, {r6s('q[3]')} AS y, {r6s('q[4]')} AS z FROM p""")
def pose_accumulate_rotation(spark, d):
    """Ordered product of the rotations of an episode (not commutative), folded over the sorted steps."""
    step = F.array(*Q.from_rotvec(Q.vector(F.col("e"), 10)))
    steps = vectors(spark, d).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("frame", step.alias("q")))).alias("s"))
    q = Q.accumulate(F.transform("s", lambda s: s["q"]), F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0))))
    return steps.select("episode", *(r6(q[k]).alias(n) for k, n in enumerate("wxyz")))


# --- images: 64 numbers as 8x8 -------------------------------------------------------------------------------------
@query(f"""WITH {VECTORS}, s AS (SELECT episode, min(v) AS a, max(v) AS b FROM (SELECT episode, unnest(e) AS v FROM vectors) GROUP BY 1), l AS (SELECT vec_id, episode, unnest(range(64)) AS i, unnest(e) AS v FROM vectors)
SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN b - a <= 1e-6 THEN 0.0 ELSE {r6s('2 * (v - a) / greatest(b - a, 1e-6) - 1')} END AS depth FROM l JOIN s ON s.episode = l.episode""")
def depth_normalise(spark, d):
    rows = vectors(spark, d)
    span = rows.groupBy("episode").agg(F.min(F.array_min("e")).cast("double").alias("a"), F.max(F.array_max("e")).cast("double").alias("b"))
    long = rows.select("vec_id", "episode", F.posexplode("e").alias("i", "v")).join(span, "episode")
    return long.select("vec_id", "i", r6(V.scale_depth(F.col("v").cast("double"), F.col("a"), F.col("b"))).alias("depth"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(e) AS v FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('least(greatest((v + 1) * 127.5, 0), 255)')} AS pixel FROM l")
def image_affine(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode(F.transform("e", lambda v: F.least(F.greatest((v.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0)))).alias("i", "p"))
    return rows.select("vec_id", "i", r6(F.col("p")).alias("pixel"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(e) AS v FROM vectors) SELECT vec_id, CAST((i // 8 - 2) * 4 + i % 8 - 2 AS INTEGER) AS i, {r6s('v')} AS v FROM l WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5")
def image_crop_center(spark, d):
    rows = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda y: F.slice(F.col("e"), y * 8 + 3, 4)))
    return vectors(spark, d).select("vec_id", F.posexplode(rows).alias("i", "x")).select("vec_id", "i", r6(F.col("x").cast("double")).alias("v"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(25)) AS i FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('e[CAST(floor((i // 5 + 0.5) * 8 / 5) AS INTEGER) * 8 + CAST(floor((i % 5 + 0.5) * 8 / 5) AS INTEGER) + 1]')} AS v FROM l")
def image_nearest_resize(spark, d):
    at = lambda k: F.floor((k + 0.5) * 8 / 5)
    taken = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.get(F.col("e"), (at(F.floor(k / 5)) * 8 + at(k % 5)).cast("int")))
    return vectors(spark, d).select("vec_id", F.posexplode(taken).alias("i", "x")).select("vec_id", "i", r6(F.col("x").cast("double")).alias("v"))


def _lerp(n: str, size: int, to: int) -> str:
    """SQL columns of one axis: lower and upper place and the weight of the upper one."""
    at = f"greatest((({n}) + 0.5) * ({size} / {to}.0) - 0.5, 0)"
    return f"CAST(floor({at}) AS INTEGER) AS lo_, least(CAST(floor({at}) AS INTEGER) + 1, {size - 1}) AS hi_, {at} - floor({at}) AS w_"


@query(f"""WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(60)) AS i FROM vectors),
g AS (SELECT vec_id, e, i, {_lerp('i // 12', 8, 5).replace('lo_', 't').replace('hi_', 'b').replace('w_', 'v')}, {_lerp('i % 12', 8, 12).replace('lo_', 'l').replace('hi_', 'r').replace('w_', 'u')} FROM l)
SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('(e[t * 8 + l + 1] * (1 - u) + e[t * 8 + r + 1] * u) * (1 - v) + (e[b * 8 + l + 1] * (1 - u) + e[b * 8 + r + 1] * u) * v')} AS v FROM g""")
def image_bilinear_resize(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode(I.resize_bilinear(F.col("e"), 8, 8, 5, 12)).alias("i", "x"))
    return rows.select("vec_id", "i", r6(F.col("x")).alias("v"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(e) AS v FROM vectors) SELECT vec_id, CAST((i // 16) * 4 + (i % 8) // 2 AS INTEGER) AS patch, CAST((i // 8 % 2) * 2 + i % 2 AS INTEGER) AS place, {r6s('v')} AS v FROM l")
def patchify(spark, d):
    i = F.col("i")
    long = vectors(spark, d).select("vec_id", F.posexplode("e").alias("i", "x"))
    return long.select("vec_id", (F.floor(i / 16) * 4 + F.floor(i % 8 / 2)).cast("int").alias("patch"), (F.floor(i / 8) % 2 * 2 + i % 2).cast("int").alias("place"), r6(F.col("x").cast("double")).alias("v"))


def _u(*parts: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat_ws('_', {', '.join(parts)})), 25, 8)) AS BIGINT) / 4294967296.0)"


@query(f"SELECT vec_id, CAST(floor({_u('vec_id', chr(39) + 'top' + chr(39))} * 3) AS BIGINT) AS top, {r6s('0.8 + ' + _u('vec_id', chr(39) + 'bright' + chr(39)) + ' * (1.2 - 0.8)')} AS brightness, {r6s('sqrt(-2 * ln(1 - ' + _u('vec_id', chr(39) + 'n' + chr(39), chr(39) + 'r' + chr(39)) + ')) * cos(2 * pi() * ' + _u('vec_id', chr(39) + 'n' + chr(39), chr(39) + 'a' + chr(39)) + ')')} AS noise FROM embeddings")
def augmentation_params(spark, d):
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", sampling.crop_origin(8, 6, k, "top").alias("top"), r6(sampling.jitter(0.8, 1.2, k, "bright")).alias("brightness"), r6(R.normal(k, "n")).alias("noise"))


# --- text and sampling ---------------------------------------------------------------------------------------------
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) AS clean FROM documents")
def text_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", X.whitespace_clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, trim(regexp_replace(lower(translate(replace(text, '_', ' '), '!\"#$%&''()*+,-./:;<=>?@[\\]^`{{|}}~', '')), '{_BLANK}+', ' ', 'g')) AS clean FROM documents")
def text_canonicalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.canonicalize(F.col("text")).alias("clean"))


@query(f"WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1) SELECT conv_id, trim(regexp_replace(t[CAST(CAST(concat('0x', substr(md5(concat_ws('_', 'pick', conv_id)), 25, 8)) AS BIGINT) % len(t) AS INTEGER) + 1], '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS instruction FROM g")
def instruction_pick(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    usable = X.usable_instructions(F.transform("t", lambda t: t["text"]), strict=False)
    return users.withColumn("u", usable).filter("size(u) > 0").select("conv_id", sampling.pick(F.col("u"), "pick", F.col("conv_id")).alias("instruction"))


@query(r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: length(w))[1:64] AS ids FROM documents)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(64 - len(ids)), lambda i: 0)), ',') AS ids, CAST(len(ids) AS BIGINT) AS n FROM t""")
def token_pad_mask(spark, d):
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0), lambda w: F.char_length(w))
    return table(spark, d, "documents").withColumn("w", words).select("doc_id", _join(X.pad_ids(F.col("w"), 64)).alias("ids"), V.total(X.pad_mask(F.col("w"), 64)).cast("long").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5(concat_ws('_', '7', doc_id)), doc_id LIMIT 50")
def sample_episodes(spark, d):
    return sampling.cap(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 7)


@query("""WITH h AS (SELECT doc_id, md5(concat_ws('_', '7', doc_id)) AS o FROM documents), s AS (SELECT doc_id, o, CAST(concat('0x', substr(o, 1, 8)) AS BIGINT) % 4 AS shard FROM h),
b AS (SELECT doc_id, shard, (row_number() OVER (PARTITION BY shard ORDER BY o, doc_id) - 1) // 32 AS batch FROM s)
SELECT doc_id, shard, CAST(batch AS BIGINT) AS batch FROM b QUALIFY count(*) OVER (PARTITION BY shard, batch) = 32""")
def shuffle_batches(spark, d):
    return sampling.shuffle_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32, 7, shards=4)


@query("SELECT event_id, CAST(concat('0x', substr(md5(concat_ws('_', user_id, event_id % 10, event_id)), 25, 8)) AS BIGINT) AS seed FROM events")
def request_seed(spark, d):
    return table(spark, d, "events").select("event_id", R.seed32(F.col("user_id"), F.col("event_id") % 10, F.col("event_id")).alias("seed"))


# --- schedules -----------------------------------------------------------------------------------------------------
_SIGMA = "(5.0 * s / (1 + 4.0 * s))"


@query(f"WITH l AS (SELECT CAST(i AS BIGINT) AS step, {schedule.TOP!r}::DOUBLE + (0 - {schedule.TOP!r}::DOUBLE) * i / 50 AS s FROM range(50) t(i)) SELECT step, {r6s(_SIGMA)} AS sigma, CAST(trunc({_SIGMA} * 1000) AS BIGINT) AS timestep FROM l")
def noise_schedule(spark, d):
    return schedule.noise_schedule(spark, 50, 5.0).select("step", r6(F.col("sigma")).alias("sigma"), "timestep")


def _sh(t: str) -> str:
    return f"(3.0 * {t} / (1 + 2.0 * {t}))"


def _k(tag: str) -> str:
    return _u("vec_id", f"'{tag}'")


@query(f"""WITH u AS (SELECT vec_id, {_k('c')} < 0.5 AS clean, {_k('a')} AS a, {_k('v')} AS v, pow({_k('b')}, 2.0 / 3) AS b FROM embeddings)
SELECT vec_id, {r6s('CASE WHEN clean THEN ' + _sh('v') + ' ELSE ' + _sh('(a + b * (1 - a))') + ' END')} AS t, {r6s('CASE WHEN clean THEN 0.0 ELSE ' + _sh('a') + ' END')} AS ta, CASE WHEN clean THEN 0.0 ELSE 1.0 END AS weight FROM u""")
def time_mixture(spark, d):
    t, a, w = sampling.noise_levels("joint", 3.0, 0.5, F.col("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", r6(t).alias("t"), r6(a).alias("ta"), w.alias("weight"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, {_k('t')} AS t, unnest(range(7)) AS i, unnest(e[1:7]) AS x, unnest(e[8:14]) AS n FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('(1 - t) * x + t * n')} AS mixed, {r6s('n - x')} AS velocity FROM l")
def noise_mix(spark, d):
    x, n = F.slice("e", 1, 7).cast("array<double>"), F.slice("e", 8, 7).cast("array<double>")
    both = F.arrays_zip(V.mix(x, n, R.uniform(F.col("vec_id"), "t")).alias("m"), V.velocity(x, n).alias("v"))
    return vectors(spark, d).select("vec_id", F.posexplode(both).alias("i", "z")).select("vec_id", "i", r6(F.col("z.m")).alias("mixed"), r6(F.col("z.v")).alias("velocity"))


@query(f"WITH {VECTORS} SELECT vec_id, {r6s('CASE WHEN vec_id % 3 > 0 THEN e[1] + (vec_id % 3) * (e[2] - e[1]) ELSE e[2] END')} AS guided FROM vectors")
def guidance_combine(spark, d):
    return vectors(spark, d).select("vec_id", r6(V.guide(e(0), e(1), (F.col("vec_id") % 3).cast("double"))).alias("guided"))


@query(f"WITH l AS (SELECT CAST(i AS BIGINT) AS step, {schedule.TOP!r}::DOUBLE * (1 - i / 50.0) AS s, {schedule.TOP!r}::DOUBLE * (1 - i / 10.0) AS a FROM range(50) t(i)) SELECT step, {r6s(_SIGMA)} AS video, CASE WHEN step < 10 THEN {r6s('5.0 * a / (1 + 4.0 * a)')} ELSE 0.0 END AS action FROM l")
def async_time_pairs(spark, d):
    video, action = schedule.noise_schedule(spark, 50, 5.0), schedule.noise_schedule(spark, 10, 5.0)
    pairs = video.join(F.broadcast(action.select("step", F.col("sigma").alias("a"))), "step", "left")  # ten rows
    return pairs.select("step", r6(F.col("sigma")).alias("video"), r6(F.coalesce("a", F.lit(0.0))).alias("action"))


# --- metrics: an even frame predicts the odd one after it ------------------------------------------------------------
_PAIR = f"{VECTORS}, pr AS (SELECT vec_id, episode, frame, e AS p, lead(e) OVER (PARTITION BY episode ORDER BY frame) AS t FROM vectors), im AS (SELECT vec_id, episode, p, t FROM pr WHERE frame % 2 = 0 AND t IS NOT NULL), lg AS (SELECT vec_id, episode, unnest(range(64)) AS i, unnest(p) AS p, unnest(t) AS t FROM im)"


def _images(spark, d):
    return vectors(spark, d).withColumn("t", statistics.ahead("e", 1)).filter("frame % 2 = 0 and t is not null").withColumnRenamed("e", "p")


def _long(spark, d):
    z = _images(spark, d).select("vec_id", "episode", F.posexplode(F.arrays_zip("p", "t")).alias("i", "z"))
    return z.select("vec_id", "episode", "i", F.col("z.p").cast("double").alias("p"), F.col("z.t").cast("double").alias("t"))


@query(f"WITH {_PAIR} SELECT episode, {r6s('sum(pow((p - t) * (i % 3 > 0)::INT, 2)) / (sum((i % 3 > 0)::INT) + 1e-8)')} AS masked_mse, {r6s('avg(pow(p - t, 2))')} AS mse, {r6s('0.7 * sum(pow((p - t) * (i % 3 > 0)::INT, 2)) / (sum((i % 3 > 0)::INT) + 1e-8) + 0.3 * avg(pow(p - t, 2))')} AS total FROM lg GROUP BY 1")
def masked_mse(spark, d):
    m = F.when(F.col("i") % 3 > 0, 1.0).otherwise(0.0)
    got = _long(spark, d).groupBy("episode").agg(metrics.masked_mse(F.col("p"), F.col("t"), m).alias("a"), metrics.mse(F.col("p"), F.col("t")).alias("b"))
    return got.select("episode", r6(F.col("a")).alias("masked_mse"), r6(F.col("b")).alias("mse"), r6(metrics.total_loss({"a": (F.col("a"), 0.7), "b": (F.col("b"), 0.3)})).alias("total"))


@query(f"WITH {_PAIR}, m AS (SELECT vec_id, avg(pow(p - t, 2)) AS mse FROM lg GROUP BY 1) SELECT {r6s('avg(10 * log10(1 / (mse + 1e-8)))')} AS psnr FROM m")
def psnr(spark, d):
    return metrics.psnr(_long(spark, d), ["vec_id"], F.col("p"), F.col("t")).select(r6(F.col("psnr")).alias("psnr"))


@query(f"WITH {_PAIR}, f AS (SELECT vec_id, i % 8 AS c, k, sum((p - t) * cos(2 * pi() * (i // 8) * k / 8)) AS a, sum(-(p - t) * sin(2 * pi() * (i // 8) * k / 8)) AS b FROM lg, range(5) r(k) GROUP BY 1, 2, 3) SELECT {r6s('avg(sqrt(a * a + b * b))')} AS freq_loss FROM f")
def freq_loss(spark, d):
    rows = _long(spark, d).select("vec_id", (F.col("i") % 8).alias("c"), F.floor(F.col("i") / 8).alias("time"), "p", "t")
    return metrics.frequency_loss(rows, ["vec_id", "c"], "time", F.col("p"), F.col("t"), 8).select(r6(F.col("freq_loss")).alias("freq_loss"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(64)) AS i, 8 * unnest(e) AS v FROM vectors), q AS (SELECT vec_id, least(greatest(quantile_cont(abs(v), 0.995), 1.0), 3.0) AS s FROM l GROUP BY 1) SELECT l.vec_id, CAST(i AS INTEGER) AS i, {r6s('greatest(least(v, s), -s) / s')} AS clipped FROM l JOIN q ON q.vec_id = l.vec_id")
def dynamic_threshold(spark, d):
    long = vectors(spark, d).select("vec_id", F.posexplode(F.transform("e", lambda v: v.cast("double") * 8)).alias("i", "v"))
    return metrics.dynamic_threshold(long, "vec_id", "v", most=3.0).select("vec_id", "i", r6(F.col("clipped")).alias("clipped"))


# --- results and streams -------------------------------------------------------------------------------------------
_RATE = "coalesce(round_even(sum(s) / nullif(sum(n), 0), 4), 0.0)"


@query(f"WITH r AS (SELECT lang AS task, quality AS s, 1 AS n FROM labels JOIN documents USING (doc_id)) SELECT coalesce(task, '__overall__') AS task, CAST(sum(s) AS BIGINT) AS num_success_rollouts, CAST(sum(n) AS BIGINT) AS num_rollouts, {_RATE} AS success_rate FROM r GROUP BY ROLLUP (task)")
def success_rollup(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.success_rollup(rows, "lang", F.col("quality"), F.lit(1))


@query("WITH f AS (SELECT l_returnflag AS task, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS s FROM lineitem), g AS (SELECT task, CAST(sum(s) AS BIGINT) AS s, count(*) AS n FROM f GROUP BY 1) SELECT task, round_even(s / n, 4) AS success_rate, s AS num_success_rollouts, n AS num_rollouts, true AS agrees FROM g")
def success_rollup_files(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("task"), (F.col("l_linestatus") == "F").alias("ok"))
    names = lines.select("task", F.concat(F.lit("episode_0001"), F.when(F.col("ok"), "_success.mp4").otherwise("_failure.mp4")).alias("name"))
    rates = lines.groupBy("task").agg(F.bround(F.avg(F.col("ok").cast("int")), 4).alias("success_rate"))
    return evaluation.rollup_files(names, rates).select("task", "success_rate", "num_success_rollouts", "num_rollouts", "agrees")


@query(f"WITH {FRAMES}, s AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN frame END) OVER (PARTITION BY episode) AS f FROM frames) SELECT episode, frame, f AS first_success, frame % 4 = 0 AS kept FROM s WHERE frame <= coalesce(f, frame) AND frame < 30")
def rollout_truncate(spark, d):
    cut = evaluation.truncate_rollouts(frames(spark, d), F.col("event_type") == "purchase", F.lit(30))
    return cut.select("episode", "frame", "first_success", (F.col("frame") % 4 == 0).alias("kept"))


_SPEED = f"""{FRAMES}, l AS (SELECT episode, frame, (frame - first_value(frame) OVER w) AS ds, (seconds - first_value(seconds) OVER w) AS dt, count(*) OVER w AS n, value FROM frames WHERE frame > 0 WINDOW w AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
s AS (SELECT episode, frame, value, CASE WHEN n < 2 OR dt <= 0 THEN 0.0 ELSE ds / dt END AS speed FROM l)"""


@query(f"""WITH {_SPEED}
SELECT episode, frame, {r6s('speed')} AS speed, CASE WHEN speed > 0 THEN round((200 - frame) / speed, 2) END AS eta FROM s""")
def speed_eta(spark, d):
    got = evaluation.speed(frames(spark, d), "episode", "frame", "seconds", 200)
    return got.select("episode", "frame", r6(F.col("speed")).alias("speed"), F.round("eta", 2).alias("eta"))


@query(f"""WITH {_SPEED}, t AS (SELECT *, CAST(floor(CASE WHEN speed > 0 THEN (200 - frame) / speed END) AS BIGINT) AS eta FROM s)
SELECT episode, lpad(CAST(frame AS VARCHAR), 5, '0') AS step,
  CASE WHEN speed >= 1000 THEN printf('%.3fk it/s', speed / 1000) ELSE printf('%.3f it/s', speed) END AS speed,
  printf('%02dh %02dm %02ds', eta // 3600, eta % 3600 // 60, eta % 60) AS eta,
  CASE WHEN isnan(value) THEN 'nan' WHEN value = 0 THEN '0.000' WHEN abs(value) < 1e-4 OR abs(value) > 1e6 THEN printf('%.3e', value) WHEN abs(value) >= 1000 THEN printf('%.3f', value)
    ELSE rtrim(rtrim(printf('%.6f', value), '0'), '.') END AS value FROM t""")
def log_format(spark, d):
    """Log text of speeds, times and values."""
    got = evaluation.speed(frames(spark, d), "episode", "frame", "seconds", 200)
    return got.select("episode", X.format_step(F.col("frame"), 5).alias("step"), X.format_speed(F.col("speed"), "it/s").alias("speed"), X.format_eta(F.col("eta")).alias("eta"), X.format_number(F.col("value")).alias("value"))


_QUEUE = "ev AS (SELECT event_id AS id, event_type, epoch_us(ts) / 1e6 AS ts, user_id % 4 AS queue FROM events WHERE event_type IN ('click', 'view'))"


def _messages(spark, d):
    rows = table(spark, d, "events").filter(F.col("event_type").isin("click", "view"))
    return rows.select((F.col("user_id") % 4).alias("queue"), F.when(F.col("event_type") == "click", "request").otherwise("ready").alias("kind"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


@query(f"""WITH {_QUEUE}, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, id) AS k FROM ev WHERE event_type = 'click'), w AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, id) AS k FROM ev WHERE event_type = 'view')
SELECT r.queue, r.id AS request_id, w.id AS worker_id, CASE WHEN w.ts IS NOT NULL THEN greatest(r.ts, w.ts) END AS dispatch_ts FROM r LEFT JOIN w ON w.queue = r.queue AND w.k = r.k""")
def broker_dispatch(spark, d):
    m = _messages(spark, d)
    return evaluation.dispatch(m.filter("kind = 'request'"), m.filter("kind = 'ready'")).select("queue", "request_id", "worker_id", "dispatch_ts")


@query(f"WITH {_QUEUE} SELECT queue, id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY queue ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM ev")
def broker_queue_depth(spark, d):
    return evaluation.queue_depth(_messages(spark, d), F.when(F.col("kind") == "request", 1).otherwise(-1)).select("queue", "id", "depth")


# --- small functions over generated numbers ------------------------------------------------------------------------
def _bucket(p: str) -> str:
    far = f"(8 + CAST(floor(ln(greatest(abs({p}), 1) / 8.0) / ln(16.0) * 8) AS BIGINT))"
    return f"CASE WHEN {p} > 0 THEN 16 ELSE 0 END + CASE WHEN abs({p}) < 8 THEN abs({p}) ELSE least({far}, 15) END"


@query(f"SELECT CAST(p AS BIGINT) AS p, CAST({_bucket('p')} AS BIGINT) AS bucket FROM range(-150, 150) t(p)")
def relative_bucket(spark, d):
    return spark.range(-150, 150).select(F.col("id").alias("p"), V.relative_bucket(F.col("id")).alias("bucket"))


@query(f"WITH l AS (SELECT CAST(p AS BIGINT) AS p, k FROM range(100) t(p), range(16) s(k)) SELECT p, CAST(k AS INTEGER) AS k, {r6s('CASE WHEN k < 8 THEN cos(p * pow(10000.0, -k / 8.0)) ELSE sin(p * pow(10000.0, -(k - 8) / 8.0)) END')} AS v FROM l")
def sinusoid(spark, d):
    return spark.range(100).select(F.col("id").alias("p"), F.posexplode(V.sinusoid(F.col("id").cast("double"), 16)).alias("k", "x")).select("p", "k", r6(F.col("x")).alias("v"))


@query(f"SELECT CAST(i AS BIGINT) AS step, CASE WHEN i = 0 THEN 0 ELSE 1 + (i - 1) // 4 END AS block, {r6s('CASE WHEN i < 20 THEN i / 20.0 ELSE 0.5 * (1 + cos(pi() * (i - 20) / 180)) END')} AS rate FROM range(200) t(i)")
def latent_blocks(spark, d):
    return spark.range(200).select(F.col("id").alias("step"), V.latent_block(F.col("id")).alias("block"), r6(schedule.learning_rate(F.col("id").cast("double"), 1.0, 20, 200)).alias("rate"))


@query(f"SELECT vec_id, CASE WHEN {_u('vec_id', chr(39) + 'drop' + chr(39))} < 0.1 THEN '' ELSE 'prompt ' || vec_id END AS prompt FROM embeddings")
def text_dropout(spark, d):
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", sampling.dropout(F.concat(F.lit("prompt "), k.cast("string")), 0.1, k, "drop").alias("prompt"))


@query("SELECT event_id AS seed FROM events WHERE event_id >= 500 AND event_type <> 'view' ORDER BY event_id LIMIT 20")
def valid_seeds(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("seed"), "event_type")
    return evaluation.valid_seeds(rows, 500, F.col("event_type") != "view", 20).select("seed")


@query("SELECT p_partkey, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM (SELECT p_partkey, 16 * (p_size + 20) AS a FROM part), LATERAL (SELECT sqrt(65536.0 * a / 480) AS w0, 65536.0 / sqrt(65536.0 * a / 480) AS h0), LATERAL (SELECT floor(w0 / 32) * 32 AS w1, floor(65536.0 / (floor(w0 / 32) * 32) / 32) * 32 AS h1, floor(h0 / 32) * 32 AS h2, floor(65536.0 / (floor(h0 / 32) * 32) / 32) * 32 AS w2), LATERAL (SELECT greatest(a / 480 / (w1 / h1), w1 / h1 / (a / 480)) < greatest(a / 480 / (w2 / h2), w2 / h2 / (a / 480)) AS f), LATERAL (SELECT CASE WHEN f THEN w1 ELSE w2 END AS w, CASE WHEN f THEN h1 ELSE h2 END AS h)")
def output_size(spark, d):
    best = V.best_size((16 * (F.col("p_size") + 20)).cast("double"), F.lit(480.0), 32, 32, 65536)
    return table(spark, d, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.w", "b.h")
