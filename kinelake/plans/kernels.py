"""Queries of array, image, rotation and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import random as R
from ..functions import rotation as Q
from ..functions import text as X
from ..functions import vectors as V
from ..operators import evaluation, sampling, schedule
from ..sources import episodes
from .reference import _BLANK, BASE, TOOL, _k, _lerp, _q, _sh, _u
from .registry import query
from .standins import VECTORS, e, r6, r6s, table, vectors

_L64 = f"{VECTORS}, l AS (SELECT vec_id, e, unnest(range(64)) AS i FROM vectors)"


def _long(spark, d, array, name="v"):
    rows = vectors(spark, d).select("vec_id", F.posexplode_outer(array).alias("i", "x"))
    return rows.select("vec_id", "i", r6(F.col("x").cast("double")).alias(name))


# --- vectors -------------------------------------------------------------------------------------------------------
@query(f"""WITH {VECTORS}, s AS (SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * x)) / 64 AS sq, list_sum(e) / 64 AS mu, list_max(e) AS top FROM vectors),
z AS (SELECT *, list_sum(list_transform(e, lambda x: (x - mu) * (x - mu))) / 64 AS var, list_sum(list_transform(e, lambda x: exp(x - top))) AS z FROM s),
l AS (SELECT *, unnest(range(64)) AS i, unnest(e) AS x FROM z)
SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('x / sqrt(sq + 1e-6)')} AS rms, {r6s('(x - mu) / sqrt(var + 1e-6)')} AS layer, {r6s('exp(x - top) / z')} AS soft, {r6s('x / (1 + exp(-x))')} AS silu,
  {r6s('0.5 * x * (1 + (exp(2 * (0.7978845608028654 * (x + 0.044715 * x * x * x))) - 1) / (exp(2 * (0.7978845608028654 * (x + 0.044715 * x * x * x))) + 1))')} AS gelu FROM l""")
def norms(spark, d):
    x = F.col("e").cast("array<double>")
    parts = {"rms": V.rms_norm(x), "layer": V.layer_norm(x), "soft": V.softmax(x), "silu": F.transform(x, V.silu), "gelu": F.transform(x, V.gelu)}
    rows = vectors(spark, d).select("vec_id", F.posexplode_outer(F.arrays_zip(*(c.alias(n) for n, c in parts.items()))).alias("i", "z"))
    return rows.select("vec_id", "i", *(r6(F.col(f"z.{n}")).alias(n) for n in parts))


@query(f"""WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(2)) AS g, e FROM vectors)
SELECT vec_id, CAST(g AS INTEGER) AS i, {r6s('CASE WHEN g = 0 THEN (e[1] + e[2] + e[3]) / 4 ELSE (e[4] + e[5] + e[6] + e[7]) / 4 END')} AS mean FROM l""")
def group_means(spark, d):
    return _long(spark, d, V.average_groups(F.slice("e", 1, 7).cast("array<double>"), 4), "mean")


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(21)) AS i FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('e[i // 3 + 1]')} AS v FROM l")
def repeat_interleave(spark, d):
    return _long(spark, d, V.repeat_each(F.slice("e", 1, 7), 3))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, frame, e, unnest(range(8)) AS i FROM vectors), t AS (SELECT *, frame * pow(10000.0, -2.0 * (i // 2) / 8) AS a, e[(i // 2) * 2 + 1] AS x, e[(i // 2) * 2 + 2] AS y FROM l) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('CASE WHEN i % 2 = 0 THEN x * cos(a) - y * sin(a) ELSE x * sin(a) + y * cos(a) END')} AS v FROM t")
def rotary_pairs(spark, d):
    return _long(spark, d, V.rotate_pairs(F.col("e"), F.col("frame").cast("double"), 8))


_MEAN, _STD = [0.125 * k - 3 for k in range(48)], [1 + 0.0625 * k for k in range(48)]


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(48)) AS i, unnest(e[1:48]) AS x FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('(x - (0.125 * i - 3)) / (1 + 0.0625 * i)')} AS scaled, {r6s('x')} AS back, {r6s('x * (1 + 0.0625 * i) + (0.125 * i - 3)')} AS unscaled FROM l")
def latent_scale(spark, d):
    x = F.slice("e", 1, 48).cast("array<double>")
    scaled = V.latent_scaled(x, _MEAN, _STD)
    parts = F.arrays_zip(scaled.alias("s"), V.latent_unscaled(scaled, _MEAN, _STD).alias("b"), V.latent_unscaled(x, _MEAN, _STD).alias("u"))
    return vectors(spark, d).select("vec_id", F.posexplode_outer(parts).alias("i", "z")).select("vec_id", "i", r6(F.col("z.s")).alias("scaled"), r6(F.col("z.b")).alias("back"), r6(F.col("z.u")).alias("unscaled"))


@query(f"WITH {VECTORS} SELECT vec_id, {r6s('e[1] + exp(0.5 * greatest(least(e[2] * 40, 20.0), -30.0)) * e[3]')} AS v FROM vectors")
def reparameterise(spark, d):
    return vectors(spark, d).select("vec_id", r6(V.reparameterise(e(0), e(1) * 40, e(2))).alias("v"))


@query(f"WITH {VECTORS}, s AS (SELECT vec_id, list_transform(e, lambda x: x * 25000) AS x FROM vectors), l AS (SELECT vec_id, list_max(list_transform(x, lambda v: abs(v))) >= 65520 AS cut, unnest(range(64)) AS i, unnest(x) AS x FROM s) SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN cut THEN least(greatest(x, -64504.0), 64504.0) ELSE x END, 3) + 0.0 AS v FROM l")
def half_clamp(spark, d):
    x = F.transform("e", lambda v: v.cast("double") * 25000)
    rows = vectors(spark, d).select("vec_id", F.posexplode_outer(V.half_clamped(x)).alias("i", "x"))
    return rows.select("vec_id", "i", (F.round("x", 3) + F.lit(0.0)).alias("v"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(32)) AS i FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN i < 16 THEN {r6s('CASE WHEN i < 8 THEN e[i + 1] ELSE 0.0 END')} ELSE {r6s('CASE WHEN i < 23 THEN e[i + 2] ELSE 0.0 END')} END AS v FROM l")
def action_trim(spark, d):
    """Right half of a state forced to 0, then an action cut to 7 numbers and padded to 16."""
    state = V.zero_from(F.slice("e", 1, 16).cast("array<double>"), 8)
    action = V.pad_zeros(V.head(F.slice("e", 18, 14).cast("array<double>"), 7), 9)
    return _long(spark, d, F.concat(state, action))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(9)) AS i FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('CASE WHEN i = 0 THEN e[10] ELSE e[i + 1] END')} AS v FROM l")
def conditioning_frame(spark, d):
    """The first frame of a noisy sequence is the given one."""
    return _long(spark, d, V.first_fixed(F.slice("e", 1, 9), F.col("e")[9]))


@query(f"""WITH u AS (SELECT vec_id, {_u('vec_id', "'m'")} < 0.2 AS c, exp(-3.5 + 0.5 * sqrt(-2 * ln(1 - {_u('vec_id', "'l'", "'r'")})) * cos(2 * pi() * {_u('vec_id', "'l'", "'a'")})) AS level FROM embeddings), l AS (SELECT *, unnest(range(8)) AS i FROM u)
SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 0.0 ELSE 1.0 END AS zero, {r6s('CASE WHEN c AND i = 0 THEN level ELSE 1.0 END')} AS one, CASE WHEN c AND i = 0 THEN 0.0 ELSE 1.0 END AS two FROM l""")
def masks_like(spark, d):
    k, x = F.col("vec_id"), F.slice("e", 1, 8)
    zero, _ = V.like_masks(x)
    one, two = V.like_masks(x, R.uniform(k, "m") < 0.2, F.exp(-3.5 + 0.5 * R.normal(k, "l")))
    rows = vectors(spark, d).select("vec_id", F.posexplode_outer(F.arrays_zip(zero.alias("zero"), one.alias("one"), two.alias("two"))).alias("i", "z"))
    return rows.select("vec_id", "i", "z.zero", r6(F.col("z.one")).alias("one"), "z.two")


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(15)) AS i FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('CASE WHEN i < 9 THEN e[i % 3 + 1] ELSE 0.0 END')} AS v FROM l")
def first_repeated(spark, d):
    """A state of three numbers at each of three steps, and two empty actions."""
    state = F.slice("e", 1, 3).cast("array<double>")
    return _long(spark, d, F.flatten(F.concat(V.repeat_over_time(state, 3), V.zeros(2, 3))))


# --- rotations -----------------------------------------------------------------------------------------------------
def _matrix(of: str, k: int) -> str:
    """SQL of the matrix by rows of the rotation vector at elements k.. (1-based), of a list column."""
    q = _q(of, k)
    w, x, y, z = (f"({q})[{n}]" for n in (1, 2, 3, 4))
    return f"[1-2*({y}*{y}+{z}*{z}), 2*({x}*{y}-{w}*{z}), 2*({x}*{z}+{w}*{y}), 2*({x}*{y}+{w}*{z}), 1-2*({x}*{x}+{z}*{z}), 2*({y}*{z}-{w}*{x}), 2*({x}*{z}-{w}*{y}), 2*({y}*{z}+{w}*{x}), 1-2*({x}*{x}+{y}*{y})]"


def _entries(m) -> list:
    return [r6(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)]


def _select(of: str, order) -> str:
    return ", ".join(f"{r6s(f'{s}{of}[{k + 1}]')} AS r{n // 3}{n % 3}" for n, (s, k) in enumerate(order))


_FORWARD = [("", 5), ("-", 4), ("", 3), ("-", 2), ("", 1), ("-", 0), ("", 8), ("-", 7), ("", 6)]
_BACK = [("-", 5), ("", 4), ("-", 3), ("", 2), ("-", 1), ("", 0), ("", 8), ("-", 7), ("", 6)]


@query(f"WITH {VECTORS}, m AS (SELECT vec_id, e, {_matrix('e', 4)} AS m FROM vectors) SELECT vec_id, {r6s('e[2]')} AS px, {r6s('-e[1]')} AS py, {r6s('e[3]')} AS pz, {_select('m', _FORWARD)} FROM m")
def pose_base_change(spark, d):
    rows, q = Q.staged(vectors(spark, d), "_q", Q.from_rotvec(Q.vector(F.col("e"), 3)))
    p, m = Q.apply_constant(BASE, Q.vector(F.col("e"), 0)), Q.change_basis(BASE, Q.to_matrix(q), TOOL)
    return rows.select("vec_id", *(r6(c).alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)), *_entries(m))


@query(f"WITH {VECTORS}, m AS (SELECT vec_id, e, {_matrix('e', 4)} AS m FROM vectors) SELECT vec_id, {r6s('-e[2]')} AS px, {r6s('e[1]')} AS py, {r6s('e[3]')} AS pz, {_select('m', _BACK)} FROM m")
def pose_base_inverse(spark, d):
    rows, q = Q.staged(vectors(spark, d), "_q", Q.from_rotvec(Q.vector(F.col("e"), 3)))
    base, tool = Q.transposed(BASE), Q.transposed(TOOL)
    p, m = Q.apply_constant(base, Q.vector(F.col("e"), 0)), Q.change_basis(base, Q.to_matrix(q), tool)
    return rows.select("vec_id", *(r6(c).alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)), *_entries(m))


@query(f"""WITH {VECTORS}, m AS (SELECT vec_id, e, CASE vec_id % 3 WHEN 0 THEN {_matrix('e', 1)} WHEN 1 THEN e[1:9] END AS m FROM vectors)
SELECT vec_id, {_select('m', [("", k) for k in range(9)])} FROM m""")
def rotation_encodings(spark, d):
    """Rotations given as 3 numbers, as 9, and as 4, which is no encoding."""
    own = F.slice("e", 1, F.when(F.col("vec_id") % 3 == 0, 3).when(F.col("vec_id") % 3 == 1, 9).otherwise(4))
    return vectors(spark, d).withColumn("own", own).select("vec_id", *_entries(Q.any_encoding(F.col("own"))))


#: fixed values: turn of the tool axes about z
TURN = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


def _relative() -> str:
    turned = [[" + ".join(f"b[{3 * k + i + 1}] * m[{3 * k + j + 1}]" for k in range(3)) for j in range(3)] for i in range(3)]
    order = [(1, ""), (0, "-"), (2, "")]
    entries = [r6s(f"{s}({turned[i][j]})") + f" AS r{i}{n}" for i in range(3) for n, (j, s) in enumerate(order)]
    place = [r6s(" + ".join(f"b[{3 * k + i + 1}] * (e[{8 + k}] - e[{1 + k}])" for k in range(3))) + f" AS p{c}" for i, c in enumerate("xyz")]
    return ", ".join(place + entries)


@query(f"WITH {VECTORS}, m AS (SELECT vec_id, e, {_matrix('e', 4)} AS b, {_matrix('e', 11)} AS m FROM vectors) SELECT vec_id, {_relative()} FROM m")
def base_frame_pose(spark, d):
    """Pose in a base's frame, its tool axes turned."""
    rows, b = Q.staged(vectors(spark, d), "_b", Q.from_rotvec(Q.vector(F.col("e"), 3)))
    rows, q = Q.staged(rows, "_q", Q.from_rotvec(Q.vector(F.col("e"), 10)))
    turned, place = Q.relative_pose(Q.to_matrix(b), Q.vector(F.col("e"), 0), Q.to_matrix(q), Q.vector(F.col("e"), 7))
    one = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
    return rows.select("vec_id", *(r6(c).alias(f"p{n}") for c, n in zip(place, "xyz", strict=True)), *_entries(Q.change_basis(one, turned, TURN)))


# --- images: 64 numbers as 8x8 -------------------------------------------------------------------------------------
_BILINEAR = "(e[(top + t) * 8 + lft + l + 1] * (1 - u) + e[(top + t) * 8 + lft + r + 1] * u) * (1 - v) + (e[(top + b) * 8 + lft + l + 1] * (1 - u) + e[(top + b) * 8 + lft + r + 1] * u) * v"


@query(f"""WITH {VECTORS}, o AS (SELECT vec_id, e, CAST(floor({_u('episode', "'top'")} * 3) AS INTEGER) AS top, CAST(floor({_u('episode', "'left'")} * 3) AS INTEGER) AS lft, unnest(range(64)) AS i FROM vectors),
g AS (SELECT *, {_lerp('i // 8', 6, 8).replace('lo_', 't').replace('hi_', 'b').replace('w_', 'v')}, {_lerp('i % 8', 6, 8).replace('lo_', 'l').replace('hi_', 'r').replace('w_', 'u')} FROM o)
SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s(_BILINEAR)} AS rgb, {r6s('2 * e[(top + (i // 8) * 6 // 8) * 8 + lft + (i % 8) * 6 // 8 + 1]')} AS depth, {r6s('e[i + 1]')} AS whole FROM g""")
def random_crop(spark, d):
    """One crop for all frames of a view (episode), colour and depth, resized back; a ratio of 1 changes nothing."""
    view = F.col("episode")
    top, left = sampling.crop_origin(8, I.cropped_size(8, 0.8), view, "top"), sampling.crop_origin(8, I.cropped_size(8, 0.8), view, "left")
    rows = vectors(spark, d).withColumns({"top": top, "left": left})
    depth = F.transform("e", lambda v: 2 * v.cast("double"))
    parts = {"rgb": I.crop_and_resize(F.col("e"), 8, 8, 0.8, F.col("top"), F.col("left")), "depth": I.crop_and_resize(depth, 8, 8, 0.8, F.col("top"), F.col("left"), depth=True), "whole": I.crop_and_resize(F.col("e"), 8, 8, 1.0, F.col("top"), F.col("left"))}
    rows = rows.select("vec_id", F.posexplode_outer(F.arrays_zip(*(c.alias(n) for n, c in parts.items()))).alias("i", "z"))
    return rows.select("vec_id", "i", *(r6(F.col(f"z.{n}").cast("double")).alias(n) for n in parts))


@query(f"""WITH {VECTORS}, c AS (SELECT vec_id, e, CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS n FROM vectors), l AS (SELECT vec_id, e, n, unnest(range(CASE WHEN n = 1 THEN 36 WHEN n = 3 THEN 12 ELSE 9 END)) AS i FROM c)
SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('CASE WHEN n = 1 THEN e[i // 3 + 1] ELSE e[(i // 3) * n + i % 3 + 1] END / 127.5 - 1')} AS v FROM l""")
def video_channels(spark, d):
    """Frames of 12 numbers with one, three or four channels, as three channels scaled to -1..1."""
    n = F.when(F.col("vec_id") % 3 == 0, 1).when(F.col("vec_id") % 3 == 1, 3).otherwise(4)
    rgb = I.three_channels(F.slice("e", 1, 12), n)
    return _long(spark, d, F.transform(rgb, lambda x: x.cast("double") / 127.5 - 1))


@query(f"WITH {_L64} SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('e[((i // 16) * 2 + i % 4 // 2) * 8 + (i // 4) % 4 * 2 + i % 2 + 1]')} AS token, {r6s('e[i + 1]')} AS back FROM l")
def unpatchify(spark, d):
    """Tokens of 2x2 patches, and the image that they make again."""
    rows = vectors(spark, d).withColumn("t", I.patches(F.col("e"), 8, 8, 2))
    rows = rows.select("vec_id", F.posexplode_outer(F.arrays_zip(F.col("t"), I.unpatched(F.col("t"), 8, 8, 2).alias("b"))).alias("i", "z"))
    return rows.select("vec_id", "i", r6(F.col("z.t").cast("double")).alias("token"), r6(F.col("z.b").cast("double")).alias("back"))


@query(f"WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(64)) AS i FROM vectors) SELECT vec_id, CAST(i AS INTEGER) AS i, {r6s('e[(i % 16 // 8) * 32 + (i // 16) * 8 + i % 8 + 1]')} AS v FROM l")
def views_side_by_side(spark, d):
    """Two views of 4x8 pixels as one image of 4x16."""
    return _long(spark, d, I.side_by_side([F.slice("e", 1, 32), F.slice("e", 33, 32)], 4, 8))


# --- levels --------------------------------------------------------------------------------------------------------
@query(f"""WITH u AS (SELECT vec_id, {_k('v')} AS v, {_k('a')} AS a, pow({_k('b')}, 2.0 / 3) AS b FROM embeddings)
SELECT vec_id, {r6s(_sh('v'))} AS independent, {r6s(_sh('a'))} AS independent_action, {r6s(_sh('v'))} AS uniform, {r6s(_sh('b'))} AS beta FROM u""")
def noise_modes(spark, d):
    k = F.col("vec_id")
    one, two, three = (sampling.noise_levels(m, 3.0, 0.5, k) for m in ("independent", "uniform", "beta"))
    return table(spark, d, "embeddings").select("vec_id", r6(one[0]).alias("independent"), r6(one[1]).alias("independent_action"), r6(two[0]).alias("uniform"), r6(three[1]).alias("beta"))


@query(f"SELECT CAST(i AS BIGINT) AS i, {r6s('exp(0.75) / (exp(0.75) + pow(1 / ((i + 1) / 200.0) - 1, 1.5))')} AS shifted, {r6s('1 - (i + 1) / 200.0')} AS alpha, {r6s('(i + 1) / 200.0')} AS sigma, {r6s('(i + 1) * 5.0')} AS t FROM range(200) r(i)")
def level_forms(spark, d):
    """Levels shifted by the exponential form, as weights of sample and noise, and as timesteps."""
    s = (F.col("id") + 1) / 200.0
    alpha, sigma = schedule.alpha_sigma(s)
    return spark.range(200).select(F.col("id").alias("i"), r6(schedule.dynamic_shift(s, 0.75, 1.5)).alias("shifted"), r6(alpha).alias("alpha"), r6(sigma).alias("sigma"), r6(schedule.timestep(s)).alias("t"))


# --- views and names -----------------------------------------------------------------------------------------------
_VIEWS = """views AS (SELECT p_partkey // 3 AS episode, 'cam' || (p_partkey % 3) AS camera, CASE p_size % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' WHEN 2 THEN 'static' ELSE 'other' END AS type,
  CASE WHEN p_size % 7 = 0 THEN 15.0 ELSE 30.0 END AS fps, 100 AS "end", p_size * 3 AS last_frame FROM part)"""


def _views(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 3).alias("episode"), F.concat(F.lit("cam"), (F.col("p_partkey") % 3).cast("string")).alias("camera"),
        F.when(size % 4 == 0, "static").when(size % 4 == 1, "dynamic").when(size % 4 == 2, "static").otherwise("other").alias("type"),
        F.when(size % 7 == 0, 15.0).otherwise(30.0).alias("fps"), F.lit(100).alias("end"), (size * 3).alias("last_frame"),
    )


@query(f"""WITH {_VIEWS} SELECT episode, camera, CASE WHEN type NOT IN ('static', 'dynamic') THEN 'camera type' WHEN last_frame >= "end" THEN 'frame past the end' WHEN max(fps) OVER w - min(fps) OVER w > 1e-6 THEN 'frame rates differ' END AS reason FROM views WINDOW w AS (PARTITION BY episode)""")
def view_checks(spark, d):
    return episodes.view_problems(_views(spark, d)).select("episode", "camera", "reason")


@query(f"WITH {_VIEWS} SELECT episode, string_agg(camera || ':' || CASE type WHEN 'static' THEN 0 ELSE 1 END || ':' || printf('%.3f', fps / 8), ',' ORDER BY camera) AS views FROM views WHERE type <> 'other' GROUP BY 1")
def view_order(spark, d):
    """Views of an episode by camera name, with the code of their type and the frame rate of every eighth frame."""
    rows = _views(spark, d).filter("type <> 'other'")
    one = F.concat_ws(":", episodes.camera_code(F.col("type")).cast("string"), F.format_string("%.3f", episodes.effective_fps(F.col("fps"), 8)))
    grouped = rows.groupBy("episode").agg(F.map_from_entries(F.collect_list(F.struct("camera", one.alias("v")))).alias("m"))
    return grouped.select("episode", F.array_join(F.transform(episodes.sorted_views(F.col("m")), lambda v: F.concat_ws(":", v["key"], v["value"])), ",").alias("views"))


@query("""WITH l AS (SELECT vec_id, unnest(range(3)) AS k, unnest(['back', 'front', 'wrist']) AS v FROM embeddings)
SELECT vec_id, string_agg(v, ',' ORDER BY md5(concat_ws('_', '', concat_ws('_', vec_id, k)))) AS views FROM l GROUP BY 1""")
def view_shuffle(spark, d):
    """One order of views for colour, depth and camera type of a sample."""
    views = F.array(*(F.lit(v) for v in ("back", "front", "wrist")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(sampling.permute(views, F.col("vec_id")), ",").alias("views"))


@query(f"""WITH c AS (SELECT item_id, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) AS w, text FROM benchmark)
SELECT item_id, w AS whitespace, lower(w) AS lower, trim(regexp_replace(lower(translate(replace(text, '_', ' '), '!\"#$%&''()*+,-./:;<=>?@[\\]^`{{|}}~', '')), '{_BLANK}+', ' ', 'g')) AS canonicalize FROM c""")
def text_modes(spark, d):
    return table(spark, d, "benchmark").select("item_id", *(X.clean(F.col("text"), m).alias(m) for m in ("whitespace", "lower", "canonicalize")))


@query("SELECT l_orderkey, l_linenumber, l_quantity % 2 = 0 AS flag FROM lineitem")
def text_to_bool(spark, d):
    words = F.when(F.col("l_quantity") % 2 == 0, F.element_at(F.array(*map(F.lit, ("Yes", "true", "T", "y", "1"))), F.col("l_linenumber") % 5 + 1)).otherwise(F.element_at(F.array(*map(F.lit, ("no", "False", "f", "N", "0"))), F.col("l_linenumber") % 5 + 1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.to_bool(words).alias("flag"))


@query("""SELECT event_id, substr(md5('name_' || event_id), 1, 16) || '.mp4' AS name, (event_id % 8) || '_' || (event_id // 8) || '_' || CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failure' END AS rollout,
  CAST(event_id % 8 AS INTEGER) AS rank, CAST(event_id // 8 AS INTEGER) AS number, event_type = 'purchase' AS success FROM events""")
def result_names(spark, d):
    """File names by hash, and names of rollouts, built and read back."""
    k, won = F.col("event_id"), F.col("event_type") == "purchase"
    rows = table(spark, d, "events").select("event_id", X.random_name("name", k, suffix="mp4").alias("name"), X.rollout_name(k % 8, F.floor(k / 8), won).alias("rollout"))
    return rows.select("*", X.parse_rollout_name(F.col("rollout")).alias("p")).select("event_id", "name", "rollout", "p.*")


# --- tasks ---------------------------------------------------------------------------------------------------------
@query(f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {n})" for t, n in evaluation.STEP_LIMITS.items())}) v(task, step_limit)), n AS (SELECT task, step_limit, row_number() OVER () - 1 AS k FROM t)
SELECT u.user_id AS rank, n.task, CAST(n.step_limit AS INTEGER) AS step_limit FROM (SELECT DISTINCT user_id FROM events) u JOIN n ON n.k = u.user_id % {len(evaluation.STEP_LIMITS)}""")
def step_limits(spark, d):
    """Task of each rank, and its step limit."""
    ranks = table(spark, d, "events").select(F.col("user_id").alias("rank")).distinct()
    return evaluation.with_limit(ranks.withColumn("task", evaluation.task_of(F.col("rank")))).select("rank", "task", "step_limit")
