"""Queries of the solvers, of noise at given steps, of colour changes and of structural similarity: recurrences, which
the SQL walks step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import random as R
from ..operators import metrics, sampling, schedule
from .reference import _PAIR, _images, _u
from .registry import query
from .standins import VECTORS, e, r6, r6s, table, vectors

_TOP = f"{schedule.TOP!r}::DOUBLE"


def _flow(x, _s):
    """Predicted velocity of the made-up model."""
    return x - 0.25


# --- solver with corrector, order 2, in closed form -----------------------------------------------------------------
_SECOND = f"""raw AS (SELECT CAST(i AS INTEGER) AS k, {_TOP} * (1 - i / 10.0) AS t FROM range(10) r(i)),
lv AS (SELECT k, 5.0 * t / (1 + 4.0 * t) AS s FROM raw UNION ALL SELECT 10, 0.0),
la AS (SELECT k, s, CASE WHEN s > 0 THEN ln(1 - s) - ln(s) END AS l, lead(s) OVER (ORDER BY k) AS s2 FROM lv),
st AS (SELECT k, s, s2, lead(l) OVER (ORDER BY k) - l AS h, lag(l) OVER (ORDER BY k) - l AS back, least(2, k + 1, 10 - k) AS o FROM la),
mo AS (SELECT *, CASE WHEN h IS NULL THEN 1.0 ELSE 1 - exp(-h) END AS m0 FROM st WHERE k < 10),
m2 AS (SELECT *, 1 - m0 / h AS m1, 1 - 2 / h * (1 - m0 / h) AS m2, back / h AS r, 0.5 * (1 - s2) * m0 AS half FROM mo),
co AS (SELECT k, o, s, s2 / s AS a, (1 - s2) * m0 AS b, CASE WHEN o = 2 THEN half / r ELSE 0.0 END AS c, CASE WHEN o = 2 THEN (1 - s2) * (m1 - m2) / (1 - r) / r ELSE 0.0 END AS d,
  CASE WHEN o = 2 THEN (1 - s2) * m1 - (1 - s2) * (m1 - m2) / (1 - r) ELSE half END AS e FROM m2)"""


@query(f"WITH {_SECOND} SELECT {r6s('k')} AS step, {r6s('o')} AS \"order\", {r6s('s')} AS sigma, {', '.join(f'{r6s(n)} AS {n}' for n in 'abcde')} FROM co")
def solver_coefficients(spark, d):
    rows = schedule.solver_coefficients(10, 5.0)
    return spark.createDataFrame([tuple(float(v) for v in r.values()) for r in rows], ", ".join(f"{k} double" for k in rows[0])).select(*(r6(F.col(k)).alias(k) for k in rows[0]))


@query(f"""WITH RECURSIVE {VECTORS}, {_SECOND},
t(vec_id, k, x, m0, m1, was) AS (SELECT vec_id, 0, e[1], 0.0::DOUBLE, 0.0::DOUBLE, e[1] FROM vectors
  UNION ALL SELECT vec_id, k + 1, a * fixed + b * now + c * (m0 - now), now, m0, fixed FROM (
    SELECT vec_id, k, m0, now, a, b, c, CASE WHEN k > 0 THEN pa * was + pb * m0 + pe * (now - m0) + pd * (m1 - m0) ELSE x END AS fixed FROM (
      SELECT t.vec_id, t.k, t.x, t.m0, t.m1, t.was, t.x - n.s * (t.x - 0.25) AS now, n.a, n.b, n.c, coalesce(p.a, 0) AS pa, coalesce(p.b, 0) AS pb, coalesce(p.d, 0) AS pd, coalesce(p.e, 0) AS pe
      FROM t JOIN co n ON n.k = t.k LEFT JOIN co p ON p.k = t.k - 1)))
SELECT vec_id, {r6s('x')} AS x FROM t WHERE k = 10""")
def solver_trajectory(spark, d):
    """Multistep solver with corrector, folded over its coefficient table."""
    c = schedule.solver_coefficients(10, 5.0)
    return vectors(spark, d).select("vec_id", r6(schedule.solve(e(0), _flow, c)).alias("x"))


def _values(rows: list[dict[str, float]], names: list[str]) -> str:
    return ", ".join("(" + ", ".join([str(int(r["step"])), *(f"{float(r[n])!r}::DOUBLE" for n in names)]) + ")" for r in rows)


_THIRD = schedule.solver_coefficients(12, 5.0, order=3)


@query(f"""WITH RECURSIVE {VECTORS}, co(k, s, a, b, c, c2, d, d2, e) AS (VALUES {_values(_THIRD, ['sigma', 'a', 'b', 'c', 'c2', 'd', 'd2', 'e'])}),
t(vec_id, k, x, m0, m1, m2, was) AS (SELECT vec_id, 0, e[1], 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, e[1] FROM vectors
  UNION ALL SELECT vec_id, k + 1, a * fixed + b * now + c * (m0 - now) + c2 * (m1 - now), now, m0, m1, fixed FROM (
    SELECT vec_id, k, m0, m1, now, a, b, c, c2, CASE WHEN k > 0 THEN pa * was + pb * m0 + pe * (now - m0) + pd * (m1 - m0) + pd2 * (m2 - m0) ELSE x END AS fixed FROM (
      SELECT t.*, t.x - n.s * (t.x - 0.25) AS now, n.a, n.b, n.c, n.c2, coalesce(p.a, 0) AS pa, coalesce(p.b, 0) AS pb, coalesce(p.d, 0) AS pd, coalesce(p.d2, 0) AS pd2, coalesce(p.e, 0) AS pe
      FROM t JOIN co n ON n.k = t.k LEFT JOIN co p ON p.k = t.k - 1)))
SELECT vec_id, {r6s('x')} AS x FROM t WHERE k = 12""")
def solver_high_order(spark, d):
    """Order 3 of the solver with corrector. The SQL takes the coefficients as they are, which tests check by exact
    solutions, and walks the steps."""
    return vectors(spark, d).select("vec_id", r6(schedule.solve(e(0), _flow, _THIRD)).alias("x"))


def _walk(name: str, steps: int, noise: str = "0") -> str:
    """CTE of a predictor-only run: state x and the last two outputs."""
    return f"""{name}(vec_id, k, x, m1, m2) AS (SELECT vec_id, 0, e[1], 0.0::DOUBLE, 0.0::DOUBLE FROM vectors
  UNION ALL SELECT vec_id, k + 1, a * x + b0 * now + b1 * m1 + b2 * m2 + z * {noise}, now, m1 FROM (
    SELECT t.vec_id, t.k, t.x, t.m1, t.m2, t.x - n.s * (t.x - 0.25) AS now, n.a, n.b0, n.b1, n.b2, n.z FROM {name} t JOIN {name}_c n ON n.k = t.k))"""


def _normal(k: str) -> str:
    return f"sqrt(-2 * ln(1 - {_u('vec_id', k, chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {_u('vec_id', k, chr(39) + 'a' + chr(39))})"


_RUNS = {"x": schedule.multistep_coefficients(20, 5.0, order=3), "noisy": schedule.multistep_coefficients(20, 5.0, "sde-dpmsolver++", middle="heun")}
_RUNS |= {"other": schedule.multistep_coefficients(20, 5.0, "dpmsolver", last=0.01), "other_noisy": schedule.multistep_coefficients(20, 5.0, "sde-dpmsolver", last=0.01)}
_NAMES = ["sigma", "a", "b0", "b1", "b2", "z"]


def _runs() -> str:
    tables = ", ".join(f"{n}_c(k, s, a, b0, b1, b2, z) AS (VALUES {_values(c, _NAMES)})" for n, c in _RUNS.items())
    walks = ", ".join(_walk(n, 20, _normal("k") if "noisy" in n else "0").replace("t.x - n.s *", "t.x - (1 - n.s) *" if n.startswith("other") else "t.x - n.s *") for n in _RUNS)
    return f"{tables}, {walks}"


@query(f"""WITH RECURSIVE {VECTORS}, {_runs()} SELECT vec_id, {', '.join(f'{r6s(f"{n}.x")} AS {n}' for n in _RUNS)}
FROM x {' '.join(f'JOIN {n} USING (vec_id, k)' for n in list(_RUNS)[1:])} WHERE k = 20""")
def solver_multistep(spark, d):
    """Predictor-only solver in all four algorithms: order 3, order 2 with noise (hashed), and both with noise prediction."""
    draw = lambda k: R.normal(F.col("vec_id"), k)
    columns = {n: schedule.solve_multistep(e(0), _flow, c, data=not n.startswith("other"), noise=draw if "noisy" in n else None) for n, c in _RUNS.items()}
    return vectors(spark, d).select("vec_id", *(r6(c).alias(n) for n, c in columns.items()))


# --- noise at given steps ------------------------------------------------------------------------------------------
_SIGMA = "(5.0 * s / (1 + 4.0 * s))"


@query(f"""WITH {VECTORS}, l AS (SELECT CAST(i AS BIGINT) AS step, {_TOP} * (1 - i / 400.0) AS s FROM range(400) r(i)), g AS (SELECT step, {_SIGMA} AS sigma, CAST(trunc({_SIGMA} * 1000) AS BIGINT) AS timestep FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY step) AS k, count(*) OVER (PARTITION BY timestep) AS n FROM g), t AS (SELECT timestep, sigma FROM k WHERE k = least(2, n))
SELECT vec_id, t.timestep, {r6s('t.sigma')} AS sigma, {r6s('(1 - t.sigma) * e[1] + t.sigma * e[2]')} AS noisy FROM vectors JOIN g ON g.step = vec_id % 400 JOIN t ON t.timestep = g.timestep""")
def noise_at_steps(spark, d):
    """Noise of each sample's own timestep; the first steps share timesteps, of which the second counts."""
    steps = schedule.noise_schedule(spark, 400, 5.0)
    wanted = vectors(spark, d).withColumn("step", F.col("vec_id") % 400).join(F.broadcast(steps.select("step", "timestep")), "step")  # 400 rows
    return schedule.noisy_at(wanted.drop("step"), steps, e(0), e(1)).select("vec_id", "timestep", r6(F.col("sigma")).alias("sigma"), r6(F.col("noisy")).alias("noisy"))


@query(f"""WITH l AS (SELECT CAST(i AS BIGINT) AS step, {_TOP} * (1 - i / 8.0) AS s FROM range(8) r(i)), c AS (SELECT 'count' AS kind, step, {_SIGMA} AS sigma, CAST(trunc({_SIGMA} * 1000) AS BIGINT) AS timestep FROM l),
o AS (SELECT * FROM (VALUES ('timesteps', 0, 0.9, 900), ('timesteps', 1, 0.5, 500), ('timesteps', 2, 0.125, 125), ('sigmas', 0, 0.75, 750), ('sigmas', 1, 0.25, 250)) v(kind, step, sigma, timestep))
SELECT kind, step, {r6s('sigma')} AS sigma, timestep FROM (SELECT * FROM c UNION ALL SELECT kind, CAST(step AS BIGINT), CAST(sigma AS DOUBLE), CAST(timestep AS BIGINT) FROM o)""")
def step_selector(spark, d):
    """Steps of a run by count, by custom timesteps and by custom levels."""
    chosen = {"count": schedule.selected_steps(5.0, 8), "timesteps": schedule.selected_steps(5.0, timesteps=[900, 500, 125]), "sigmas": schedule.selected_steps(5.0, sigmas=[0.75, 0.25])}
    rows = [(kind, k, float(s), t) for kind, steps in chosen.items() for k, (s, t) in enumerate(steps)]
    return spark.createDataFrame(rows, "kind string, step long, sigma double, timestep long").withColumn("sigma", r6(F.col("sigma")))


# --- colour --------------------------------------------------------------------------------------------------------
def _cut(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


_GREY = "(0.2989 * r + 0.587 * g + 0.114 * b)"


def _level(k: int) -> str:
    """One of the four changes, chosen by the order's element k, for all pixels."""
    hue = {c: f"(CASE WHEN top = low THEN top ELSE top - (top - low) * {_cut(f'least(pmod_{c}, 4 - pmod_{c})')} END)" for c in "rgb"}
    place = {"r": 5, "g": 3, "b": 1}
    turned = ", ".join(f"(({place[c]} + sector + 6 * hue) - 6 * floor(({place[c]} + sector + 6 * hue) / 6)) AS pmod_{c}" for c in "rgb")
    changed = ", ".join(f"CASE ord[{k}] WHEN 0 THEN {_cut(f'{c} * bright')} WHEN 1 THEN {_cut(f'{c} * contr + mean * (1 - contr)')} WHEN 2 THEN {_cut(f'{c} * satur + {_GREY} * (1 - satur)')} ELSE {hue[c]} END AS {c}" for c in "rgb")
    return f"""a{k} AS (SELECT *, avg({_GREY}) OVER (PARTITION BY vec_id) AS mean, greatest(r, g, b) AS top, least(r, g, b) AS low FROM s{k - 1}),
b{k} AS (SELECT *, CASE WHEN top = low THEN 0.0 WHEN top = r THEN (g - b) / (top - low) WHEN top = g THEN 2 + (b - r) / (top - low) ELSE 4 + (r - g) / (top - low) END AS sector FROM a{k}),
c{k} AS (SELECT *, {turned} FROM b{k}),
s{k} AS (SELECT vec_id, i, ord, bright, contr, satur, hue, {changed} FROM c{k})"""


def _factor(name: str, low: float, wide: float) -> str:
    q = chr(39)
    return f"{low} + {_u('vec_id', q + name + q)} * {wide}"


@query(f"""WITH {VECTORS}, o AS (SELECT vec_id, list(n ORDER BY md5(concat_ws('_', '', concat_ws('_', vec_id, n)))) AS ord FROM (SELECT vec_id, unnest(range(4)) AS n FROM embeddings) GROUP BY 1),
f AS (SELECT vec_id, e, ord, {_factor('brightness', 0.8, 0.4)} AS bright, {_factor('contrast', 0.8, 0.4)} AS contr, {_factor('saturation', 0.8, 0.4)} AS satur, {_factor('hue', -0.1, 0.2)} AS hue, unnest(range(16)) AS i FROM vectors JOIN o USING (vec_id)),
s0 AS (SELECT vec_id, i, ord, bright, contr, satur, hue, {_cut('(e[i + 1] + 1) / 2')} AS r, {_cut('(e[i + 17] + 1) / 2')} AS g, {_cut('(e[i + 33] + 1) / 2')} AS b FROM f), {', '.join(map(_level, (1, 2, 3, 4)))}
SELECT vec_id, CAST(i AS INTEGER) AS i, {', '.join(f"{r6s(f'{c} * 2 - 1')} AS {c}" for c in 'rgb')} FROM s4""")
def color_jitter(spark, d):
    """Brightness, contrast, saturation and hue in a hashed order; elements 0-15, 16-31 and 32-47 are the planes of a
    4x4 image."""
    k = F.col("vec_id")
    planes = [F.transform(F.slice("e", 1 + 16 * c, 16), lambda v: F.least(F.greatest((v.cast("double") + 1) / 2, F.lit(0.0)), F.lit(1.0))) for c in range(3)]
    factors = {n: sampling.jitter(0.8, 1.2, k, n) for n in ("brightness", "contrast", "saturation")} | {"hue": sampling.jitter(-0.1, 0.1, k, "hue")}
    order = sampling.permute(F.array(*(F.lit(n) for n in range(4))), k)
    rows = vectors(spark, d).select("vec_id", F.posexplode_outer(I.jitter(I.rgb(*planes), order, factors)).alias("i", "p"))
    return rows.select("vec_id", "i", *(r6(F.col(f"p.{c}") * 2 - 1).alias(c) for c in "rgb"))


@query(f"""WITH {_PAIR}, w AS (SELECT i, j, exp(-((i - 3) * (i - 3) + (j - 3) * (j - 3)) / 4.5) AS w FROM range(7) a(i), range(7) b(j)), n AS (SELECT i, j, w / sum(w) OVER () AS w FROM w),
o AS (SELECT * FROM range(2) a(oy), range(2) b(ox)),
x AS (SELECT vec_id, oy, ox, w, p[(oy + i) * 8 + ox + j + 1] AS a, t[(oy + i) * 8 + ox + j + 1] AS b FROM im, n, o),
m AS (SELECT vec_id, oy, ox, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM x GROUP BY 1, 2, 3)
SELECT vec_id, {r6s('avg((2 * ma * mb + 0.0001) * (2 * (ab - ma * mb) + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (aa - ma * ma + bb - mb * mb + 0.0009)))')} AS ssim FROM m GROUP BY 1""")
def ssim(spark, d):
    """Sliding Gaussian windows (7x7 on 8x8 images)."""
    return metrics.ssim(_images(spark, d), "p", "t", 8, 8, window=7).select("vec_id", r6(F.col("ssim")).alias("ssim"))


def _unescaped(x: str) -> str:
    """The entities that the pages hold, the ampersand last, as one pass over the text would do."""
    for name, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("nbsp", "\xa0"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


@query(f"SELECT page_id, trim(nfc_normalize({_unescaped(_unescaped('html'))}), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM pages")
def text_basic_clean(spark, d):
    from ..functions import text as X

    return table(spark, d, "pages").select("page_id", X.basic_clean(F.col("html")).alias("clean"))
