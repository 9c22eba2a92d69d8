"""Noise schedules and the multistep solver: coefficients depend on the levels alone, so they are a small table made on
the driver from ``steps`` numbers; samples are folded over the coefficient array inside one expression, without
joins or recursion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = float(np.float32(0.999))  # largest level as the stored single precision number
TRAIN_STEPS = 1000


def levels(steps: int, shift: float, low: float = 0.0) -> list[float]:
    """Levels of a schedule: evenly spaced from the top, the last one left out, shifted; 0 at the end."""
    out = []
    for k in range(steps):
        s = TOP + (low - TOP) * k / steps
        out.append(shift * s / (1 + (shift - 1) * s))
    return [*out, 0.0]


def dynamic_shift(t: Column, mu: float, sigma: float = 1.0) -> Column:
    return math.exp(mu) / (math.exp(mu) + F.pow(1 / t - 1, F.lit(sigma)))


def noise_schedule(spark: SparkSession, steps: int, shift: float) -> DataFrame:
    """(step, sigma, timestep) with the timestep cut to an integer."""
    s = F.lit(TOP) + (F.lit(0.0) - F.lit(TOP)) * F.col("step") / steps
    rows = spark.range(steps).select(F.col("id").alias("step")).withColumn("sigma", shift * s / (1 + (shift - 1) * s))
    return rows.withColumn("timestep", (F.col("sigma") * TRAIN_STEPS).cast("long"))


def alpha_sigma(level: Column) -> tuple[Column, Column]:
    """Weights of the sample and of the noise at a level."""
    return 1 - level, level


def timestep(level: Column) -> Column:
    return level * TRAIN_STEPS


def selected_steps(shift: float, count: int | None = None, timesteps: list[int] | None = None, sigmas: list[float] | None = None) -> list[tuple[float, int]]:
    """(sigma, timestep) of a run: by count, or by custom timesteps or sigmas, of which only one may be given."""
    if timesteps is not None and sigmas is not None:
        raise ValueError("give timesteps or sigmas, not both")
    if timesteps is not None:
        return [(t / TRAIN_STEPS, int(t)) for t in timesteps]
    if sigmas is None:
        sigmas = levels(count or 0, shift)[:-1]
    return [(s, int(s * TRAIN_STEPS)) for s in sigmas]


def noisy_at(samples: DataFrame, schedule: DataFrame, x: Column, noise: Column) -> DataFrame:
    """Samples with the noise of their ``timestep``: level by the schedule (step, sigma, timestep), of several steps with
    one timestep the second. The schedule is a few dozen rows; a timestep that it lacks is an error."""
    w = Window.partitionBy("timestep").orderBy("step")
    ranked = schedule.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("timestep"))})
    taken = ranked.filter("_k = least(2, _n)").select("timestep", F.col("sigma").alias("_sigma"))
    found = samples.join(F.broadcast(taken), "timestep", "left")
    level = F.coalesce("_sigma", F.raise_error(F.concat(F.lit("no step has timestep "), F.col("timestep").cast("string"))).cast("double"))
    found = found.withColumn("_sigma", level)
    a, s = alpha_sigma(F.col("_sigma"))
    return found.withColumn("noisy", a * x + s * noise).withColumnRenamed("_sigma", "sigma")


def _log_ratio(level: float) -> float:
    """ln((1 - level) / level), infinite at level 0."""
    return math.log(1 - level) - math.log(level) if level > 0 else math.inf


def _moments(h: float, count: int, data: bool) -> list[float]:
    """Integrals over u in 0..1 of h exp(-h(1-u)) u^k, or with exp(+h(1-u)) for noise prediction, for k < count: what a
    model output that is a polynomial in the log ratio contributes to one exact step. Each follows from the one before."""
    if not math.isfinite(h):
        if not data or count > 1:
            raise ValueError("a last level of 0 needs data prediction of order 1 in the last step")
        return [1.0]
    out = [-math.expm1(-h) if data else math.expm1(h)]
    for k in range(1, count):
        out.append(1 - k / h * out[-1] if data else k / h * out[-1] - 1)
    return out


def solver_coefficients(steps: int, shift: float, kind: str = "bh2", order: int = 2, data: bool = True, last: float = 0.0) -> list[dict[str, float]]:
    """Coefficients of each step. Predictor: x' = a x + b m0 + c (m1 - m0) + c2 (m2 - m0) ...; corrector of the step
    before: x = a x_last + b m0 + d (m1 - m0) + d2 (m2 - m0) ... + e (m_now - m0). The weights of the differences match
    the moments of a step up to the order; order 2 of the predictor and order 1 of the corrector take the fixed weight
    of one half, in which alone the kinds differ. ``data`` chooses data or noise prediction (then ``last`` > 0)."""
    if kind not in ("bh1", "bh2"):
        raise ValueError(f"unknown solver kind {kind!r}")
    if order < 1:
        raise ValueError("the order must be at least 1")
    if last == 0 and not data:
        raise ValueError("noise prediction needs a last level above 0")
    s = [*levels(steps, shift)[:-1], last]
    lam = [_log_ratio(x) for x in s]
    names = lambda name: [name, *(f"{name}{i}" for i in range(2, order))]
    out = []
    for k in range(steps):
        own = min(order, k + 1, steps - k)  # warm-up at the start, lower order at the end
        h = lam[k + 1] - lam[k]
        scale = 1 - s[k + 1] if data else -s[k + 1]
        moments = _moments(h, own + 1 if math.isfinite(h) else 1, data)
        half = 0.5 * scale * (h if kind == "bh1" and math.isfinite(h) else moments[0])
        ratio = s[k + 1] / s[k] if data else (1 - s[k + 1]) / (1 - s[k])
        row = {"step": k, "order": own, "sigma": s[k], "a": ratio, "b": scale * moments[0]}
        row |= dict.fromkeys([*names("c"), *names("d")], 0.0) | {"e": half}
        if own > 1:
            places = [(lam[k - i] - lam[k]) / h for i in range(1, own)]
            powers = np.vander([*places, 1.0], own, increasing=True).T
            target = scale * np.array(moments[1:])
            ahead = [half] if own == 2 else np.linalg.solve(powers[:-1, :-1], target[:-1])
            *behind, row["e"] = (float(v) for v in np.linalg.solve(powers, target))
            row |= {n: float(v) / r for n, v, r in zip(names("c"), ahead, places, strict=False)}
            row |= {n: v / r for n, v, r in zip(names("d"), behind, places, strict=False)}
        out.append(row)
    return out


def solve(x: Column, model, coefficients: list[dict[str, float]], data: bool = True) -> Column:
    """Final sample: folds predictor and corrector over the coefficients. ``model(x, sigma)`` gives the predicted
    velocity as a column expression; the data prediction is x - sigma * velocity, the noise prediction
    x - (1 - sigma) * velocity (the sign that the replaced code uses)."""
    names = [n for n in coefficients[0] if n != "order"]
    table = F.array(*(F.struct(*(F.lit(float(r[n])).alias(n) for n in names), *(F.lit(float((coefficients[k - 1] if k else r)[n])).alias("p" + n) for n in names)) for k, r in enumerate(coefficients)))
    ahead, behind = ([n for n in names if n[0] == c] for c in "cd")
    past = [f"m{i}" for i in range(len(ahead) + 1)]
    start = F.struct(x.alias("x"), *(F.lit(0.0).alias(m) for m in past), x.alias("last"))

    def step(state: Column, c: Column) -> Column:
        now = state["x"] - (c["sigma"] if data else 1 - c["sigma"]) * model(state["x"], c["sigma"])
        fixed = c["pa"] * state["last"] + c["pb"] * state["m0"] + c["pe"] * (now - state["m0"])
        for n, m in zip(behind, past[1:], strict=True):
            fixed = fixed + c["p" + n] * (state[m] - state["m0"])
        fixed = F.when(c["step"] > 0, fixed).otherwise(state["x"])
        out = c["a"] * fixed + c["b"] * now
        for n, m in zip(ahead, past, strict=False):
            out = out + c[n] * (state[m] - now)
        return F.struct(out.alias("x"), now.alias("m0"), *(state[a].alias(b) for a, b in zip(past, past[1:], strict=False)), fixed.alias("last"))

    return F.aggregate(table, start, step)["x"]


ALGORITHMS = ("dpmsolver", "dpmsolver++", "sde-dpmsolver", "sde-dpmsolver++")


def multistep_coefficients(steps: int, shift: float, algorithm: str = "dpmsolver++", order: int = 2, middle: str = "midpoint", last: float = 0.0, lower_at_end: bool = True, euler_at_end: bool = False) -> list[dict[str, float]]:
    """Coefficients of the predictor-only solver: x' = a x + b0 m0 + b1 m1 + b2 m2 + z noise. The names ending in ++
    predict data, the others noise (and need ``last`` > 0); those starting with sde add noise (orders 1 and 2). The
    outputs are taken as a polynomial through the last ones; ``middle`` says whether the slope has its exact moment
    ("heun") or half of the constant's ("midpoint"); the curvature has half of its moment, as in the replaced code."""
    data, noisy = algorithm.endswith("++"), algorithm.startswith("sde")
    if algorithm not in ALGORITHMS or middle not in ("midpoint", "heun"):
        raise ValueError(f"unknown algorithm {algorithm!r} or middle {middle!r}")
    if order not in (1, 2, 3) or (noisy and order == 3):
        raise ValueError("orders 1 to 3 are supported, with noise 1 and 2")
    if last == 0 and not data:
        raise ValueError("noise prediction needs a last level above 0")
    s = [*levels(steps, shift)[:-1], last]
    lam = [_log_ratio(x) for x in s]
    short, out = lower_at_end and steps < 15, []
    for k in range(steps):
        own = min(order, k + 1)
        if k == steps - 1 and (euler_at_end or short or last == 0):
            own = 1
        elif k == steps - 2 and short:
            own = min(own, 2)
        h = lam[k + 1] - lam[k]
        moments = _moments(2 * h if data and noisy else h, own, data)
        scale = 1 - s[k + 1] if data else -s[k + 1] * (2 if noisy else 1)
        weights = np.zeros(3)
        unit = np.eye(3)
        weights += moments[0] * unit[0]
        if own > 1:
            r0 = (lam[k] - lam[k - 1]) / h
            slope = (unit[0] - unit[1]) / r0
            if own == 2:
                weights += (moments[1] if middle == "heun" else moments[0] / 2) * slope
            else:
                r1 = (lam[k - 1] - lam[k - 2]) / h
                bend = (slope - (unit[1] - unit[2]) / r1) / (r0 + r1)
                weights += moments[1] * (slope + r0 * bend) + moments[2] / 2 * bend
        ratio = s[k + 1] / s[k] * (math.exp(-h) if noisy else 1) if data else (1 - s[k + 1]) / (1 - s[k])
        spread = s[k + 1] * math.sqrt(-math.expm1(-2 * h) if data else math.expm1(2 * h)) if noisy else 0.0
        out.append({"step": k, "order": own, "sigma": s[k], "a": ratio, **{f"b{i}": float(scale * w) for i, w in enumerate(weights)}, "z": spread})
    return out


def solve_multistep(x: Column, model, coefficients: list[dict[str, float]], data: bool = True, noise=None) -> Column:
    """Final sample of the predictor-only solver; ``noise(step)`` gives a standard normal number for algorithms that
    add noise, for instance a hash of the row's key and the step."""
    names = [n for n in coefficients[0] if n != "order"]
    if noise is None and any(r["z"] for r in coefficients):
        raise ValueError("these coefficients need noise")
    table = F.array(*(F.struct(*(F.lit(float(r[n])).alias(n) for n in names)) for r in coefficients))
    start = F.struct(x.alias("x"), F.lit(0.0).alias("m1"), F.lit(0.0).alias("m2"))

    def step(state: Column, c: Column) -> Column:
        now = state["x"] - (c["sigma"] if data else 1 - c["sigma"]) * model(state["x"], c["sigma"])
        out = c["a"] * state["x"] + c["b0"] * now + c["b1"] * state["m1"] + c["b2"] * state["m2"]
        if noise is not None:
            out = out + c["z"] * noise(c["step"].cast("int"))
        return F.struct(out.alias("x"), now.alias("m1"), state["m1"].alias("m2"))

    return F.aggregate(table, start, step)["x"]


def learning_rate(step: Column, peak: float, warmup: int, steps: int) -> Column:
    """Linear warm-up, then half a cosine to 0."""
    return F.when(step < warmup, peak * step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), peak * 0.5 * (1 + F.cos(math.pi * (step - warmup) / max(1, steps - warmup)))))
