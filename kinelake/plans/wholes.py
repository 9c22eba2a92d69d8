"""Queries of whole state and action vectors: embeddings stand for states and actions of two arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rotation as Q
from ..operators import components
from .reference import _MUL, _q
from .registry import query
from .standins import VECTORS, e, r6, r6s, vectors

#: made-up configuration of statistics
BLOCK = {
    "q01": {
        "proprio_left_ee_xyz": [-1.5, -1.25, -1.0], "proprio_right_ee_xyz": [-1.75, -1.5, -0.5], "gripper_pos": [-2.0], "gripper_action": [-0.75],
        "action_left_ee_xyz": [-0.5, -0.625, -0.75], "action_right_ee_xyz": [-0.25, -0.5, -1.0], "action_left_ee_axisangle": [-1.0, -1.125, -1.25], "action_right_ee_axisangle": [-0.875, -0.75, -0.625],
    },
    "q99": {
        "proprio_left_ee_xyz": [1.25, 1.5, 1.75], "proprio_right_ee_xyz": [1.0, 0.75, 1.5], "gripper_pos": [1.75], "gripper_action": [0.75],
        "action_left_ee_xyz": [0.5, 0.75, 1.0], "action_right_ee_xyz": [0.5, 0.25, 0.75], "action_left_ee_axisangle": [1.5, 1.25, 1.0], "action_right_ee_axisangle": [0.625, 0.75, 0.875],
    },
}
STATS = components.Statistics.parse(BLOCK)
_ONE_ARM = components.Statistics.parse({side: {k: v for k, v in block.items() if "right" not in k} for side, block in BLOCK.items()})
#: first element (from 0) of position, rotation vector, gripper of both arms in the state and in the later action
_STATE = {"left": (0, 3, 6), "right": (7, 10, 13)}


def _scaled(x: str, key: str, k: int) -> str:
    low, high = BLOCK["q01"][key][k], BLOCK["q99"][key][k]
    return r6s(f"2 * ({x} - {low}) / greatest({high} - {low}, 1e-6) - 1")


def _state_sql(arm: str) -> list[str]:
    p, _, g = _STATE[arm]
    return [_scaled(f"e[{p + k + 1}]", f"proprio_{arm}_ee_xyz", k) for k in range(3)] + [r6s(f"{arm}[{k}]") for k in range(1, 5)] + [_scaled(f"e[{g + 1}]", "gripper_pos", 0)]


def _canon(q: str) -> str:
    return f"CASE WHEN ({q})[1] < 0 THEN list_transform({q}, lambda x: -x) ELSE {q} END"


@query(f"""WITH {VECTORS}, q AS (SELECT vec_id, episode, e, {_q('e', 4)} AS l, {_q('e', 11)} AS r FROM vectors),
c AS (SELECT vec_id, episode, e, {_canon('l')} AS "left", {_canon('r')} AS "right" FROM q)
SELECT vec_id, CAST(unnest(range(16)) AS INTEGER) AS axis, unnest([{', '.join(x.replace('left[', '"left"[') for x in _state_sql('left'))},
  {', '.join(f'CASE WHEN episode % 2 = 0 THEN {x.replace("right[", chr(34) + "right" + chr(34) + "[")} ELSE 0.0 END' for x in _state_sql('right'))}]) AS state,
  unnest(list_transform(range(16), lambda k: CASE WHEN k < 8 OR episode % 2 = 0 THEN 1.0 ELSE 0.0 END)) AS mask FROM c""")
def state_vector(spark, d):
    """16-wide states; episodes with odd numbers have no right arm."""
    rows = vectors(spark, d).select("vec_id", "episode", "e")
    for arm, (_, r, _) in _STATE.items():
        rows, q = Q.staged(rows, f"_{arm}", Q.from_rotvec(Q.vector(F.col("e"), r)))
        rows, _ = Q.staged(rows, f"_c{arm}", Q.canonical(q))
    parts = {}
    for arm, (p, _, g) in _STATE.items():
        there = F.lit(True) if arm == "left" else F.col("episode") % 2 == 0
        parts[f"{arm}_ee_pos"] = F.when(there, F.slice("e", p + 1, 3))
        parts[f"{arm}_ee_quat"] = F.when(there, F.array(*(F.col(f"_c{arm}{k}") for k in range(4))))
        parts[f"{arm}_gripper_pos"] = F.when(there, F.slice("e", g + 1, 1))
    values, mask = components.state_vector(parts, STATS)
    long = rows.select("vec_id", F.posexplode_outer(F.arrays_zip(values.alias("v"), mask.alias("m"))).alias("axis", "x"))
    return long.select("vec_id", "axis", r6(F.col("x.v")).alias("state"), F.col("x.m").alias("mask"))


def _turn_sql(arm: str) -> str:
    """CTE steps of the delta rotation of one arm: action element 15.. (20..) against the state's rotation."""
    r = _STATE[arm][1]
    at = {"left": 18, "right": 25}[arm]
    return f"""{arm}_p AS (SELECT vec_id, {_q('later', at)} AS a, {_q('e', r + 1)} AS p FROM pairs),
{arm}_b AS (SELECT vec_id, a, [p[1], -p[2], -p[3], -p[4]] AS b FROM {arm}_p), {arm}_m AS (SELECT vec_id, {_MUL} AS q FROM {arm}_b),
{arm}_c AS (SELECT vec_id, {_canon('q')} AS q FROM {arm}_m), {arm}_n AS (SELECT vec_id, q, sqrt(q[2]*q[2]+q[3]*q[3]+q[4]*q[4]) AS n FROM {arm}_c),
{arm}_t AS (SELECT vec_id, list_transform(q[2:4], lambda x: x * CASE WHEN n < 1e-12 THEN 2.0 ELSE 2 * atan2(n, q[1]) / n END) AS t FROM {arm}_n)"""


def _delta_sql(arm: str) -> list[str]:
    p, _, g = _STATE[arm]
    at = {"left": 15, "right": 22}[arm]
    return [_scaled(f"later[{at + k}] - e[{p + k + 1}]", f"action_{arm}_ee_xyz", k) for k in range(3)] + [_scaled(f"{arm}_t.t[{k + 1}]", f"action_{arm}_ee_axisangle", k) for k in range(3)] + [_scaled(f"grip[{g + 1}] - e[{g + 1}]", "gripper_action", 0)]


def _raw_sql(arm: str) -> list[str]:
    at = {"left": 30, "right": 37}[arm]
    return [_scaled(f"e[{at + k}]", f"action_{arm}_ee_xyz", k) for k in range(3)] + [_scaled(f"e[{at + 3 + k}]", f"action_{arm}_ee_axisangle", k) for k in range(3)] + [r6s(f"-e[{at + 6}]")]


@query(f"""WITH {VECTORS}, pairs AS (SELECT * FROM (SELECT *, lead(e, 3) OVER w AS later, lead(e, 4) OVER w AS grip FROM vectors WINDOW w AS (PARTITION BY episode ORDER BY frame)) WHERE grip IS NOT NULL),
{_turn_sql('left')}, {_turn_sql('right')},
w AS (SELECT pairs.vec_id, vec_id % 3 = 0 AS raw, CASE WHEN vec_id % 3 = 0 THEN vec_id % 2 = 0 ELSE episode % 2 = 0 END AS two,
  [{', '.join(_delta_sql('left') + _delta_sql('right'))}] AS delta, [{', '.join(_raw_sql('left') + _raw_sql('right'))}] AS own FROM pairs JOIN left_t USING (vec_id) JOIN right_t USING (vec_id)),
l AS (SELECT vec_id, two, unnest(range(14)) AS k, unnest(CASE WHEN raw THEN own ELSE delta END) AS v FROM w)
SELECT vec_id, CAST(k AS INTEGER) AS axis, CASE WHEN k < 7 OR two THEN v ELSE 0.0 END AS action, CASE WHEN k < 7 OR two THEN 1.0 ELSE 0.0 END AS mask FROM l""")
def action_vector(spark, d):
    """14-wide actions. Every third row brings raw actions, of one or two arms, which are taken as they are; for the
    others the differences of states and actions are formed, of the right arm where the episode has one."""
    w = Window.partitionBy("episode").orderBy("frame")
    rows = vectors(spark, d).withColumns({"later": F.lead("e", 3).over(w), "grip": F.lead("e", 4).over(w)}).filter("grip is not null")
    raw = F.when(F.col("vec_id") % 3 == 0, F.slice("e", 30, F.when(F.col("vec_id") % 2 == 0, 14).otherwise(7)))
    rows = rows.withColumn("actions", F.when(raw.isNotNull(), F.create_map(F.lit("raw_actions"), raw)))
    rows = Q.with_delta(rows, Q.vector(F.col("later"), 17), Q.vector(F.col("e"), 3), "left_turn")
    rows = Q.with_delta(rows, Q.vector(F.col("later"), 24), Q.vector(F.col("e"), 10), "right_turn")
    parts = {}
    for arm, (p, _, g) in _STATE.items():
        there = F.lit(True) if arm == "left" else F.col("episode") % 2 == 0
        at = 14 if arm == "left" else 21
        parts[f"{arm}_pos"] = F.when(there, F.array(*(e(at + k, "later") - e(p + k) for k in range(3))))
        parts[f"{arm}_turn"] = F.when(there, F.col(f"{arm}_turn"))
        parts[f"{arm}_grip"] = F.when(there, F.array(e(g, "grip") - e(g)))
    own, own_mask = components.raw_action_vector(F.try_element_at("actions", F.lit("raw_actions")), STATS)
    delta, delta_mask = components.delta_action_vector(parts, STATS)
    raw_path = components.has_raw(F.col("actions"))
    both = F.arrays_zip(F.when(raw_path, own).otherwise(delta).alias("v"), F.when(raw_path, own_mask).otherwise(delta_mask).alias("m"))
    long = rows.select("vec_id", F.posexplode_outer(both).alias("axis", "x"))
    return long.select("vec_id", "axis", r6(F.col("x.v")).alias("action"), F.col("x.m").alias("mask"))


_LOW, _HIGH, _ALOW, _AHIGH, _ = components.server_bounds(STATS)
_LOW1, _HIGH1, _ALOW1, _AHIGH1, _ = components.server_bounds(_ONE_ARM)


def _list(values) -> str:
    return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"


@query(f"""WITH {VECTORS}, l AS (SELECT vec_id, e, unnest(range(1, 17)) AS k FROM vectors)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS axis, {r6s(f'2 * (e[k] - {_list(_LOW)}[k]) / ({_list(_HIGH)}[k] - {_list(_LOW)}[k]) - 1')} AS state,
  CASE WHEN k > 8 THEN 0.0 ELSE {r6s(f'2 * (e[k] - {_list(_LOW1)}[k]) / ({_list(_HIGH1)}[k] - {_list(_LOW1)}[k]) - 1')} END AS one_arm_state,
  CASE WHEN k <= 14 THEN {r6s(f'(e[k + 16] + 1) / 2 * ({_list(_AHIGH)}[k] - {_list(_ALOW)}[k]) + {_list(_ALOW)}[k]')} END AS action,
  CASE WHEN k <= 7 THEN {r6s(f'CASE WHEN k = 7 THEN -1 ELSE 1 END * ((e[k + 16] + 1) / 2 * ({_list(_AHIGH1)}[k] - {_list(_ALOW1)}[k]) + {_list(_ALOW1)}[k])')} END AS one_arm_action FROM l""")
def server_roundtrip(spark, d):
    """What a prediction server does with a state and an action, with statistics of two arms and of one."""
    state, action = F.slice("e", 1, 16), F.slice("e", 17, 14)
    columns = {"state": components.server_state(state, STATS), "one_arm_state": components.server_state(state, _ONE_ARM), "action": components.server_action(action, STATS), "one_arm_action": components.server_action(action, _ONE_ARM)}
    long = vectors(spark, d).select("vec_id", F.posexplode_outer(F.arrays_zip(*(c.alias(n) for n, c in columns.items()))).alias("axis", "x"))
    return long.select("vec_id", "axis", *(r6(F.col(f"x.{n}")).alias(n) for n in columns))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / 2.5, 6) + 0.0 AS openness FROM embeddings")
def gripper_openness(spark, d):
    return vectors(spark, d).select("vec_id", r6(components.gripper_openness(e(0), F.lit(2.5))).alias("openness"))
