"""Whole state and action vectors from components by arm: normalised, masked, in a fixed layout.

The statistics are a configuration of a few numbers by key, so they enter as literals. A component that a row lacks is
zeros with mask 0; one that a row has and the statistics lack is an error, raised where such a row is met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectors import denormalise, masked, normalise, normalise_unguarded

ARMS = ("left", "right")
STATE_WIDTH, ACTION_WIDTH, ARM_ACTION = 16, 14, 7


@dataclass(frozen=True)
class Statistics:
    """q01 and q99 of each key."""

    bounds: dict[str, tuple[tuple[float, ...], tuple[float, ...]]]

    @classmethod
    def parse(cls, block: dict) -> Statistics:
        """From {q01: {key: numbers}, q99: {key: numbers}}: each key of q01 must be in q99 too, with as many numbers."""
        low, high = block.get("q01"), block.get("q99")
        if not isinstance(low, dict) or not isinstance(high, dict):
            raise ValueError("statistics need q01 and q99")
        out = {}
        for key, values in low.items():
            if key not in high:
                raise ValueError(f"{key} is in q01 but not in q99")
            pair = tuple(tuple(float(v) for v in (x if isinstance(x, list | tuple) else [x])) for x in (values, high[key]))
            if len(pair[0]) != len(pair[1]):
                raise ValueError(f"q01 and q99 of {key} differ in width")
            out[key] = pair
        return cls(out)

    def normalised(self, vector: Column, key: str, width: int) -> Column:
        """The vector scaled by the key's bounds; NULL stays NULL."""
        if key not in self.bounds:
            return F.when(vector.isNotNull(), F.raise_error(F.lit(f"no statistics of {key}")).cast("array<double>"))
        low, high = self.bounds[key]
        return F.when(vector.isNotNull(), F.array(*(normalise(F.get(vector, F.lit(k)).cast("double"), F.lit(low[k]), F.lit(high[k])) for k in range(width))))


def joined(parts: list[tuple[Column, int]]) -> tuple[Column, Column]:
    """(values, mask) of the parts (array, width) one after another."""
    values = F.concat(*(F.coalesce(v, F.array_repeat(F.lit(0.0), w)) for v, w in parts))
    mask = F.concat(*(F.array_repeat(F.when(v.isNull(), 0.0).otherwise(1.0), w) for v, w in parts))
    return masked(values, mask), mask


def _signed(vector: Column, inverse: bool) -> Column:
    return F.transform(vector, lambda x: -x) if inverse else vector


def state_vector(parts: dict[str, Column], stats: Statistics, inverse_gripper: bool = False) -> tuple[Column, Column]:
    """16 values and their mask: for each arm position (3), unit quaternion with w >= 0 as it is (4) and gripper (1).
    ``parts`` has the arrays {arm}_ee_pos, {arm}_ee_quat and {arm}_gripper_pos, NULL where absent."""
    out = []
    for arm in ARMS:
        grip = stats.normalised(parts[f"{arm}_gripper_pos"], "gripper_pos", 1)
        out += [(stats.normalised(parts[f"{arm}_ee_pos"], f"proprio_{arm}_ee_xyz", 3), 3), (parts[f"{arm}_ee_quat"], 4), (_signed(grip, inverse_gripper), 1)]
    return joined(out)


def has_raw(actions: Column) -> Column:
    """Whether a map of actions brings its own relative actions."""
    return F.coalesce(F.map_contains_key(actions, F.lit("raw_actions")), F.lit(False))


def raw_action_vector(raw: Column, stats: Statistics) -> tuple[Column, Column]:
    """14 values and their mask from a raw action of 7 numbers for each arm that it has: position (3), rotation (3) and
    the negated gripper, which is not scaled."""
    out = []
    for k, arm in enumerate(ARMS):
        own = F.when(F.size(raw) >= ARM_ACTION * (k + 1), F.slice(raw, ARM_ACTION * k + 1, ARM_ACTION))
        part = lambda a, n, own=own: F.when(own.isNotNull(), F.slice(own, a + 1, n))
        out += [(stats.normalised(part(0, 3), f"action_{arm}_ee_xyz", 3), 3), (stats.normalised(part(3, 3), f"action_{arm}_ee_axisangle", 3), 3), (_signed(part(6, 1).cast("array<double>"), True), 1)]
    return joined(out)


def delta_action_vector(parts: dict[str, Column], stats: Statistics, inverse_gripper: bool = False) -> tuple[Column, Column]:
    """14 values and their mask from differences of state and action: ``parts`` has the arrays {arm}_pos (3), {arm}_turn
    (rotation vector of action times inverse state, 3) and {arm}_grip (later minus present opening, 1)."""
    out = []
    for arm in ARMS:
        grip = stats.normalised(parts[f"{arm}_grip"], "gripper_action", 1)
        out += [(stats.normalised(parts[f"{arm}_pos"], f"action_{arm}_ee_xyz", 3), 3), (stats.normalised(parts[f"{arm}_turn"], f"action_{arm}_ee_axisangle", 3), 3), (_signed(grip, inverse_gripper), 1)]
    return joined(out)


def server_bounds(stats: Statistics) -> tuple[list[float], list[float], list[float], list[float], bool]:
    """Bounds of the whole state (16) and action (7 or 14), and whether there is a right arm. Quaternions, and a right arm
    without statistics, have -1 and 1, which leave a number as it is."""
    both = f"proprio_{ARMS[1]}_ee_xyz" in stats.bounds
    state: tuple[list[float], list[float]] = ([], [])
    action: tuple[list[float], list[float]] = ([], [])
    for arm in ARMS[: 1 + both]:
        for side, unit in ((0, -1.0), (1, 1.0)):
            own = lambda key, side=side: list(stats.bounds[key][side])
            state[side].extend([*own(f"proprio_{arm}_ee_xyz"), *[unit] * 4, *own("gripper_pos")])
            action[side].extend([*own(f"action_{arm}_ee_xyz"), *own(f"action_{arm}_ee_axisangle"), *own("gripper_action")])
    for side, unit in ((0, -1.0), (1, 1.0)):
        state[side].extend([unit] * (STATE_WIDTH - len(state[side])))
    return *state, *action, both


def server_state(state: Column, stats: Statistics) -> Column:
    """A request's state, scaled without a floor of the range; a right arm without statistics is zeros."""
    low, high, _, _, both = server_bounds(stats)
    return F.array(*(normalise_unguarded(F.get(state, F.lit(k)).cast("double"), F.lit(low[k]), F.lit(high[k])) if both or k < STATE_WIDTH // 2 else F.lit(0.0) for k in range(STATE_WIDTH)))


def server_action(action: Column, stats: Statistics) -> Column:
    """A predicted action scaled back; with one arm the sign of its gripper turns."""
    _, _, low, high, both = server_bounds(stats)
    back = [denormalise(F.get(action, F.lit(k)).cast("double"), F.lit(low[k]), F.lit(high[k])) for k in range(len(low))]
    return F.array(*(-v if k == ARM_ACTION - 1 and not both else v for k, v in enumerate(back)))


def gripper_openness(joint: Column, most: Column) -> Column:
    return joint / most
