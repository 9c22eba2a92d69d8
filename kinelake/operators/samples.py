"""Training samples: episodes as blocks of frames with a halo, and clips as slices of a block.

Frames are shuffled once, when the blocks are made. A block holds the frames of ``width`` clip starts and those that the
last of these clips reaches into, so every clip is cut out of one row: no frame is unfolded, joined or shuffled for the
clips that share it, and a clip row carries its own slices only, not its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rotation as Q
from ..functions.text import usable_instructions
from ..sources.episodes import camera_code, sorted_views
from .clips import span
from .components import ARMS, Statistics, delta_action_vector, raw_action_vector, state_vector
from .sampling import permute, pick
from .statistics import rows_of, turned

WIDTH = 256


def frame_vectors(episodes: DataFrame, stats: Statistics, action_skip: int = 1, inverse_gripper: bool = False) -> DataFrame:
    """(episode, frame, given, state, state_mask, action, action_mask) of each frame of episodes with ``proprios`` and
    ``actions`` as maps of JSON texts.

    The action of a frame is the way from its state to the action ``action_skip`` - 1 frames later; where an episode
    brings raw actions (``given``) it is the raw action of the frame itself. What is missing is zeros with mask 0.
    """
    later = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))
    own = lambda of, name, width=None: F.coalesce(rows_of(F.col(of)[name], width), F.array().cast("array<array<double>>"))
    made = {"raw": own("actions", "raw_actions")}
    for arm in ARMS:
        made |= {f"{arm}_p": own("proprios", f"{arm}_ee_pos", 3), f"{arm}_a": own("actions", f"{arm}_ee_pos", 3), f"{arm}_r": own("proprios", f"{arm}_ee_rotm"), f"{arm}_t": own("actions", f"{arm}_ee_rotm"), f"{arm}_g": own("proprios", f"{arm}_gripper_pos", 1)}
    given = F.coalesce(F.map_contains_key("actions", F.lit("raw_actions")), F.lit(False)).alias("given")
    lists = episodes.select("episode", given, *(c.alias(k) for k, c in made.items()))
    zipped = [F.col("raw")]
    for arm in ARMS:
        zipped += [F.col(f"{arm}_p"), later(F.col(f"{arm}_a"), action_skip - 1).alias(f"{arm}_a"), F.col(f"{arm}_r"), later(F.col(f"{arm}_t"), action_skip - 1).alias(f"{arm}_t"), F.col(f"{arm}_g"), later(F.col(f"{arm}_g"), action_skip).alias(f"{arm}_h")]
    rows = lists.select("episode", "given", F.posexplode_outer(F.arrays_zip(*zipped)).alias("frame", "x")).filter("frame is not null").select("episode", F.col("frame").cast("long").alias("frame"), "given", "x.*")
    states, actions = {}, {}
    for arm in ARMS:
        rows, p = turned(rows, f"_{arm}p", f"{arm}_r")
        rows, a = turned(rows, f"_{arm}a", f"{arm}_t")
        rows, held = Q.staged(rows, f"_{arm}c", Q.canonical(p))
        rows, d = Q.staged(rows, f"_{arm}d", Q.multiply(a, Q.conjugate(p)))
        rows, d = Q.staged(rows, f"_{arm}e", Q.canonical(d))
        rows, v = Q.staged(rows, f"_{arm}v", Q.to_rotvec(d, own=True))
        at = lambda name, k, arm=arm: F.get(F.col(f"{arm}_{name}"), F.lit(k))
        states |= {f"{arm}_ee_pos": F.col(f"{arm}_p"), f"{arm}_ee_quat": F.when(held[0].isNotNull(), F.array(*held)), f"{arm}_gripper_pos": F.col(f"{arm}_g")}
        grip = at("h", 0) - at("g", 0)
        actions |= {f"{arm}_pos": F.when(at("a", 0).isNotNull() & at("p", 0).isNotNull(), F.array(*(at("a", k) - at("p", k) for k in range(3)))), f"{arm}_turn": F.when(v[0].isNotNull(), F.array(*v)), f"{arm}_grip": F.when(grip.isNotNull(), F.array(grip))}
    state, state_mask = state_vector(states, stats, inverse_gripper)
    raw, raw_mask = raw_action_vector(F.col("raw"), stats)
    delta, delta_mask = delta_action_vector(actions, stats, inverse_gripper)
    return rows.select("episode", "frame", "given", state.alias("state"), state_mask.alias("state_mask"), F.when(F.col("given"), raw).otherwise(delta).alias("action"), F.when(F.col("given"), raw_mask).otherwise(delta_mask).alias("action_mask"))


def blocks(frames: DataFrame, by: list[str], values: list[str], halo: int, width: int = WIDTH) -> DataFrame:
    """(by, block, first, values as arrays): frames ``first`` = block * width and on, ``width`` + ``halo`` of them or as
    many as there are. A frame goes to its own block and to those that reach into it; frames are numbered from 0."""
    low = F.greatest(F.ceil((F.col("frame") - (width + halo - 1)) / width), F.lit(0)).cast("long")
    dealt = frames.select(*by, "frame", *values, F.explode_outer(F.sequence(low, F.floor(F.col("frame") / width).cast("long"))).alias("block"))
    lists = dealt.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("frame", *values))).alias("s"))
    return lists.select(*by, "block", (F.col("block") * width).alias("first"), *(F.col("s")[v].alias(v) for v in values))


def clips_of(blocks_: DataFrame, keep: list[str], sequence_length: int, frame_skip: int, action_skip: int, width: int = WIDTH) -> DataFrame:
    """(keep, start, states, state_masks, actions, action_masks) of every clip that begins in a block: states of every
    ``frame_skip``-th frame, actions of every ``action_skip``-th frame of the span, or of every frame where raw ones are
    given. Needs the columns of ``frame_vectors``; the halo must be the span at least."""
    reach = span(sequence_length, frame_skip)
    starts = F.sequence(F.lit(0), F.least(F.lit(width), F.size("state") - reach) - 1)
    every = lambda c, s, n, step: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(F.col(c), s + k * step))

    def sample(s: Column) -> Column:
        action = lambda c: F.when(F.col("given"), F.slice(F.col(c), s + 1, F.lit(reach))).otherwise(every(c, s, reach // action_skip, action_skip))
        return F.struct((F.col("first") + s).alias("start"), every("state", s, sequence_length, frame_skip).alias("states"), every("state_mask", s, sequence_length, frame_skip).alias("state_masks"), action("action").alias("actions"), action("action_mask").alias("action_masks"))

    some = blocks_.filter(F.size("state") > reach)
    return some.select(*keep, F.explode_outer(F.transform(starts, sample)).alias("c")).select(*keep, "c.*")


def conditions(clips: DataFrame, seed, shuffle_views: bool = True) -> DataFrame:
    """Adds ``views`` (names of the cameras) and ``cameras`` (codes of their types), in one repeatable order for each clip,
    and ``prompt``, one of the usable instructions; needs ``observations`` and ``instructions`` of the clip's episode. A
    clip without a usable instruction is an error."""
    order = permute(sorted_views(F.col("observations")), F.col("episode"), F.col("start")) if shuffle_views else sorted_views(F.col("observations"))
    shown = clips.withColumn("_views", order)
    codes = F.transform("_views", lambda v: camera_code(v["value"]["type"]))
    prompt = pick(usable_instructions(F.col("instructions")), seed, F.col("episode"), F.col("start"))
    return shown.select(*(c for c in clips.columns if c not in ("observations", "instructions")), F.transform("_views", lambda v: v["key"]).alias("views"), codes.alias("cameras"), prompt.alias("prompt"))


def training_samples(episodes: DataFrame, stats: Statistics, sequence_length: int, frame_skip: int, action_skip: int, store, seed=0, width: int = WIDTH) -> DataFrame:
    """Samples of all clips of episodes (episode, proprios, actions, observations, instructions).

    ``store`` writes a table and gives it back as read: blocks are an artefact of a dataset, made once and read at every
    epoch. The episodes' own columns stand in their first block's row and in all others, as they are short.
    """
    if frame_skip % action_skip:
        raise ValueError("frame_skip must be a multiple of action_skip")
    vectors = frame_vectors(episodes, stats, action_skip)
    halo = span(sequence_length, frame_skip)
    made = blocks(vectors, ["episode", "given"], ["state", "state_mask", "action", "action_mask"], halo, width)
    own = episodes.select(F.col("episode").alias("_episode"), "observations", "instructions")
    stored = store(made.join(own, F.col("episode") == F.col("_episode")).drop("_episode"))
    clips = clips_of(stored, ["episode", "given", "observations", "instructions"], sequence_length, frame_skip, action_skip, width)
    return conditions(clips, seed)
