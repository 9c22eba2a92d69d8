"""Row numbers, scans, exact quantiles in rounds, episode statistics, training samples and the message log."""

import collections
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions import rotation as Q
from kinelake.operators import order, samples, statistics, tracks
from kinelake.plans import jobs, streams
from kinelake.sources.episodes import StatisticsSource
from kinelake.sources.tables import scratch, written
from kinelake.streaming import broker, log

FOLDER = "/root/testdata/sf0.001"


def test_numbers_of_groups_and_of_tables(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), k) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x int, id long")
    got = {r.id: r.n for r in order.numbered(df, ["g"], ["x", "id"], "n").collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {i: k for k, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g))}
    assert got == want
    whole = order.numbered(df, [], ["x", "id"], "n").collect()
    assert [r.id for r in sorted(whole, key=lambda r: r.n)] == [i for _, i in sorted((x, i) for _, x, i in rows)] and {r.n for r in whole} == set(range(700))
    assert order.numbered(df.limit(0), ["g"], ["id"], "n").count() == 0


def test_scan_of_a_product_that_does_not_commute(spark):
    """2 x 2 matrices, one long group, short ones and a null key; segments of 3, so several levels."""
    rng = random.Random(1)
    rows = [(g, k, *(rng.uniform(-1, 1) for _ in range(4))) for g, n in (("long", 200), ("one", 1), ("three", 3), (None, 10)) for k in range(n)]
    names = ["a", "b", "c", "d"]

    def product(old, new):
        m, o = [[new["a"], new["b"]], [new["c"], new["d"]]], [[old["a"], old["b"]], [old["c"], old["d"]]]
        return {n: m[i][0] * o[0][j] + m[i][1] * o[1][j] for n, (i, j) in zip(names, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)}

    df = spark.createDataFrame(rows, "g string, n long, a double, b double, c double, d double")
    got = {(r.g, r.n): [r.a, r.b, r.c, r.d] for r in tracks.scan(df.repartition(5), ["g"], "n", names, product, width=3).collect()}
    assert len(got) == len(rows)
    for g in ("long", "one", "three", None):
        m = np.eye(2)
        for _, k, *v in (r for r in rows if r[0] == g):
            m = np.array(v).reshape(2, 2) @ m
            assert np.allclose(got[g, k], m.reshape(-1), atol=1e-9)


def rotated(v):
    n = math.sqrt(sum(x * x for x in v))
    return (math.cos(n / 2), *(x * (math.sin(n / 2) / n if n else 0.5) for x in v))


def times(a, b):
    return (a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2], a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1], a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0])


def test_poses_equal_a_walk(spark):
    rng = random.Random(2)
    steps = [[rng.uniform(-1, 1) for _ in range(7)] if k % 9 else [0.0] * 7 for k in range(150)]
    df = spark.createDataFrame([("e", k, s) for k, s in enumerate(steps)], "episode string, frame long, s array<double>")
    at = lambda k: F.col("s")[k]
    start = (F.lit(1.0), F.lit(2.0), F.lit(3.0)), (F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)), F.lit(0.5)
    got = {r.frame: r for r in tracks.pose_track(df, ["episode"], "frame", tuple(at(k) for k in range(3)), tuple(at(3 + k) for k in range(3)), at(6), start, width=4).collect()}
    p, q, g = [1.0, 2.0, 3.0], (math.sqrt(0.5), 0.0, 0.0, math.sqrt(0.5)), 0.5
    for k, s in enumerate(steps):
        p, q, g = [a + b for a, b in zip(p, s[:3], strict=True)], times(rotated(s[3:6]), q), g + s[6]
        assert np.allclose([got[k][c] for c in tracks.POSE], [*p, g, *q], atol=1e-9)


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_in_rounds_are_exact(spark, monkeypatch, few):
    """A small limit and a coarse grid need several rounds; ties, one hot value, heavy tails and null keys stay exact."""
    monkeypatch.setattr(statistics, "GRID", 8)
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=4000), "tail": np.exp(rng.normal(size=3000) * 40), "ties": rng.integers(0, 3, 5000).astype(float), None: np.concatenate([np.zeros(2900), rng.normal(size=100)]), "few": np.array([1.0, 5.0]), "one": np.array([7.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("few", None), ("none", None)]
    rounds = []
    monkeypatch.setattr(statistics, "written", lambda df, name="table": (rounds.append(name), written(df, name))[1])
    got = {r.g: r for r in statistics.quantiles(spark.createDataFrame(rows, "g string, value double"), ["g"], few=few, limit=40).collect()}
    assert set(got) == set(groups) and rounds.count("bounds") > 2
    for g, values in groups.items():
        assert got[g].n == len(values)
        assert np.allclose([got[g].q01, got[g].q99], np.quantile(values, [0.01, 0.99]), rtol=1e-12)
    small = {r.g: (r.n, r.q01, r.q99) for r in statistics.quantiles(spark.createDataFrame(rows, "g string, value double"), ["g"]).collect()}
    assert all(small[g][0] == got[g].n and np.allclose(small[g][1:], [got[g].q01, got[g].q99], rtol=1e-12) for g in groups)


def episodes(spark, documents):
    rows = [(f"/r/data/chunk-000/episode_{k}.json", v if isinstance(v, str) else json.dumps(v)) for k, v in enumerate(documents)]
    return StatisticsSource(spark, "/r", nested=False, documents=spark.createDataFrame(rows, "path string, value string")).parts()


def test_pool_of_all_forms(spark):
    eye, turn = [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[0, -1, 0], [1, 0, 0], [0, 0, 1]]
    docs = [
        {"proprios": {"left_ee_pos": [0, 0, 0, 1, 2, 3], "left_gripper_pos": [0.5, 0.75], "left_ee_rotm": [eye, eye]}, "actions": {"left_ee_pos": [[1, 1, 1], [2, 2, 2], [9, 9, 9]], "left_ee_rotm": [turn, turn]}},
        {"proprios": {"right_gripper_pos": [[1], [2], [4]]}, "actions": {"raw_actions": [[*range(14)]], "right_ee_pos": [[1, 2, 3]]}},
        {"proprios": {"left_ee_pos": [[0, 0, 0]], "left_ee_rotm": [1, 2, 3]}, "actions": {"raw_actions": [[1, 2, 3]]}},
        {"proprios": None, "actions": {"raw_actions": [[*range(14)]]}}, {"proprios": {}}, "{broken", {"proprios": {"left_ee_pos": []}, "actions": None},
    ]
    got = collections.Counter((r.key, r.axis, round(r.value, 9)) for r in statistics.episode_pool(episodes(spark, docs), 1).collect())
    want = collections.Counter()
    for key, rows in {
        "proprio_left_ee_xyz": [[0, 0, 0], [1, 2, 3], [0, 0, 0]], "action_left_ee_xyz": [[1, 1, 1], [1, 0, -1], [0, 1, 2]], "action_right_ee_xyz": [[7, 8, 9]], "gripper_pos": [[0.5], [0.75], [1], [2], [4]],
        "action_left_ee_axisangle": [[0, 0, round(math.pi / 2, 9)]] * 2 + [[3, 4, 5]], "action_right_ee_axisangle": [[10, 11, 12]], "gripper_action": [[0.25], [1], [2]],
    }.items():
        want.update((key, axis, float(v)) for row in rows for axis, v in enumerate(row))
    assert got == want
    assert statistics.statistics_job(episodes(spark, docs[4:])).count() == 0
    kept = {r.key: r for r in statistics.statistics_job(episodes(spark, docs), 1, 0.8).filter("axis = 0").collect()}
    assert kept["gripper_action"].n == 1 and kept["gripper_action"].q99 == 2.0 == -kept["gripper_action"].q01 and "proprio_right_ee_xyz" not in kept


def test_samples_are_cut_without_a_shuffle(spark):
    clips = jobs._clips(spark, FOLDER)
    assert "Exchange" not in clips._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="multiple"):
        samples.training_samples(clips, jobs.STATS, 3, 4, 3, written)


@pytest.mark.parametrize(("width", "halo"), [(1, 0), (4, 3), (5, 12), (64, 2)])
def test_blocks_hold_every_clip(spark, width, halo):
    rows = [(g, k, [float(k), float(n)]) for g, n in (("a", 30), ("b", 1), ("c", 13)) for k in range(n)]
    made = samples.blocks(spark.createDataFrame(rows, "episode string, frame long, v array<double>").repartition(3), ["episode"], ["v"], halo, width).collect()
    for g, n in (("a", 30), ("b", 1), ("c", 13)):
        own = {r.block: r for r in made if r.episode == g}
        assert set(own) == set(range(math.ceil(n / width)))
        for b, r in own.items():
            assert r.first == b * width and [x[0] for x in r.v] == list(range(b * width, min(n, (b + 1) * width + halo)))


def collected(spark, path, folder):
    stream = log.read_log(spark, path, "id long, ts double, at long").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").orderBy("at").collect()]


def test_log_goes_on_from_its_checkpoint(spark):
    path, folder = scratch(spark, "log"), scratch(spark, "reader")
    rows = lambda a, b: spark.createDataFrame([(k, float(-k)) for k in range(a, b)], "id long, ts double").repartition(4)
    assert log.append(rows(0, 25), path, ["id"], size=10) == 25
    assert collected(spark, path, folder) == [(k, float(-k), k) for k in range(25)]
    assert log.append(rows(25, 40), path, ["id"], size=10, shown=False) == 40  # a writer that failed before its marker
    assert len(collected(spark, path, folder)) == 25
    assert log.append(rows(25, 60), path, ["id"], size=10) == 60
    assert collected(spark, path, folder) == [(k, float(-k), k) for k in range(60)]
    assert collected(spark, path, folder) == [(k, float(-k), k) for k in range(60)]  # nothing new


def test_barrier_tells_once(spark):
    """Ranks that repeat; a run that never completes is told once its patience is over, and not again."""
    rows = [("a", 0), ("a", 0), ("a", 1), ("b", 0), ("b", 0), ("a", 0), ("a", 1), ("b", 0), ("a", 2), ("c", None)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "run string, rank long, ts long")
    out = streams.replay(spark, df, lambda m: broker.completed_stream(m, 2, patience=1), "done", ("ts",), runs=3, clock=True)
    assert {(r.run, r.complete) for r in out.collect()} >= {("a", True), ("b", False)} and out.count() == len({r.run for r in out.collect()})


class States:
    """Keyed states of a processor in this process; counts what is asked of them."""

    def __init__(self):
        self.calls, self.timers, self.data = 0, [], {}

    def getMapState(self, name, *schema):
        return State(self, self.data.setdefault(name, {}))

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.append(ms)


class State:
    def __init__(self, owner, data):
        self.owner, self.data = owner, data

    def _called(self, result=None):
        self.owner.calls += 1
        return result

    def getValue(self, key):
        return self._called(self.data[key])

    def containsKey(self, key):
        return self._called(key in self.data)

    def updateValue(self, key, value):
        self._called(self.data.update({key: value}))

    def removeKey(self, key):
        self._called(self.data.pop(key))

    def keys(self):
        for key in list(self.data):
            yield self._called(key)

    def exists(self):
        return self.containsKey(())

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self._called(self.data.clear())


def messages(n, seed):
    """Requests and workers in order of time, many at one time, with long stretches of one kind only."""
    rng = np.random.default_rng(seed)
    ask = rng.random(n) < np.where(np.arange(n) // (n // 8) % 2, 0.9, 0.15)
    return pd.DataFrame({"kind": np.where(ask, "request", "ready"), "id": rng.permutation(n), "ts": np.arange(n) // 3 / 8})


def paired(frame):
    frame = frame.sort_values(["ts", "id"])
    r, w = (frame[frame["kind"] == k] for k in ("request", "ready"))
    return [(i, j, a, b, max(a, b)) for i, a, j, b in zip(r["id"], r["ts"], w["id"], w["ts"], strict=False)]


def test_dispatch_touches_blocks_not_messages():
    """F3 of round 3: the state is asked for blocks of messages, not for each of them; batches cut lines and blocks anywhere."""
    frame, states = messages(60_000, 1).sort_values(["ts", "id"]), States()
    out, at = [], 0
    for n in (1, 5, 4096, 9000, 0, 20_000, 26_898):
        fifo = broker.Fifo()
        fifo.init(states)
        parts = [p.sample(frac=1, random_state=2) for p in (frame[at : at + n // 2 * 2], frame[at + n // 2 * 2 : at + n])]
        out += list(fifo.handleInputRows(("q",), iter(parts), None))
        at += n
    assert at == len(frame) and all(len(f) <= broker.PIECE for f in out)
    assert sorted(tuple(r)[1:] for f in out for r in f.itertuples(index=False)) == sorted(paired(frame))
    assert states.calls < len(frame) / 100 and sum(len(d) for name, d in states.data.items() if "blocks" in name) < 20


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_late_messages_wait_in_buckets():
    """F2 of round 3: messages in any order within the delay; the watermark stops between, in and behind their buckets."""
    frame, states = messages(40_000, 2), States()
    span, delay = float(frame["ts"].max()), 600.0
    arrived = frame.iloc[np.argsort(frame["ts"].to_numpy() + np.random.default_rng(3).uniform(0, delay, len(frame)))]
    out, mark = [], -1
    for part in [*np.array_split(np.arange(len(arrived)), 9), np.arange(0)]:
        late = broker.LateFifo(delay / broker.BUCKETS)
        late.init(states)
        rows = arrived.iloc[part]
        rows = pd.concat([rows, pd.DataFrame({"kind": ["end"], "id": [-1], "ts": [span]})])
        assert not any(len(f) for f in late.handleInputRows(("q",), iter([rows[:100], rows[100:]]), Mark(mark)))
        mark = int(1000 * (rows["ts"][:-1].max() - delay)) if len(part) else int(span * 1000) + 1
        if states.timers and min(states.timers) <= mark:
            states.timers = [t for t in states.timers if t > mark]
            out += list(late.handleExpiredTimer(("q",), Mark(mark), None))
    assert not states.data["waiting"] and not states.data["buckets"]
    assert sorted(tuple(r)[1:] for f in out for r in f.itertuples(index=False)) == sorted(paired(frame))
    assert states.calls < len(frame) / 4  # at least one for each message before, and three for each key that waited


def test_server_holds_numbers_and_answers_in_pieces(monkeypatch):
    """F4 of round 3: a client's batch is kept as numbers and answered piece by piece; statistics change often, also in width."""
    monkeypatch.setattr(broker, "PIECE", 5000)
    rng, n = np.random.default_rng(4), 60_000
    setup = rng.random(n) < 0.2
    setup[:7] = False  # asked before there are statistics
    wide = np.arange(n) > n - 900  # a third number from here on, with a setup at once
    setup[np.flatnonzero(wide)[0]] = True

    def frames(a, b):
        for k in range(a, b, 2000):
            rows = []
            for j in range(k, min(b, k + 2000)):
                state, low = np.full(2 + wide[j], j % 97 / 7.0), np.full(2 + wide[j], -1.0 - j % 3)
                rows.append(("setup", j, j, None, low, -low + j % 5) if setup[j] else ("observe", j, j, state, None, None))
            yield pd.DataFrame(rows[::-1], columns=["kind", "id", "at", "state", "q01", "q99"])

    sizes, out, states = [], [], States()
    predict = lambda x: (sizes.append(len(x)), x**2)[1]
    for a, b in ((0, 20_001), (20_001, n)):
        server = broker.Server(predict)
        server.init(states)
        for f in server.handleInputRows(("c",), frames(a, b), None):
            assert len(f) <= 5000
            out += [(r.ordinal, r.request_id, r.action if r.action is None else np.array(r.action)) for r in f.itertuples()]
    assert len(sizes) < 40 and max(sizes) <= 5000
    bounds, k = None, 0
    for j in range(n):
        if setup[j]:
            bounds = -1.0 - j % 3, 1.0 + j % 3 + j % 5
            continue
        want = None
        if bounds:
            low, high = bounds
            want = np.full(2 + wide[j], ((2 * (j % 97 / 7.0 - low) / (high - low) - 1) ** 2 + 1) / 2 * (high - low) + low)
        assert out[k][:2] == (k + 1, j) and (want is None) == (out[k][2] is None) and (want is None or np.allclose(out[k][2], want, atol=1e-12))
        k += 1
    assert k == len(out)


def test_replay_bounds_its_parts(spark, monkeypatch):
    """F4 of round 3: a batch has at most PART messages, however long the log is."""
    monkeypatch.setattr(streams, "PART", 20)
    df = spark.createDataFrame([("a", float(k), k) for k in range(70)], "run string, ts double, step long")
    shown = []
    show = log.show
    monkeypatch.setattr(log, "show", lambda spark, path, end: (shown.append(end), show(spark, path, end))[1])
    out = streams.replay(spark, df, broker.speed_stream, "speeds", ("ts",))
    assert out.count() == 70 and np.diff([0, *shown]).max() <= 20 and shown[-1] == 70


def test_quaternion_helpers_agree():
    assert np.allclose(times(rotated([0.1, 0.2, 0.3]), rotated([0, 0, 0])), rotated([0.1, 0.2, 0.3])) and Q.SMALL < 1e-9
