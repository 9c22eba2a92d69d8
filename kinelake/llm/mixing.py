"""Mixing sources to target weights by the cube method.

Every source gets a target number of words; its documents are taken floor(r) times, r = target / source size, and
those taken once more are a balanced sample with inclusion probability r - floor(r). The flight phase moves the
probabilities of a few documents at a time along the null-space of the balancing constraints (words and number of
documents), so both totals stay exact until fewer documents than constraints + 1 are undecided. It runs in blocks of
a source dealt by hash; the few undecided documents of all blocks fly again, level by level, and the last ones land
with ``LAST`` short ones: of all their choices, one of those that miss the words still due by no more than half the
shortest of them beyond the nearest one, drawn by its probability.

Sources are few as a rule, and their targets are found on the driver; with more than ``MANY`` of them that is done on
tables instead, with the same result. Repeated rows (same source, doc_id and size) are counted first and then numbered,
so a third of the table under one id neither meets in one task nor in one block.

Defined cases: a null text has size 0; a null source is a source, last in order; an empty source has target 0; repeated
rows are documents of their own. Random choices are hashes of the row (source, doc_id, size), its number among equal rows
and the seed, so reruns agree, and other seeds give other samples; in a block, documents of one size fly in the order of
these hashes. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as T
from .frames import release, written

LIMIT, LAST = 3, 12
BLOCK = 2_000
WEIGHTS = (1.0, 2.0, 3.0)
MANY = 100_000
_WORD = r"[^\x20\x09-\x0D]+"
_UNIT = "doc_id long, source string, size long, copy long, source_size long, target double, base long, p double, done boolean, blocks int, block long"


def sizes(docs: DataFrame) -> DataFrame:
    """source, doc_id, size (blank-separated words of the text) and the number of such rows."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))


def targets(source_sizes: list[tuple[str | None, int]], weights=WEIGHTS, limit: int = LIMIT) -> dict[str | None, float]:
    """Words due from each source: shares of all words by weight (repeating over the sources by code point, null last),
    none above limit times its size; what is above goes to the others by weight."""
    order = sorted(source_sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    left = {k: (weights[i % len(weights)], n) for i, (k, n) in enumerate(order)}
    total, out = float(sum(n for _, n in order)), {}
    while left:
        unit = total / sum(w for w, _ in left.values())
        over = [k for k, (w, n) in left.items() if w * unit > limit * n]
        if not over:
            return out | {k: w * unit for k, (w, _) in left.items()}
        for k in over:
            out[k] = float(limit * left.pop(k)[1])
            total -= out[k]
    return out


def targets_of_many(by: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``targets`` on tables: (source, source_size) gets its target. One number for each range of sources, and three for
    each round of sharing the excess, reach the driver."""
    spark = by.sparkSession
    ranged = by.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id()))
    counts = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("k"), F.count("*")).collect())
    starts = spark.createDataFrame([(p, first, sum(c for q, _, c in counts if q < p)) for p, first, c in counts], "part int, first long, before long")
    place = (F.col("k") - F.col("first") + F.col("before")) % len(weights)
    rows = ranged.join(F.broadcast(starts), "part")  # one row for each range
    rows = written(rows.select("source", "source_size", F.get(F.array(*(F.lit(float(w)) for w in weights)), place.cast("int")).alias("w"), F.lit(None).cast("double").alias("target")))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        w = rows.filter("target is null").agg(F.sum("w")).first()[0]
        if not w:
            return rows.select("source", "source_size", "target")
        due = F.col("w") * F.lit(total / w)
        over = F.col("target").isNull() & (due > limit * F.col("source_size"))
        taken = rows.filter(over).agg(F.sum("source_size")).first()[0]
        if taken is None:
            return rows.select("source", "source_size", F.coalesce("target", due).alias("target"))
        total -= limit * float(taken)
        before, rows = rows, written(rows.withColumn("target", F.when(over, limit * F.col("source_size").cast("double")).otherwise(F.col("target"))))
        release(before)


def _coin(*keys) -> float:
    """A number in [0, 1) of the keys, in any order."""
    with np.errstate(over="ignore"):
        return int(T.mix64(np.array([sum(int(k) for k in keys) % (1 << 64)], np.uint64))[0]) / 2**64


def flight(size: np.ndarray, p: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Moves p to 0 or 1 keeping sum(p) and sum(p * size), until at most two entries are between; ``key`` are the hashes
    that the coins are made of."""
    p = p.copy()
    open_: list[int] = []
    for nxt in range(len(p)):
        if not 1e-9 < p[nxt] < 1 - 1e-9:
            p[nxt] = round(p[nxt])
            continue
        open_.append(nxt)
        while len(open_) >= 3:
            a, b, c = open_[-3:]
            u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
            if not any(u):
                u = (1.0, -1.0, 0.0)
            steps = [((1 - p[k]) / v if v > 0 else p[k] / -v, k) for k, v in zip((a, b, c), u, strict=True) if v]
            back = [(p[k] / v if v > 0 else (1 - p[k]) / -v, k) for k, v in zip((a, b, c), u, strict=True) if v]
            up, down = min(steps)[0], min(back)[0]
            # the seeded coin of the cube method: go either way with chances that keep the expectation; no three rows meet twice
            t = up if _coin(key[a], key[b], key[c]) < down / (up + down) else -down
            for k, v in zip((a, b, c), u, strict=True):
                p[k] = min(1.0, max(0.0, p[k] + t * v))
            kept = [k for k in open_[-3:] if 1e-9 < p[k] < 1 - 1e-9]
            if len(kept) == 3:  # rounding left the one that should have landed just inside
                k = min(kept, key=lambda k: min(p[k], 1 - p[k]))
                kept.remove(k)
            for k in open_[-3:]:
                if k not in kept:
                    p[k] = float(round(p[k]))
            open_[-3:] = kept
    return p


def landing(size: np.ndarray, p: np.ndarray, coin: float) -> np.ndarray:
    """Zeros and ones: of all choices those nearest to sum(p * size), one by the coin. Choices that miss by no more than
    half the shortest document beyond the nearest are equal; they weigh what independent draws would give them."""
    choices = (np.arange(1 << len(p))[:, None] >> np.arange(len(p)) & 1).astype(np.float64)
    miss = np.abs(choices @ size - (p * size).sum())
    near = choices[miss <= miss.min() + size.min() / 2 + 1e-9]
    chance = np.exp((near * np.log(p) + (1 - near) * np.log1p(-p)).sum(axis=1))
    return near[min(int(np.searchsorted(np.cumsum(chance), coin * chance.sum(), "right")), len(near) - 1)]


def row_keys(source: str | None, doc_id: list, size: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of a source, for one seed."""
    own = xxhash.xxh3_64_intdigest(repr(source).encode("utf-8", "surrogatepass"), seed & (1 << 64) - 1)
    ids = np.array([0 if i is None else i for i in doc_id], np.int64).view(np.uint64)
    absent = np.array([i is None for i in doc_id], np.uint64)
    h = np.full(len(ids), own, np.uint64)
    for part in (ids, absent, size.astype(np.int64).view(np.uint64), copy.astype(np.int64).view(np.uint64)):
        h = T.mix64(h * np.uint64(0x9E3779B97F4A7C15) + part)
    return h


def _fly(land: bool, seed: int):
    def run(key, table):
        """One block of a source, long documents first, so that short ones are left undecided; land: decides those too."""
        with np.errstate(over="ignore"):
            h = row_keys(key[0].as_py(), table["doc_id"].to_pylist(), table["size"].to_numpy(), table["copy"].to_numpy(), seed)
        order = np.lexsort((h, -table["size"].to_numpy()))
        table, h = table.take(pa.array(order)), h[order]
        size, p = table["size"].to_numpy().astype(np.float64), table["p"].to_numpy().copy()
        fly = max(0, len(p) - LAST) if land else len(p)
        p[:fly] = flight(size[:fly], p[:fly], h[:fly])
        open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        if land and len(open_):
            p[open_] = landing(size[open_], p[open_], _coin(*h[open_]))
        done = (p <= 1e-9) | (p >= 1 - 1e-9)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(np.where(done, np.round(p), p))).set_column(table.schema.get_field_index("done"), "done", pa.array(done))

    return run


def _dealt(seed: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "copy"), F.greatest(blocks, F.lit(1)))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, limit: int = LIMIT, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source) and taken (words, repeats counted) for each row."""
    spark = docs.sparkSession
    rows = written(sizes(docs))
    by = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    # one row for each source reaches the driver, while they are few enough
    found = [tuple(r) for r in by.limit(many + 1).collect()]
    if len(found) <= many:
        due = targets([(s, n) for s, n, _ in found], weights, limit)
        table = spark.createDataFrame([(s, n, c, float(due[s])) for s, n, c in found], "source string, source_size long, n long, target double")
    else:
        by = written(by)
        table = by.join(targets_of_many(by.drop("n"), weights, limit).select(F.col("source").alias("s"), "target"), F.expr("source <=> s")).drop("s")
    r = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    r = F.when(F.abs(r - F.rint(r)) < 1e-12, F.rint(r)).otherwise(F.least(r, F.lit(float(limit))))
    table = written(table.select("source", "source_size", "target", F.floor(r).alias("base"), (r - F.floor(r)).alias("p"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    most = table.agg(F.max("blocks")).first()[0] or 1
    units = rows.alias("d").join((F.broadcast(table) if len(found) <= 10_000 else table).alias("t"), F.expr("d.source <=> t.source"))
    units = units.select("d.*", "t.source_size", "t.target", "t.base", "t.p", "t.blocks").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    names = [c.split()[0] for c in _UNIT.split(", ")]
    units = units.withColumn("done", F.col("p") == 0).withColumn("block", _dealt(seed, F.col("blocks"))).select(*names)
    flying, decided, level = units.filter("not done"), [units.filter("done")], 0
    while True:
        flown = written(flying.groupBy("source", "block").applyInArrow(_fly(most <= 1, seed + level), _UNIT))
        decided.append(flown.filter("done"))
        if most <= 1:
            break
        # at most two of each block are left: far fewer blocks next time
        flying = flown.filter("not done").withColumn("blocks", F.ceil(F.col("blocks") * 2 / F.lit(block)).cast("int")).withColumn("block", _dealt(seed + 1 + level, F.col("blocks")))
        most, level = -(-most * 2 // block), level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("base") + F.col("p").cast("long"))).alias("taken"))
