"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe make all signature coordinates: sigma scatters a shingle once, pi is shifted
circularly by k for coordinate k, so ``h_k(S) = min over s of pi(sigma(s) + k)``. Bands of coordinates select
candidate pairs, which full shingle sets confirm. Rows with equal sets are one class from the start, so copies are
never expanded into pairs. In each band bucket every class is compared with the bucket's two leaders. Classes of larger
buckets that are then in different components go an exact way, a prefix filter on their rarest shingles, so that a
bucket of many documents around one shared passage is not expanded into its pairs. Holders of a frequent shingle meet in
small deals first, and in larger ones only where components are still apart. A link between two members of one
component could not change the result, so the components hold all links found by banding.

Sets are compared by 64-bit hashes of shingles, which are made of strong 64-bit hashes of words: two given sets that
differ count one shingle wrong with a chance of about |A| * |B| / 2^64.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component. Rows that share a
doc_id are documents of their own: each is linked by its own text, a component takes the smallest doc_id of its rows,
and ``kept`` (doc_id = component_id) may so hold for several rows; ``drop_near_duplicates`` tells such rows apart and
leaves one row of each component. Rows without doc_id come last within a component, and a component of such rows alone has a
null component_id. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .components import components
from .frames import placed, release, written

BANDS, ROWS = 30, 5
#: size classes; a class id ends with the size class of its set
SIZES = 64
#: tasks that the classes of one bucket are dealt to
SALTS = 16
#: holders of a shingle that meet at first; eight times as many in each further round
DEAL = 64
_U32 = np.uint32
_SIGN_SCHEMA = "doc_id long, file_key long, row_at long, n_shingles long, set_key binary, bands array<long>"
_SET_SCHEMA = "cid long, shingles array<long>"


def shingles(words: T.Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a document with fewer words has the one of all its words."""
    at, hashes = T.ngrams(words, width)
    edges = np.searchsorted(at, words.first)
    counts = words.counts
    for d in range(len(counts)):
        if counts[d] >= width:
            yield np.unique(hashes[edges[d] : edges[d + 1]])
        elif counts[d]:
            h = T._U(0x51ED270B0A1F39C1) + T._U(int(counts[d]))
            own = words.hash[words.first[d] : words.first[d + 1]]
            for w in own:
                with np.errstate(over="ignore"):
                    h = h * T._U(0xC2B2AE3D27D4EB4F) + w
            yield T.mix64(np.array([h], T._U))
        else:
            yield np.zeros(0, T._U)


def _pi(x: np.ndarray) -> np.ndarray:
    """Permutation of 32-bit words (multiply and xor-shift steps are bijective), in place."""
    x ^= x >> _U32(16)
    x *= _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x *= _U32(0x846CA68B)
    x ^= x >> _U32(16)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash coordinates of one set."""
    sigma = _pi((hashes ^ (hashes >> T._U(32))).astype(_U32) * _U32(0x9E3779B1) + _U32(0x165667B1))
    shift = np.arange(size, dtype=_U32)[:, None]
    best = np.full(size, 0xFFFFFFFF, _U32)
    for a in range(0, len(sigma), 1024):
        np.minimum(best, _pi(sigma[None, a : a + 1024] + shift).min(axis=1), out=best)
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of each band, which the band's number goes into."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(T._U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=T._U), parts.shape[:2]).copy()
    for k in range(rows):
        key = T.mix64(key * T._U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                sets = list(shingles(T.Words(piece.column(1), T.BLANK_WORDS), width))
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = np.zeros((0, bands), T._U)
                if full:
                    keys = band_keys(np.stack([signature(sets[k], bands * rows) for k in full]), bands, rows)
                offsets = np.zeros(len(sets) + 1, np.int32)
                offsets[1:] = np.cumsum([bands if len(s) else 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        piece.column(2),
                        piece.column(3),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "file_key", "row_at", "n_shingles", "set_key", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch):
                sets = list(shingles(T.Words(piece.column(1), T.BLANK_WORDS), width))
                offsets = np.zeros(len(sets) + 1, np.int32)
                offsets[1:] = np.cumsum([len(s) for s in sets])
                values = np.concatenate(sets) if sets else np.zeros(0, T._U)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], names=["cid", "shingles"]
                )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are similar enough: 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.filter(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select(pairs.columns)


def _size_class(n: Column, percent: int) -> Column:
    """Sets whose sizes allow the similarity are in one class or in neighbouring ones; the last class has no upper end."""
    return F.least(F.floor(F.ln(n.cast("double")) / (math.log(100 / percent) + 1e-9)), F.lit(SIZES - 1)) if percent < 100 else F.lit(0)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (cid, component, n, at, s, band): the rarest shingles of each set that one of another component may share.

    Shingles are ordered by how many sets hold them, those of one component only first. Similar sets share a shingle
    among the first ``n - ceil(n * percent / 100) + 1`` of both, and at the first shared one enough must remain in
    both to reach the similarity. So passages that very many documents share meet nowhere but where little else is.
    Holders of a shingle meet by bands of set size as well (similar sets are in one band or in neighbouring ones), which
    splits a shingle that many prefixes share.
    """
    held = sets.select("cid", "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    common = held.groupBy("s").agg(F.count("*").alias("f"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("s", "f")
    ranked = held.join(common, "s").groupBy("cid").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "s"))).alias("t"))
    ranked = ranked.withColumn("own", F.col("n") - F.size("t")).withColumn("use", F.expr(f"n - (n * {int(percent)} + 99) div 100 + 1 - own")).filter("use > 0")
    firsts = ranked.select("cid", "component", "n", "own", F.posexplode(F.expr("slice(t, 1, cast(use as int))")).alias("k", "e"))
    return written(firsts.select("cid", "component", "n", (F.col("own") + F.col("k") + 1).alias("at"), F.col("e.s").alias("s"), _size_class(F.col("n"), percent).cast("int").alias("band")))


def _owned(firsts: DataFrame) -> DataFrame:
    """The rows of shingles that several components hold, with ``size`` (holders) and ``main``: whether the row is of the
    component with most holders, which need not meet among themselves."""
    parts = firsts.groupBy("s", "component").agg(F.count("*").alias("c")).groupBy("s").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts"))
    return firsts.join(parts.filter("parts > 1").select("s", "size", F.col("top.component").alias("top")), "s").withColumn("main", F.col("component") == F.col("top")).drop("top")


def _prefix_pairs(owned: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, component_a, component_b) of different components, of the same ``deal`` of a shingle, that may be
    similar enough; loses none of these."""
    one, two = (owned.select("s", "deal", "band", *(F.col(c).alias(c + side) for c in ("cid", "component", "n", "at", "main"))) for side in ("_a", "_b"))
    one = one.filter("not main_a").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    fits = f"(1 + least(n_a - at_a, n_b - at_b)) * {100 + int(percent)} >= (n_a + n_b) * {int(percent)}"
    pairs = one.join(two, ["s", "deal", "band"]).filter(f"component_a <> component_b and (main_b or cid_a < cid_b) and least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {int(percent)} and {fits}")
    return pairs.select(*(f("cid_a", "cid_b").alias(n) for f, n in ((F.least, "a"), (F.greatest, "b"))), *(f("component_a", "component_b").alias(f"component_{n}") for f, n in ((F.least, "a"), (F.greatest, "b")))).distinct()


def _prefix_links(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b): components (column of ``sets``) to be joined, as two of their sets are similar enough. No two
    components with such sets stay apart.

    The holders of a frequent shingle meet in deals, of about ``DEAL`` at first, which are few pairs. Near copies of one
    text are mostly joined by that. Shingles still held by several components go on with larger deals, until one deal is
    all holders of a shingle, so every pair of sets meets unless it is in one component by then.
    """
    owned, deal, found = written(_owned(_prefixes(sets, percent))), DEAL, []
    while True:
        dealt = owned.withColumn("deal", F.pmod(F.xxhash64("cid", "s"), F.ceil(F.col("size") / deal)))
        pairs = written(_prefix_pairs(dealt, percent))
        found.append(written(_confirmed(pairs, sets, percent).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))))
        release(pairs)
        # a shingle of one deal is done
        rest = owned.filter(F.col("size") > deal).drop("size", "main")
        if rest.isEmpty():
            break
        joined = components(found[-1]).select(F.col("node").alias("component"), F.col("component").alias("top"))
        before, owned = owned, written(_owned(rest.join(joined, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")))
        release(before)
        deal *= 8
    release(owned)
    return reduce(DataFrame.unionByName, found)


def _linked(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, file_key, row_at, n_shingles, set_key: null without words), and classes (set_key, lead: the smallest
    doc_id of the component, file and at: the place of the component's first row)."""
    docs = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    signed = written(docs.mapInArrow(_sign(width, bands, rows), _SIGN_SCHEMA))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "file_key", "row_at")
    classes = signed.filter("set_key is not null").groupBy("set_key").agg(F.min(order).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id() * SIZES + _size_class(F.col("n"), percent)).drop("n"))

    buckets = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("size")).filter("low < high")
    members = written(buckets.join(shared, "bucket"))
    # every class of a bucket with both of its leaders, the first and the last, where the sizes allow the similarity
    ends = members.select("cid", F.explode(F.array("low", "high")).alias("l")).filter(f"cid <> l and abs(cid % {SIZES} - l % {SIZES}) <= 1")
    star = written(ends.select(F.least("cid", "l").alias("a"), F.greatest("cid", "l").alias("b")).distinct())
    # sets are read of those, and of the classes of buckets with over three (smaller ones are complete by the leaders)
    wanted = star.select(F.col("a").alias("cid")).union(star.select("b")).union(members.filter("size > 3").select("cid")).distinct()
    leads = classes.join(wanted, "cid", "left_semi").select("cid", F.col("first.file_key").alias("f"), F.col("first.row_at").alias("r"))
    texts = docs.join(leads, (docs["file_key"] == leads["f"]) & (docs["row_at"] == leads["r"])).select("cid", "text")
    sets = written(texts.mapInArrow(_sets(width), _SET_SCHEMA))
    links = written(_confirmed(star, sets, percent))
    release(star)
    parts = components(links)
    release(links)

    # what is left: classes of buckets with over three classes in several components
    owned = written(members.filter("size > 3").select("bucket", "cid").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("component", "cid").alias("component")))
    release(members)
    split = owned.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2")
    split = split.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = owned.withColumn("salt", F.pmod(F.floor(F.col("cid") / SIZES), F.lit(SALTS)))  # a large bucket goes to several tasks
    open_ = salted.join(split, ["bucket", "salt"], "left_semi").select("cid", "component").distinct()
    opened = written(open_.join(sets, "cid"))
    more = _prefix_links(opened, percent)
    release(owned, opened, sets)
    joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("top"))

    # linked classes and the first row of their component, in the order of doc_id; any other class is its own
    ones = parts.select(F.col("node").alias("cid"), "component").join(joined, "component", "left").select("cid", F.coalesce("top", "component").alias("component"))
    alone = joined.select(F.col("component").alias("cid"), F.col("top").alias("component")).join(parts.select(F.col("node").alias("cid")), "cid", "left_anti")
    ones = written(ones.unionByName(alone).join(classes.select("cid", "first"), "cid"))
    heads = ones.groupBy("component").agg(F.min("first").alias("head"))
    found = ones.join(heads, "component").select("cid", "head")
    final = written(classes.select("set_key", "cid", "first").join(found, "cid", "left").select("set_key", F.coalesce("head", "first").alias("head")))
    release(classes, ones)
    return signed, final.select("set_key", F.col("head.doc_id").alias("lead"), F.col("head.file_key").alias("file"), F.col("head.row_at").alias("at"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id linked with it, directly or not)
    and kept (doc_id = component_id)."""
    own, classes = _linked(docs, width, percent, bands, rows)
    found = own.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "lead"), "set_key", "left").withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("lead")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, but those linked with a row before them in the order of doc_id (null last): one
    row of each component stays, also where ids repeat or are null, and every row without words."""
    docs = placed(docs, "_near_file", "_near_at")
    own, classes = _linked(docs, width, percent, bands, rows)
    gone = own.join(classes, "set_key").filter("file_key <> file or row_at <> at").select("file_key", "row_at")
    return docs.join(gone, (docs["_near_file"] == gone["file_key"]) & (docs["_near_at"] == gone["row_at"]), "left_anti").drop("_near_file", "_near_at")
