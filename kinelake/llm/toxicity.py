"""Toxicity by a linear-chain conditional random field.

Two tags (toxic or not) for each word. Features of a word are its whole form and its first 4, 5 and 6 bytes (stems);
each has log-odds between documents labelled toxic and others, where groups of near copies count once. Those that a
G-test finds significant are cut into bins by log-odds; a word takes the highest bin of its features, and words
without one say nothing. Token labels come from document labels: in documents labelled toxic, words of a significant
feature with high log-odds are tagged. The field is fitted by gradient ascent on the exact likelihood
(forward-backward) of segments; the marginals of the words that say something, exact in the whole text, are aggregated
to a document score by a logistic model, and words with a marginal of at least one half are the offending spans.

Emissions and tags so rest on the same log-odds: the field smooths a learned word list along the text, it does not see
more than that. The fit uses at most ``bound`` documents labelled toxic and three times as many others, one text of each
doc_id (of several the first in the order of a hash), taken by the order of a hash of doc_id within at most ``bytes_`` of
text, half of them for each class, and none whose crc32(doc_id as text) mod 5 is 0. Every segment of these texts counts;
segments in which no word says anything differ in length only, so one stands for all of its length, with their number.
Scores never use labels, lang, source or doc_id.

Defined cases: a null text is empty and gets the score of no marginals; a doc_id labelled more than once is toxic if
any of its labels is; without labels of both classes every score is 0; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as T

BOUND, SEGMENT, STEPS = 500, 64, 60
#: most bytes of text that the fit reads
BYTES = 16 << 20
#: lower edges of the bins of log-odds; bin 0, below the first, says nothing
EDGES = (1.5, 2.5, 3.5, 5.0)
TAG_ODDS, SIGNIFICANT = 2.5, 25.0
STEMS = (4, 5, 6)
#: segments that the fit takes at a time
SLICE = 2048
_OUT = "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>"


@dataclass
class Field:
    hashes: np.ndarray  # of the words that say something, ascending
    bins: np.ndarray
    start: np.ndarray  # 2
    move: np.ndarray  # 2 x 2, log
    emit: np.ndarray  # bins of the toxic tag, log
    weights: np.ndarray  # of the document model

    def classes(self, words: T.Words) -> np.ndarray:
        """The highest bin of each word's features."""
        best = np.zeros(len(words.starts), np.int64)
        if len(self.hashes):
            for at, hashes in features(words):
                k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                best[at] = np.maximum(best[at], np.where(self.hashes[k] == hashes, self.bins[k], 0))
        return best

    def marginals(self, at: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
        """Chance of the toxic tag at each of the positions that say something, in a text of n words. A stretch of k
        other words is the k-th power of one 2 x 2 matrix, taken by its eigenvalues."""
        move, quiet = np.exp(self.move), np.array([1.0, np.exp(self.emit[0])])
        step = move * quiet[None, :]  # to the next word, which says nothing
        values, vectors = np.linalg.eig(step)
        values, vectors, inverse = values.real, vectors.real, np.linalg.inv(vectors.real)
        top = values.max()

        def power(k: int) -> np.ndarray:
            return (vectors * (values / top) ** k) @ inverse

        m = len(at)
        ahead, back = np.empty((m, 2)), np.empty((m, 2))
        v = np.exp(self.start)
        if at[0]:
            v = (v * quiet) @ power(int(at[0]) - 1)
        for j in range(m):
            if j or at[0]:
                v = v @ power(int(at[j] - at[j - 1]) - 1) @ move if j else v @ move
            v = v * np.array([1.0, np.exp(self.emit[kinds[j]])])
            v = ahead[j] = v / v.sum()
        w = np.ones(2)
        w = power(n - 1 - int(at[-1])) @ w
        for j in range(m - 1, -1, -1):
            back[j] = w = w / w.sum()
            if j:
                w = power(int(at[j] - at[j - 1]) - 1) @ (move @ (w * np.array([1.0, np.exp(self.emit[kinds[j]])])))
        both = ahead * back
        return both[:, 1] / both.sum(axis=1)

    def documents(self, words: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text: word indexes that say something, and their marginals."""
        kinds = self.classes(words)
        at = np.flatnonzero(kinds)
        cuts = np.searchsorted(at, words.first)
        for d, n in enumerate(words.counts):
            own = at[cuts[d] : cuts[d + 1]]
            yield own, self.marginals(own - words.first[d], kinds[own], int(n)) if len(own) else np.zeros(0)

    def score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-self.weights @ summary(marginals)))) if len(self.weights) else 0.0


def features(words: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the words that have it, and its hashes."""
    yield np.arange(len(words.starts)), words.hash
    for size in STEMS:
        at = np.flatnonzero(words.ends - words.starts > size)
        yield at, T.hash_ranges(words.buf, words.starts[at], words.starts[at] + size, size)


def copy_groups(words: T.Words) -> np.ndarray:
    """A group number for each document; near copies (by min-hashes of word triples, six bands of two) share one."""
    at, h = T.ngrams(words, 3)
    cuts = np.searchsorted(at, words.first)
    group, seen = np.arange(len(words.counts)), {}
    for d in range(len(group)):
        own = h[cuts[d] : cuts[d + 1]]
        if len(own):
            for band in range(6):
                key = (band, *(int(T.mix64(own ^ _SALTS[2 * band + k]).min()) for k in range(2)))
                group[d] = min(group[d], seen.setdefault(key, group[d]))
    return group


_SALTS = T.mix64(np.arange(1, 13, dtype=T._U))


def summary(marginals: np.ndarray) -> np.ndarray:
    return np.array([1.0, np.log1p(marginals.sum()), marginals.max(initial=0.0)])


def fit(texts: list[str], toxic: list[int], steps: int = STEPS) -> Field:
    """Fits the field and the document model on labelled texts."""
    truth = np.array(toxic, bool)
    if not truth.any() or truth.all():
        return Field(np.zeros(0, T._U), np.zeros(0, np.int64), np.zeros(2), np.zeros((2, 2)), np.zeros(len(EDGES) + 1), np.zeros(0))
    words = T.Words(pa.array(texts, pa.large_string()), T.ALNUM_WORDS)
    # numbers of groups of documents with each feature, in both classes
    group = copy_groups(words)
    totals = [len(np.unique(group[truth])), len(np.unique(group[~truth]))]
    found, sizes = [], []
    for at, hashes in features(words):
        for k, side in enumerate((truth, ~truth)):
            own = side[words.doc[at]]
            h, g = hashes[own], group[words.doc[at[own]]]
            order = np.lexsort((g, h))
            h, g = h[order], g[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            found.append(h[once])
            sizes.append(np.full(int(once.sum()), k))
    known, index = np.unique(np.concatenate(found), return_inverse=True)
    side = np.concatenate(sizes)
    hits, misses = np.bincount(index[side == 0], minlength=len(known)), np.bincount(index[side == 1], minlength=len(known))
    share = totals[0] / sum(totals)
    odds = np.log((hits + 0.5) / (totals[0] + 1)) - np.log((misses + 0.5) / (totals[1] + 1))
    n = hits + misses
    gain = 2 * (hits * np.log(np.maximum(hits, 1e-9) / (n * share)) + misses * np.log(np.maximum(misses, 1e-9) / (n * (1 - share))))
    keep = (odds >= EDGES[0]) & (gain >= SIGNIFICANT)
    field = Field(known[keep], np.searchsorted(EDGES, odds[keep], "right"), np.zeros(2), np.zeros((2, 2)), np.zeros(len(EDGES) + 1), np.zeros(0))
    kinds = field.classes(words)
    tags = (kinds >= np.searchsorted(EDGES, TAG_ODDS, "right")) & truth[words.doc]

    # segments of equal length; the last of a text is filled up with quiet words outside the likelihood
    loud = np.concatenate([[0], np.cumsum(kinds > 0)])
    rows, weight, quiet = [], [], {}
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        for c in range(a, b, SEGMENT):
            d = min(c + SEGMENT, b)
            if loud[d] == loud[c] and d - c in quiet:
                weight[quiet[d - c]] += 1.0
                continue
            if loud[d] == loud[c]:
                quiet[d - c] = len(rows)
            rows.append((c, d))
            weight.append(1.0)
    weight = np.array(weight)
    at = np.array([a for a, _ in rows], np.int64)[:, None] + np.arange(SEGMENT)
    inside = at < np.array([b for _, b in rows], np.int64)[:, None]
    at = np.minimum(at, len(kinds) - 1)
    x, y = kinds[at], (tags[at] & inside).astype(int)
    width = len(EDGES) + 1
    theta = np.concatenate([[0.0, -3.0], [0.0, -3.0, -1.0, 0.0], [-3.0] + [-1.0, 0.0, 1.0, 3.0]])
    memory = np.zeros_like(theta)
    for _ in range(steps):
        start, move, emit = theta[:2], theta[2:6].reshape(2, 2), theta[6:]
        # in slices of segments, so that the driver holds the tables of one slice
        parts = [_counts(*(v[a : a + SLICE] for v in (x, y, inside, weight)), start, move, emit, width) for a in range(0, max(1, len(x)), SLICE)]
        grad, pair, spread = (sum(p[k] for p in parts) for k in range(3))
        curve = np.concatenate([[weight.sum()] * 2, np.maximum(pair, 1) * 0.25, spread])
        memory = 0.5 * memory + grad / (curve + 1e-3 * weight.sum() + 1e-9)
        theta = np.clip(theta + np.clip(0.5 * memory, -1, 1), -12, 12)
    field.start, field.move, field.emit = theta[:2], theta[2:6].reshape(2, 2), theta[6:]

    data = np.array([summary(m) for _, m in field.documents(words)])
    weights = np.zeros(data.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-data @ weights))
        step = (data * (p * (1 - p))[:, None]).T @ data + 0.1 * np.eye(data.shape[1])
        weights += np.linalg.solve(step, data.T @ (truth - p) - 0.1 * weights)
    field.weights = weights
    return field


def _counts(x, y, inside, weight, start, move, emit, width):
    """Observed minus expected counts of every feature, expected counts of the transitions, and variances of the
    emissions; a segment counts ``weight`` times."""
    s, t = x.shape
    e = np.stack([np.zeros(x.shape), emit[x]], axis=2)
    ahead, scale = np.empty((t, s, 2)), np.empty((t, s))
    v = np.exp(start + e[:, 0])
    m = np.exp(move)
    for j in range(t):
        if j:
            v = np.where(inside[:, j, None], (ahead[j - 1] @ m) * np.exp(e[:, j]), ahead[j - 1])
        scale[j] = v.sum(axis=1)
        ahead[j] = v / scale[j][:, None]
    back = np.ones((s, 2))
    pair = np.zeros((2, 2))
    seen = np.zeros((2, 2))
    toxic = np.zeros(x.shape)
    for j in range(t - 1, -1, -1):
        post = ahead[j] * back
        post /= post.sum(axis=1, keepdims=True)
        toxic[:, j] = post[:, 1] * inside[:, j]
        if j:
            own = np.exp(e[:, j]) * back
            joint = ahead[j - 1][:, :, None] * m[None] * own[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pair += (joint * (weight * inside[:, j])[:, None, None]).sum(axis=0)
            np.add.at(seen, (y[:, j - 1][inside[:, j]], y[:, j][inside[:, j]]), weight[inside[:, j]])
            back = np.where(inside[:, j, None], own @ m.T, back)
            back /= back.sum(axis=1, keepdims=True)
    many = weight[:, None]
    want = np.bincount(x.reshape(-1), (y * inside * many).reshape(-1), width)
    have = np.bincount(x.reshape(-1), (toxic * many).reshape(-1), width)
    spread = np.bincount(x.reshape(-1), (toxic * (1 - toxic) * many).reshape(-1), width)
    first = np.array([(weight * (toxic[:, 0] - y[:, 0])).sum(), (weight * (y[:, 0] - toxic[:, 0])).sum()])
    grad = np.concatenate([first, (seen - pair).reshape(-1), want - have])
    return grad, pair.reshape(-1), spread


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = BOUND, bytes_: int = BYTES) -> tuple[list[str], list[int]]:
    """At most ``bound`` toxic texts and three times as many others, one of each doc_id, by the order of a hash of doc_id,
    outside the held-out fold; of both classes those whose texts take ``bytes_`` / 2 together, in that order (at least one each)."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out("doc_id")).withColumn("h", F.xxhash64("doc_id"))
    texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    # labels may name documents that are not there, so ids are taken of those that are; copies of an id are folded before the shuffle
    there = texts.groupBy("doc_id").agg(F.min(F.struct("t", "size")).alias("one")).join(known, "doc_id").select("doc_id", "toxic", "h", "one.t", "one.size")
    ids = functools.reduce(DataFrame.unionByName, (there.filter(of).orderBy("h", "doc_id").limit(n) for of, n in (("toxic = 1", bound), ("toxic <> 1", 3 * bound))))
    before = Window.partitionBy("toxic").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # at most four times the bound
    fits = ids.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter((F.col("before") == 0) | (F.col("before") + F.col("size") <= bytes_ // 2))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(fits.select("doc_id", "t", "toxic", "h")), ["doc_id", "t"])
    taken = rows.groupBy("doc_id", "t", "toxic", "h").agg(F.first("text").alias("text")).orderBy("h", "doc_id").select("text", "toxic").collect()
    return [r["text"] or "" for r in taken], [int(r["toxic"] == 1) for r in taken]


def held_out(key: str):
    """Whether a row is held out; a row without doc_id is not (nor is it ever learned from)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND, bytes_: int = BYTES) -> DataFrame:
    """doc_id, score (0 to 1) and spans (code points of words with marginals of one half or more) for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels, bound, bytes_)))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for piece in T.pieces(batch):
                words = T.Words(piece.column(1), T.ALNUM_WORDS)
                scores, spans = [], []
                points = words.points()
                for d, (at, chance) in enumerate(field.documents(words)):
                    scores.append(field.score(chance))
                    own = []
                    for i, p in zip(at[chance >= 0.5], chance[chance >= 0.5], strict=True):
                        start, end, first = (int(points[x]) for x in (words.starts[i], words.ends[i], words.offsets[d]))
                        own.append({"start": start - first, "end": end - first, "marginal": float(p)})
                    spans.append(own)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return docs.mapInArrow(run, _OUT)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = BOUND, bytes_: int = BYTES) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold; one scan, no shuffle of texts."""
    named = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    shared = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(named, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), bound, bytes_)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for piece in T.pieces(batch):
                words = T.Words(piece.column(at), T.ALNUM_WORDS)
                yield piece.filter(pa.array([field.score(chance) < threshold for _, chance in field.documents(words)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
