"""Language profiles, fill-in-middle cuts and collocations against brute force, SQL and round trips."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kinelake.llm import collocations, fill_middle, language
from kinelake.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, phrase string, salt int, place int, block int, file_key string, row_at long, words string, score string"
ODD = [None, "", " ", "\t\n", "a", "1 2 3", "x " * 4000, "x " * 4000, "é" * 700, "日本 語é áb", "<P> no", "it's <S", "M> ends <", "tail  ", "  head", "a\x00b c", "İstanbul ǅ", "one. two; three"]


def docs(spark, texts, langs=None, ids=None):
    n = len(texts)
    rows = [((ids or range(n))[k], t, (langs or ["en"] * n)[k], None, 7, "f", "p", 1, 2, 3, "k", 4, "w", "s") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", ["op11_language", "op12_fill_middle", "op13_collocations"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    theirs = con.sql(Q.ORACLE_SQL[name]).df()
    ours = Q.QUERIES[name](spark, FOLDER).toPandas()[list(theirs.columns)]
    clean = lambda f: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.astype(object).where(f.notna(), None).values.tolist()), key=str)
    assert clean(ours) == clean(theirs)


# --- op12 ------------------------------------------------------------------------------------------------------------
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_of(doc_id, text, unit):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n, h = len(units), [int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if doc_id is None or not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), out


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_cuts_equal_brute_force_and_go_back(spark, unit):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(" \n\tab.é日𝄞", k=rng.randrange(40))) for _ in range(300)] + ["word é " * 30_000]
    ids = [None if k % 50 == 49 else k % 211 for k in range(len(texts))]
    made = fill_middle.fill_in_middle(docs(spark, texts, ids=ids), unit=unit)
    rows = made.select("*", fill_middle.restored(made["output"], made["form"]).alias("back")).collect()
    want = collections.Counter((i, *middle_of(i, t, unit)) for i, t in zip(ids, texts, strict=True))
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == want
    assert sorted(r.back for r in rows) == sorted(t or "" for t in texts)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs(spark, ["a"]).limit(0)).count() == 0


def test_cut_at_every_unit():
    text = "ab  é日日 𝄞\n\n x"
    for unit, units in (("token", TOKEN.findall(text)), ("char", list(text))):
        runs = fill_middle.Runs(pa.array(["zz", None, text, "", "q"]), unit)
        assert runs.n.tolist() == [1 if unit == "token" else 2, 0, len(units), 0, 1]
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert runs.cut(2, u) == (len(head.encode()), len(head))


def test_broken_bytes_stay():
    column = pa.array([b"\x80\x80 a\xff\xfe", b"\xe9 \xe9"], pa.binary()).view(pa.string())
    runs = fill_middle.Runs(column)
    assert runs.n.tolist() == [2, 2] and [runs.cut(0, u)[0] for u in range(3)] == [0, 2, 6] and [runs.cut(1, u)[0] for u in range(3)] == [0, 1, 3]


def test_marks_that_cannot_be_found_again():
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "ba", "x")):
        with pytest.raises(ValueError, match="told apart"):
            fill_middle.checked(marks)


# --- op11 ------------------------------------------------------------------------------------------------------------
def grams_of(text):
    out = collections.Counter()
    word = lambda c: unicodedata.category(c)[0] in "LM"
    for w in "".join(c if word(c) else "\n" for c in text.lower()).split("\n"):
        if w:
            padded = f" {w} "
            out.update([*w, *(padded[k : k + 2] for k in range(len(w) + 1)), *(padded[k : k + 3] for k in range(len(w)))])
    return out


def first(counts, top):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}


def languages_by_brute_force(rows, top):
    pools = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            pools[lang].update(grams_of(t or ""))
    known = {lang: first(c, top) for lang, c in pools.items() if c}
    out = []
    for i, t, _ in rows:
        own = first(grams_of(t or ""), top)
        far = sorted((sum(abs(k - p[g]) if g in p else top for g, k in own.items()), lang) for lang, p in known.items())
        ok = far and any(c.isalpha() for c in (t or "").lower())
        out.append((i, far[0][1] if ok else "und", round(1 - far[0][0] / (len(own) * top), 9) if ok else 0.0))
    return sorted(out, key=str)


WORDS = {"en": "the of and tion ing her with", "de": "der die und schaft ung über für", "fr": "le de eau ment où ça pré", "ru": "это как слово мир"}


@pytest.mark.parametrize("block", [2, 256])
def test_languages_equal_brute_force(spark, block):
    rng = random.Random(8)
    langs = [rng.choice([*WORDS, None]) for _ in range(150)]
    texts = [" ".join(rng.choices(WORDS[x or "en"].split(), k=rng.randrange(1, 40))) for x in langs]
    texts, langs = ODD + texts, [rng.choice([None, "en", "zz"]) for _ in ODD] + langs
    ids = [None if k % 40 == 39 else k % 120 for k in range(len(texts))]
    for top in (15, 300):
        got = language.identify_language(docs(spark, texts, langs, ids), top=top, block=block)
        assert sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got.collect()), key=str) == languages_by_brute_force(list(zip(ids, texts, langs, strict=True)), top)
    assert {(r.doc_id, r.held_out) for r in got.collect()} == {(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i in ids}


def test_languages_of_nothing(spark):
    some = docs(spark, ODD, [None] * len(ODD))
    assert {(r.lang_pred, r.score) for r in language.identify_language(some).collect()} == {("und", 0.0)}
    assert language.identify_language(some.limit(0)).count() == 0


def test_learning_hands_counts_on(spark, monkeypatch):
    """A learning task that holds few counts gives the same profiles."""
    d = docs(spark, [" ".join(WORDS[x].split() * 20) for x in WORDS], list(WORDS))
    whole = {tuple(r) for r in language.profiles(d, 50).collect()}
    monkeypatch.setattr(language, "HELD_COUNTS", 10)
    assert {tuple(r) for r in language.profiles(d, 50).collect()} == whole
    assert language.gram_text(language.Grams(["é"]).packed(np.array([2 * 9]))[0]) == "é"


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99


# --- op13 ------------------------------------------------------------------------------------------------------------
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def collocations_by_brute_force(rows, least, percent, best, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    covered = set()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            covered |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * a >= percent * f[lang, w[i : i + k]]}
    scored = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            cuts = [(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]]).__floor__(), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return {(lang, r, p.decode(), -a, left, right, n_, -s) for lang, x in scored.items() for r, (s, a, p, left, right, n_) in enumerate(sorted(x)[:best], 1)}


@pytest.mark.parametrize(("least", "percent", "best", "cells"), [(3, 100, 2000, 1 << 26), (3, 60, 5, 1 << 26), (5, 100, 2000, 1 << 16), (300, 100, 50, 1 << 26)])
def test_collocations_equal_brute_force(spark, least, percent, best, cells):
    rng = random.Random(least)
    vocabulary = ["the", "The", "of", "x", "é", "日本", "a\x00b", "new", "york", "city", "'s", "-"]
    texts = ODD + [" ".join(rng.choice([*vocabulary, "new york city hall", "x x x x x x x", "word.", "end\nof", "a\tb", "  "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    langs = [rng.choice(["en", "en", "en", None, "und", "de"]) for _ in texts]
    got = collocations.collocations(docs(spark, texts, langs), least=least, percent=percent, best=best, cells=cells)
    rows = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()}
    assert rows == collocations_by_brute_force(list(zip(texts, langs, strict=True)), least, percent, best)
    assert rows


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With so few cells that all are set, every phrase survives the sketch and the second pass alone decides."""
    monkeypatch.setattr(collocations, "CHUNK", 64)
    texts = [f"w{k % 7} w{k % 5} w{k % 3} of the town" for k in range(200)]
    got = collocations.collocations(docs(spark, texts), least=20, cells=64)
    rows = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()}
    assert rows == collocations_by_brute_force([(t, "en") for t in texts], 20, 100, 2000)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    sketch, true = collocations.Sketch(1 << 12, 50), collections.Counter()
    for _ in range(5):
        h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)[rng.integers(0, 300, 20_000) ** 2 % 3000]
        sketch.add(h)
        true.update(h.tolist())
    for h, n in true.items():
        for row, cell in zip(sketch.rows, collocations.cells_of(np.array([h], np.uint64), 1 << 12), strict=True):
            assert row[int(cell[0])] >= min(n, 50)


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left = 10**13 + 7, 9 * 10**14 + 1, 10**13 + 9
    counts = spark.createDataFrame([("en", "", 0, n), ("en", "x", 1, left), ("en", "y", 1, left + 2), ("en", "x y", 2, a)], "lang string, phrase string, words int, n long")
    assert [r.score for r in collocations.scored(counts).collect()] == [1000 * a * n // (left * (left + 2))]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs(spark, ["a b"]).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, ODD), least=10**6).count() == 0
