"""Cases where the corpus operators once did less than the whole job."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from kinelake.llm import decontaminate, fingerprint, licenses, mixing, near_dedup, pii, secrets_scan, substring_dedup, textkit, token_count, toxicity
from kinelake.llm.queries import MODEL_FILE

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
KEYS = {
    "upper-case hex": ("0123456789ABCDEF", (32, 64, 128, 256)), "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (32, 172, 256)),
    "lower case and digits": ("abcdefghijklmnopqrstuvwxyz0123456789", (32, 256, 800)), "base64": (BASE64, (40, 800, 1000, 1624, 6000)),
}


@pytest.mark.parametrize("kind", KEYS)
def test_long_and_small_alphabet_keys(kind):
    letters, lengths = KEYS[kind]
    rng = random.Random(11)
    for n in lengths:
        for _ in range(10):
            key = ""
            while secrets_scan.base_spans(key) or not (any(x.isdigit() for x in key) and any(x.isalpha() for x in key)):
                key = "".join(rng.choices(letters, k=n))
            assert ("novel", 17, 17 + n) in secrets_scan.spans(f"the private_key: {key} ends"), (n, key)


def test_long_names_are_not_novel():
    name = "configuration-service/authorization-handler/connection-factory/v2/default-repository-builder"
    assert secrets_scan.spans(f"the key {name} of it") == []


def test_secret_written_twice():
    key = "Zk9qT3vXw8Lr2MbY7uHdPa4sEe6NcGj1KfQo5RtW"
    for gap in (1, 40, 490, 500):
        for second in (key, key + "==", "/" + key):
            text = f"the bearer {key}{' ' * gap}bearer {second} end"
            assert [s[0] for s in secrets_scan.spans(text)] == ["novel", "novel"], (gap, second)
            assert key not in secrets_scan.redact(text, secrets_scan.spans(text))
    assert secrets_scan.spans("the key " + "configuration-manager-v2-default " * 3) == []


def spark_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (h >> 63 << 64)


def cut_by_brute_force(rows):
    """(doc_id, n_bytes, n_removed, sha256 of what stays) of rows in order of id (null first) and hash of the text."""
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]))):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want.append((i, len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(want, key=str)


def cut(d, **options):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.remove_repeats(d, **options).collect()), key=str)


def test_one_id_with_a_copy_and_another_text(spark):
    one, other = (" ".join(f"{c}{k}é" for k in range(60)) for c in "ab")
    rows = [(1, one), (2, one), (2, one), (2, other), (3, other[:200]), (4, other), (4, one + other), (None, one[50:300]), (None, other + "x"), (None, other + "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1 << 22, 500):
        assert cut(d, block_bytes=block) == cut_by_brute_force(rows)


def test_repeats_of_periodic_and_long_texts(spark):
    """One word over and over, a text of several blocks, and a passage that every document holds."""
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(1000)}" for _ in range(60))
    rows = [(k, f"head{k} " * rng.randrange(3) + passage + f" tail{k}") for k in range(30)] + [(40, "ab" * 3000), (41, "ba" * 3000), (42, " ".join(f"w{rng.randrange(50)}" for _ in range(4000)) + passage)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cut(d, block_bytes=2000) == cut_by_brute_force(rows)


def test_fingerprints_that_share_64_bits_are_told_apart():
    values, checks = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 7, 2, 1, 7], np.uint64)
    v, c, first, number = substring_dedup.distinct(values, checks)
    assert v.tolist() == [3, 5, 5] and c.tolist() == [7, 1, 2] and first.tolist() == [1, 0, 2] and number.tolist() == [1, 0, 2, 1, 0]
    assert [substring_dedup.check_bytes(n) for n in (10**6, 5 * 10**8, 3 * 10**10, 10**14)] == [0, 2, 4, 7]
    for n in (0, 1, 31, 32, 1000):
        x = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert (substring_dedup.decoded(substring_dedup.coded(x)) == x).all()
    table = pa.table({"bucket": [0] * 3, "block": [1, 2, 3], "n": [2, 1, 1], "blob": [substring_dedup.coded(np.array(x, np.uint64)) for x in ([3, 5], [5], [5])], "checks": [b"\7\1", b"\2", b"\1"]})
    got = substring_dedup._answer(True, 1)(None, table).to_pylist()
    bits = {r["block"]: np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8), count=r["n"]).tolist() for r in got}
    assert bits == {1: [0, 0], 2: [0], 3: [1]}


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_structured_texts_have_hashes_of_their_own():
    for n in (16, 64, 300, 1024, 2048, 4096):
        one, two = thue_morse(n), thue_morse(n, "b", "a")
        words = textkit.Words(pa.array([one, two]), textkit.BLANK_WORDS)
        assert words.hash[0] != words.hash[1]
        lines = [" ".join(x) for x in (one, two)]
        a, b = fingerprint.Prints.of(pa.array(lines)).text()
        assert a != b
        for width in (3, 5):
            sets = [set(s.tolist()) for s in near_dedup.shingles(textkit.Words(pa.array([one + " x y", two + " x y"]), textkit.BLANK_WORDS), width)]
            assert sets[0] != sets[1]
    wide = fingerprint.Prints.of(pa.array(["a b", "c d"])).wide
    assert len({int(x) for x in wide.reshape(-1)}) == 8


def test_near_duplicates_of_rows_that_share_an_id(spark):
    rng = random.Random(2)
    w, v = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(80)) for c in "wv")
    rows = [(5, w), (5, v), (7, v + " more"), (8, v + " more"), (9, w), (None, w), (None, "alone " * 5), (6, "equal " * 70_000), (10, "equal " * 69_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(d, 3, 85).collect()), key=str)
    assert got == sorted([(5, 78, 5, True), (5, 78, 5, True), (7, 79, 5, False), (8, 79, 5, False), (9, 78, 5, False), (None, 78, 5, False), (None, 1, None, True), (6, 1, 6, True), (10, 1, 6, False)], key=str)
    left = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(d, 3, 85).collect()), key=str)
    assert left == sorted([(5, w), (5, v), (None, "alone " * 5), (6, "equal " * 70_000)], key=str)


def test_decontamination_cuts_spans(spark):
    passage = " ".join(f"q{k}" for k in range(14))
    texts = [f"Before this, {passage.upper()}! and after", "clean text", None, f"{passage} x {passage}", "é short Item"]
    d = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(texts)], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(1, passage), (2, passage + " other words"), (2, passage), (3, "short item")], "item_id long, text string")
    want = {0: "Before this, ! and after", 1: "clean text", 2: None, 3: " x ", 4: "é "}
    for limit in (1 << 20, 60):
        got = decontaminate.cut_contaminated(d, bench, max_bytes=limit)
        assert got.columns == d.columns and {r.doc_id: r.text for r in got.collect()} == want
        assert {r.doc_id for r in decontaminate.drop_contaminated(d, bench, max_bytes=limit).collect()} == {1, 2}
        found = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(d, bench, max_bytes=limit).collect()}
        assert found == {0: (14, 2), 1: (0, 0), 2: (0, 0), 3: (28, 2), 4: (2, 1)}


def test_the_set_of_windows_is_small():
    rng = random.Random(1)
    items = [(str(k), " ".join(f"w{rng.randrange(10**5)}" for _ in range(400))) for k in range(300)]
    windows = decontaminate.Windows(items)
    size = windows.buf.nbytes + windows.at.nbytes + sum(x.nbytes for found in windows.known.values() for x in found)
    assert size < 13 * sum(len(t) for _, t in items)


def test_mix_is_the_same_at_any_number_of_sources(spark):
    rng = random.Random(6)
    rows = [(k, " ".join("x" * rng.randrange(1, 30)), f"s{rng.randrange(9)}" if k % 11 else None) for k in range(900)] + [(5, "a b c", "s1")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    due = mixing.targets(list(sizes.items()))
    runs = []
    for many, block in ((1000, 50), (3, 50), (1000, 50)):
        got = mixing.mix(d, block=block, many=many).collect()
        assert sorted((r.doc_id, r.size, r.source or "") for r in got) == sorted((k, len(t.split()), s or "") for k, t, s in rows)
        for s, n in sizes.items():
            own = [r for r in got if r.source == s]
            assert {(r.source_size, round(r.target, 6)) for r in own} == {(n, round(due[s], 6))}
            rate = due[s] / n
            assert all(r.taken in (int(rate + 1e-9) * r["size"], int(rate + 1e-9) * r["size"] + r["size"]) and r.taken <= 3 * r["size"] for r in own)
            assert abs(sum(r.taken for r in own) - due[s]) <= 30
        runs.append(sorted(((r.source, r.doc_id, r.size, r.taken) for r in got), key=str))
    assert runs[0] == runs[1] == runs[2]
    assert mixing.mix(d.limit(0)).count() == 0 and sum(r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "a"), (1, None, "a")], d.schema)).collect()) == 0


def flown(seed, size, p, ids=None):
    n = len(size)
    table = pa.table({"doc_id": pa.array(range(n) if ids is None else ids, pa.int64()), "size": pa.array(size, pa.int64()), "copy": pa.array([1] * n, pa.int64()), "p": pa.array(p, pa.float64()), "done": pa.array([False] * n)})
    out = mixing._fly(True, seed)((pa.scalar("s"), pa.scalar(0)), table)
    assert out["doc_id"].null_count == 0 and all(out["done"].to_pylist())
    taken = dict(zip(out["doc_id"].to_pylist(), out["p"].to_pylist(), strict=True))
    return np.array([taken[i] for i in sorted(taken)])


def test_balanced_sample_keeps_chances():
    """Over many seeds the share of draws of each document is near its inclusion probability, and words stay near their target."""
    rng = np.random.default_rng(9)
    size, p = rng.integers(5, 50, 40), rng.choice([0.2, 0.4, 0.7], 40)
    draws = np.array([flown(seed, size, p) for seed in range(600)])
    assert np.abs(draws.mean(axis=0) - p).max() < 0.1
    assert np.abs(draws @ size - p @ size).max() <= 5
    assert len({tuple(d) for d in draws}) > 500
    equal = np.array([flown(seed, np.full(30, 10), np.full(30, 0.3)) for seed in range(600)])  # ranks by size say nothing here
    assert np.abs(equal.mean(axis=0) - 0.3).max() < 0.08 and set(equal.sum(axis=1)) == {9.0}


def test_other_seeds_give_other_samples(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 9)), "abc"[k % 3]) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [{r.doc_id: r.taken for r in mixing.mix(d, seed=seed).collect()} for seed in (0, 0, 1, 99)]
    assert taken[0] == taken[1] and taken[0] != taken[2] and taken[2] != taken[3]
    total = sum(1 + k % 9 for k in range(600))
    size = {s: sum(1 + k % 9 for k in range(600) if "abc"[k % 3] == s) for s in "abc"}
    due = {"a": total / 6, "b": total / 3, "c": total / 2}  # none above three times its size
    assert all(due[s] <= 3 * size[s] for s in "abc")
    for t in taken:
        assert all(abs(sum(t[k] for k in range(600) if "abc"[k % 3] == s) - due[s]) <= 2 for s in "abc")


def test_toxic_rows_of_one_id_leave_room(spark):
    """One labelled id with very many texts takes one place of the fit; both classes and the other ids stay."""
    ids = [k for k in range(1, 400) if __import__("zlib").crc32(str(k).encode()) % 5][:150]
    hot, rng, neutral = ids[0], random.Random(6), [f"n{k}" for k in range(300)]
    rows = [(hot, f"vile horrid {k}") for k in range(300)] + [(k, ("vile nasty horrid " if j % 4 == 0 else "calm words ") + " ".join(rng.choices(neutral, k=12))) for j, k in enumerate(ids) if k != hot]
    labels = spark.createDataFrame([(k, int(j % 4 == 0)) for j, k in enumerate(ids)], "doc_id long, toxic int")
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    texts, toxic = toxicity.training_sample(docs_, labels, bound=30)
    assert len(texts) == 120 and sum(toxic) == 30
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs_, labels, bound=30).collect()}
    assert min(s for k, s in scores.items() if k in ids[4::4]) > 0.5 > max(s for k, s in scores.items() if k in ids[1::4])


def test_quiet_segments_count_whole():
    """Texts whose quiet segments are folded give the field of one long likelihood: more quiet text, lower chance to start toxic."""
    rng = random.Random(2)
    texts = [" ".join(f"n{rng.randrange(200)}" for _ in range(70)) + (" vile horrid" if k % 3 == 0 else "") for k in range(90)]
    toxic = [int(k % 3 == 0) for k in range(90)]
    short, long = (toxicity.fit([t + " calm" * n for t in texts], toxic) for n in (0, 640))
    assert (long.move[0, 1] - long.move[0, 0]) < (short.move[0, 1] - short.move[0, 0])


def test_field_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    field = toxicity.Field(np.zeros(0, np.uint64), np.zeros(0, np.int64), rng.normal(size=2), rng.normal(size=(2, 2)), np.concatenate([[-0.3], rng.normal(size=4)]), np.zeros(0))
    for n, at in ((6, [1, 4]), (5, [0, 1, 2, 3, 4]), (7, [6])):
        kinds = rng.integers(1, 5, len(at))
        every = np.zeros(n, int)
        every[at] = kinds
        total, sums = 0.0, np.zeros(n)
        for tags in product((0, 1), repeat=n):
            score = field.start[tags[0]] + sum(field.move[a, b] for a, b in zip(tags, tags[1:], strict=False)) + sum(field.emit[k] for k, t in zip(every, tags, strict=True) if t)
            total += np.exp(score)
            sums += np.exp(score) * np.array(tags)
        assert np.allclose(field.marginals(np.array(at), kinds, n), (sums / total)[at], atol=1e-9)


def test_toxic_spans_and_bounds(spark):
    bad = "vile nasty horrid"
    rng = random.Random(3)
    neutral = [f"n{k}" for k in range(300)] + ["é"] * 30
    text = lambda toxic: " ".join(rng.choices(neutral, k=30) + ([f"é {bad}"] if toxic else []) + rng.choices(neutral, k=5))
    rows = [(k, text(k % 3 == 0)) for k in range(400)]
    d = spark.createDataFrame([*rows, (1000, "é " * 40_000 + bad), (None, bad), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, labels).collect()}
    assert all((got[k].score >= 0.5) == (k % 3 == 0) for k, _ in rows)
    words = {(80_000 + a, 80_000 + b) for a, b in ((0, 4), (5, 10), (11, 17))}
    assert words & {(s.start, s.end) for s in got[1000].spans} and {(s.start, s.end) for s in got[1000].spans} <= words
    texts, toxic = toxicity.training_sample(d, labels, bound=20, bytes_=4000)
    assert 0 < sum(toxic) <= 20 and sum(len(t.encode()) for t, x in zip(texts, toxic, strict=True) if x) <= 2000
    assert d.filter("doc_id is null").select(toxicity.held_out("doc_id")).first()[0] is False


#: forms that the made sentences do not have: other words around, other names, digits and endings in other places
UNSEEN = [
    ("jane.doe [at] mail [dot] org", True), ("drop a line: k.meyer(at)uni-bonn(dot)de today", True), ("my ssn, if you must know: 219-09-9999", True), ("123-45-6789", True), ("ring me on 415-555-2671 tonight", True),
    ("text (212) 555-0199 whenever", True), ("transfer to DE89 3704 0044 0532 0130 00 please", True), ("GB82WEST12345698765432", True), ("ping zora at example dot net", True), ("fax 303.555.7788", True),
    ("me at home dot it", False), ("we met at noon dot it was fine", False), ("look at the last dot product", False), ("part 000-12-3456", False), ("batch 219-00-1234 shipped", False), ("id 912-34-5678", False),
    ("range 012-555-0187", False), ("model 415-155-2671", False), ("DE00370400440532013000", False), ("order 415-555-2671 and 2", False), ("isbn 978-3-16", False), ("serial 219-09-9999", False),
]


def test_personal_data_in_unseen_forms():
    model = pii.Model()
    found = {text: any(k in pii.EXTRA for k, _, _ in model.spans(text)) for text, _ in UNSEEN}
    right = [text for text, truth in UNSEEN if truth and found[text]]
    wrong = [text for text, truth in UNSEEN if not truth and found[text]]
    assert len(right) / sum(t for _, t in UNSEEN) >= 0.9 and len(right) / max(1, len(right) + len(wrong)) >= 0.9, (set(t for t, x in UNSEEN if x) - set(right), wrong)
    # sentences of another seed and of words that the fit has not seen
    other = [(re.sub(r"^(the |well, )?", "qua ", text), kind, label) for text, kind, *_, label in pii.training_rows(600, seed=99) if kind in pii.EXTRA]
    hits = [(any(k == kind for k, _, _ in model.spans(text)), label) for text, kind, label in other]
    caught, reported = sum(h and y for h, y in hits), sum(h for h, _ in hits)
    assert caught / sum(y for _, y in hits) > 0.9 and caught / reported > 0.9


def test_bytes_that_are_no_text(spark):
    """Invalid UTF-8 in a string column, and very long texts, for every operator."""
    raw = spark.createDataFrame([(1, bytearray(b"password=abcdefghijkl \xff\xfe x@y.com 1.2.3.4")), (2, bytearray(b"\xff" * 300)), (3, bytearray(("wörter " * 60_000).encode())), (4, bytearray(b"x" * 400_000))], "doc_id long, b binary")
    d = raw.select("doc_id", F.col("b").cast("string").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "password abcdefghijkl")], "item_id long, text string")
    runs = [
        lambda x: pii.find_pii(x, rows=400), near_dedup.near_duplicates, near_dedup.drop_near_duplicates, substring_dedup.remove_repeats, lambda x: decontaminate.decontaminate(x, bench), lambda x: token_count.token_counts(x, MODEL_FILE),
        secrets_scan.find_secrets, lambda x: secrets_scan.find_secrets(x, redacted=True), mixing.mix, fingerprint.fingerprints, licenses.scan_licenses, lambda x: toxicity.score_toxicity(x, labels),
    ]
    for run in runs:
        assert run(d).select("doc_id").distinct().count() == 4
    assert [(s["kind"], s["start"], s["end"]) for s in pii.find_pii(d, rows=400).filter("doc_id = 1").first().spans] == [("email", 25, 32), ("ip", 33, 40)]


def test_all_parts_of_a_dotted_token():
    rng = random.Random(4)
    parts = ["A1" + "".join(rng.choices(BASE64[:62], k=n)) for n in (34, 90, 41)]
    text = f"Bearer {'.'.join(parts)}. Key facts"
    assert [text[a:b] for k, a, b in secrets_scan.spans(text) if k == "novel"] == parts
    short = f"Bearer {'v1.' * 20}{parts[2]} end"
    assert [short[a:b] for k, a, b in secrets_scan.spans(short)] == [parts[2]]
    assert secrets_scan.spans("the key responsibilities of it") == []


def test_likeness_of_long_repetitive_texts():
    rng = random.Random(3)
    for n in (40_000, 65_536):
        text = "ab " * n
        prints = fingerprint.Prints.of(pa.array([text, fingerprint.edited(text, " ".join(f"w{rng.randrange(10**9)}" for _ in range(n)))]))
        first, second = prints.take([0]), prints.take([1])
        assert abs(fingerprint.likeness(first, second)[0] - 0.8) < 0.01 and fingerprint.likeness(first, first)[0] == 1
        # the written lanes stay 256 numbers of 16 bits
        assert first.text()[0][64:] == (first.lanes[0] % (1 << 16)).astype(np.uint16).tobytes().hex() and len(first.text()[0]) == 64 + 256 * 4
