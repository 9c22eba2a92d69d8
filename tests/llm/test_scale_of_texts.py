"""Large benchmarks, long texts full of hits, and lines of texts."""

import random
import time

from kinelake.llm import decontaminate, fingerprint, near_dedup, pii, secrets_scan


def test_large_benchmarks_go_through_a_table(spark, monkeypatch):
    """Equal items, one long item and common windows; the bitmap is the only thing that is broadcast, and it is bounded."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    long = " ".join(word() for _ in range(6000))
    common = " ".join(word() for _ in range(10))
    items = [(7, common)] * 3000 + [(1, long), (2, "one two three"), (3, ""), (None, common + " tail of it"), (4, None)]
    rows = [(k, f"{word()} {common} {word()} One, two THREE {word()}" if k % 3 == 0 else " ".join(word() for _ in range(30))) for k in range(300)] + [(900, long[100:3000]), (None, None), (5, "")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, decontaminate.decontaminate(docs, bench, max_bytes=1 << 30).collect()))
    for bits in (1 << 27, 1 << 15):
        monkeypatch.setattr(decontaminate, "BITS", bits)
        assert sorted(map(str, decontaminate.decontaminate(docs, bench, max_bytes=1000).collect())) == want
    clashing = docs.selectExpr("doc_id", "text", "1 as row", "2 as _row", "3 as found_row", "4 as found", "5 as _clean_row")
    left = [sorted(map(str, decontaminate.drop_contaminated(clashing, bench, max_bytes=n).collect())) for n in (1 << 30, 1000)]
    cut = [sorted(map(str, decontaminate.cut_contaminated(clashing, bench, max_bytes=n).collect())) for n in (1 << 30, 1000)]
    assert left[0] == left[1] and cut[0] == cut[1] and 0 < len(left[0]) < len(rows)


def test_long_texts_full_of_hits_take_linear_time():
    rng = random.Random(1)
    model = pii.Model(400, pii.SEED)
    made = {
        "secrets": (secrets_scan.spans, lambda k: f"key: {rng.randrange(10**17):x}Zk{k} token=abcdefgh{k:08d} "),
        "pii": (model.spans, lambda k: f"call {rng.randrange(10**9, 10**10)} now 4111-{k:04d} +49 30 {rng.randrange(10**6, 10**7)} "),
    }
    for name, (find, part) in made.items():
        took = []
        for n in (4_000, 32_000):
            text = "".join(part(k) for k in range(n))
            began = time.process_time()
            assert len(find(text)) >= n, name
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0], (name, took)  # eight times the text; a square would be 64


def test_overlaps_are_found_by_search():
    rng = random.Random(9)
    for _ in range(300):
        spans = sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8))))
        starts, reached, top = [a for a, _ in spans], [], 0
        for _, b in spans:
            reached.append(top := max(top, b))
        for _ in range(20):
            a = rng.randrange(60)
            b = a + rng.randrange(1, 9)
            assert secrets_scan._meets(starts, reached, a, b) == any(a < e and s < b for s, e in spans)


def test_every_line_counts(spark):
    texts = ["a\n\nb", "a\nb", "b\na", "a\n", "\na", "a", "\n", "", None, "\n\n", "b\n\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # of the fingerprint the first part is the sum over lines; the lanes depend on the words' order inside the text
    wide = {r.doc_id: r.fingerprint[: 16 * fingerprint.WIDE] for r in fingerprint.fingerprints(docs).collect()}
    kinds = {}
    for k, t in enumerate(texts):
        kinds.setdefault(tuple(sorted(t.split("\n"))) if t else (), set()).add(wide[k])
    assert all(len(x) == 1 for x in kinds.values()) and len({next(iter(x)) for x in kinds.values()}) == len(kinds)


def test_near_copies_meet_in_deals(spark, monkeypatch):
    """Many copies of one text that differ in some words, each like some of the others: the sets that are compared grow
    with their number, not with its square, and no link is lost (finding on op2_near_dedup, round 3)."""
    rng, n, percent = random.Random(6), 700, 85
    base, sets = [rng.getrandbits(62) for _ in range(100)], []
    for _ in range(n):
        cut = rng.randrange(2, 8) if rng.random() < 0.9 else rng.randrange(8, 13)
        sets.append(sorted(rng.sample(base, 100 - cut) + [rng.getrandbits(62) for _ in range(rng.randrange(3))]))
    alike = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    full, top = [set(s) for s in sets], list(range(n))
    for i in range(n):
        for j in range(i):
            if top[i] != top[j] and alike(full[i], full[j]):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    monkeypatch.setattr(near_dedup, "DEAL", 8)
    compared, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *more: (compared.append(pairs.count()), confirmed(pairs, *more))[1])
    d = spark.createDataFrame([(k, k, s) for k, s in enumerate(sets)], "cid long, component long, shingles array<long>")
    found = {r.node: r.component for r in near_dedup.components(near_dedup._prefix_links(d, percent)).collect()}
    assert [found.get(k, k) for k in range(n)] == top and len(compared) > 1
    assert sum(compared) < n * n / 8, compared
