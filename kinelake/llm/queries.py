"""Queries of the corpus operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, fill_middle, fingerprint, language, licenses, mixing, near_dedup, pii, secrets_scan, substring_dedup, token_count, toxicity

#: the public vocabulary of op5; a parameter of the operator, never part of the repository
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans."""
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_pii(_table(spark, sf_dir, "documents")), pii.BASE)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), MODEL_FILE)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets_scan.find_secrets(_table(spark, sf_dir, "documents")), secrets_scan.BASE)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("toxic_spans"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_near_dedup, op3_substring_dedup, op4_decontaminate, op5_token_counts, op6_secrets, op7_mix, op8_fingerprints, op9_licenses, op10_toxicity, op11_language, op12_fill_middle, op13_collocations)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM {table}),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i : i + {width} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= {percent} * (x.n + y.n - p.i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM {table} UNION SELECT both_ways.b, r.c FROM r JOIN both_ways ON r.doc_id = both_ways.a WHERE r.c < both_ways.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM {table} d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i : i + least(len(ws), 10) - 1], ' '))) AS g
  FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT k FROM g),
place AS (SELECT doc_id, k.k, unnest(range(1, len(ws) - k.k + 2)) AS i, ws FROM d, k WHERE len(ws) >= k.k),
hit AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM place p JOIN g ON g.k = p.k AND g.g = array_to_string(p.ws[p.i : p.i + p.k - 1], ' ')),
word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(word.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(item.ids, '')) AS items_sha256, coalesce(word.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""

#: crc32 of a decimal number, bit by bit: a byte is taken in, then eight steps shift
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))), lambda h, o: CASE WHEN o >= 0 THEN xor(h, o) ELSE xor(h >> 1, (h & 1) * 3988292384) END), 4294967295)"

LANGUAGE_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce({_CRC} % {language.FOLDS} = {language.HELD}, false) AS held_out, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}]+') AS ws FROM documents),
w AS (SELECT doc_id, lang, held_out, unnest(ws) AS w FROM d), c AS (SELECT doc_id, lang, held_out, w, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, lang, held_out, n, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: w[i : i]), list_transform(range(1, length(w) + 2), lambda i: (' ' || w || ' ')[i : i + 1]), list_transform(range(1, length(w) + 1), lambda i: (' ' || w || ' ')[i : i + 2]))) AS g FROM c),
f AS (SELECT doc_id, g, sum(n) AS n FROM g GROUP BY ALL),
own AS (SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS place FROM f) WHERE place < {language.TOP}),
known AS (SELECT lang, g, sum(n) AS n FROM g WHERE lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held_out GROUP BY ALL),
profile AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS place FROM known) WHERE place < {language.TOP}),
sizes AS (SELECT doc_id, count(*) AS m FROM own GROUP BY doc_id), langs AS (SELECT DISTINCT lang FROM profile),
near AS (SELECT o.doc_id, p.lang, sum({language.TOP} - abs(o.place - p.place)) AS saved FROM own o JOIN profile p ON p.g = o.g GROUP BY ALL),
far AS (SELECT s.doc_id, l.lang, s.m, s.m * {language.TOP} - coalesce(n.saved, 0) AS far FROM sizes s CROSS JOIN langs l LEFT JOIN near n ON n.doc_id = s.doc_id AND n.lang = l.lang),
best AS (SELECT doc_id, m, far, lang FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT d.doc_id, d.held_out, CASE WHEN len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) > 0 THEN coalesce(best.lang, 'und') ELSE 'und' END AS lang_pred,
  CASE WHEN len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) > 0 AND best.lang IS NOT NULL THEN 1 - best.far::DOUBLE / (best.m * {language.TOP}) ELSE 0.0 END AS score
FROM d LEFT JOIN best ON best.doc_id = d.doc_id
"""

MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
d AS (SELECT *, CAST(len(ts) AS BIGINT) AS n, list_transform(range(4), lambda k: ('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT) AS hs FROM t),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(ts[1 : a], '') AS p, array_to_string(ts[a + 1 : b], '') AS m, array_to_string(ts[b + 1 :], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

PHRASE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
cut AS (SELECT lang, words, phrase, a, ws, unnest(range(1, words)) AS k FROM c),
s AS (SELECT c.lang, c.words, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score FROM cut c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 :], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, words, a, ws, unnest(range(2, words)) AS k FROM c),
sub AS (SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, unnest(list_transform(range(1, words - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM inside) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN sub ON sub.lang = low.lang AND sub.phrase = low.phrase WHERE sub.f IS NULL OR 100 * sub.f < 100 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": NEAR_SQL.format(lower=_LOWER, table="documents", width=3, percent=85),
    "op4_decontaminate": LEAK_SQL,
    "op11_language": LANGUAGE_SQL,
    "op12_fill_middle": MIDDLE_SQL,
    "op13_collocations": PHRASE_SQL,
}
