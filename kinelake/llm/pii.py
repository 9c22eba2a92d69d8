"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of eight kinds; boosted trees score each from its format and its
context; calibrated thresholds (one for each kind) select what is redacted. Spans of the four base kinds that pass
their checks (octets, Luhn, number of digits) always stay; the trees decide on the other kinds, where they do not
overlap a base span. The trees are fitted on ``rows`` sentences made from a seed, half of which set the calibration
(Platt) and the thresholds; no corpus row is used. Names and hosts in them are random syllables. The features know no
context words of their own: the weight of a word is learned from the sentences, and one that they lack weighs nothing.

Defined cases: null and empty texts have no spans; spans count code points, end exclusive; bytes that are no UTF-8 are
taken as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .boosting import Boosting

BASE = ("email", "ip", "card", "phone")
EXTRA = ("spoken_email", "local_phone", "national_id", "iban")
KINDS = BASE + EXTRA
ROWS, SEED, PRECISION = 8000, 7, 0.98
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OTHER = {
    "spoken_email": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\((?i:at)\)|\[(?i:at)\]| (?i:at) ) ?(?:[A-Za-z0-9-]{1,63} ?(?:\((?i:dot)\)|\[(?i:dot)\]| (?i:dot) ) ?){1,4}[A-Za-z]{2,10}(?![A-Za-z])"),
    "local_phone": re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
#: fixed values: common endings of host names, and common words that stand before or after "at" and "dot" in prose
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app ai co uk de fr it es nl be ch at eu us ca au jp cn in br ru se no dk fi pl pt cz gr ie nz za mx".split())
COMMON = frozenset(
    "i me you he she it we us they them this that these those who what all any some most least once last first next time day night home work school house end top bottom back front side place point line look looked looking "
    "stay stayed meet met be was is are were been arrive arrived good bad better best not the a an to of on in by for with from or and but so as if then than there here now again one two three small big red blue product".split()
)
_SPLIT = re.compile(r"(?i)\W+(?:at|dot)\W+")
_WORDS = re.compile(r"[a-z]+")


def context(text: str, start: int) -> list[str]:
    """Stems of the words before a span, the nearest last."""
    return [w[:5] for w in _WORDS.findall(text[max(0, start - 32) : start].lower())][-3:]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of the base kinds."""
    for a, b in emails(text):
        yield "email", a, b, True
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            yield "ip", at, at + size, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own)
            at += size + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield "card", m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    found = list(base_candidates(text))
    for kind, pattern in _OTHER.items():
        if kind != "spoken_email" or "dot" in text.lower():
            found += [(kind, m.start(), m.end(), False) for m in pattern.finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int, passed: bool, weights: dict[str, float] | None = None) -> list[float]:
    own, before, after = text[start:end], text[max(0, start - 1) : start], text[end : end + 1]
    digits = "".join(c for c in own if c in "0123456789")
    n = max(1, len(own))
    iban = area = ending = common = 0.0
    if kind == "iban":
        turned = own.replace(" ", "")
        iban = float(int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97 == 1)
    elif kind == "national_id":
        area = float(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    elif kind == "local_phone":
        area = float(digits[0] not in "01" and digits[3] not in "01")
    elif kind == "spoken_email":
        parts = [w.lower() for w in _SPLIT.split(own)]
        ending, common = float(parts[-1] in ENDINGS), sum(w in COMMON for w in parts[:-1]) / max(1, len(parts) - 1)
    separators = {c for c in own if not c.isalnum()}
    return [
        float(KINDS.index(kind)), float(len(own)), len(digits) / n, sum(c.isupper() for c in own) / n, float(sum(not c.isalnum() for c in own)), float(len(set(digits))), float(passed), float(luhn(digits)),
        sum((weights or {}).get(w, 0.0) for w in context(text, start)), float(before.isspace() or not before), float(not after or after in " .,;:!?)\n"), float(own.startswith(("+", "("))),
        iban, area, ending, common, float("[" in own or ("(" in own and kind == "spoken_email")), float(len(separators)), float("000" in own or "123456" in own), float(digits[0]) if digits else -1.0,
    ]


#: words of the made sentences: before personal data, before other numbers, before both
_LEADS = (
    "call|phone|contact|my number is|write to|account|card|ssn|iban|reach me at|host|mobile|fax|mail|bank account|social security|tel|text me on|address".split("|"),
    "order|invoice|version|ticket|part|serial|isbn|total|ref|build|item|model|score|step|page|article|sku|batch|revision|lot".split("|"),
    "|the|see|and|here is|it is|with|then|for|we saw|as in|that is|note|from|about".split("|"),
)


def _name(r: random.Random) -> str:
    own = "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") for _ in range(r.randrange(2, 5)))
    return own + r.choice(("", "", "", str(r.randrange(100))))


def _made(r: random.Random, kind: str, good: bool) -> str:
    """A string of the kind; one that is not good breaks a rule of its format."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{_name(r)}{r.choice('._-')}{_name(r)}@{_name(r)}.{r.choice(sorted(ENDINGS))}"
    if kind == "ip":
        return ".".join(str(r.randrange(256 if good else 900)) for _ in range(4))
    if kind == "card":
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c) == good)
    if kind == "phone":
        return f"+{r.randrange(1, 99)} ({digits(3)}) {digits(3)}-{digits(4 if good else 1)}"
    if kind == "national_id":
        return f"{r.randrange(1, 666):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}" if good else r.choice((f"000-{digits(2)}-{digits(4)}", f"9{digits(2)}-{digits(2)}-{digits(4)}", f"{digits(3)}-00-{digits(4)}", f"{digits(3)}-{digits(2)}-0000"))
    if kind == "local_phone":
        one, two = (f"{r.choice('23456789')}{digits(2)}" for _ in range(2))
        if not good:
            one, two = r.choice(((f"{r.choice('01')}{digits(2)}", two), (one, f"{r.choice('01')}{digits(2)}")))
        c = r.choice("-. ")
        return f"({one}) {two}-{digits(4)}" if r.random() < 0.2 else f"{one}{c}{two}{c}{digits(4)}"
    if kind == "iban":
        country, body = r.choice(("DE", "GB", "FR", "NL", "ES", "IT")), digits(r.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        own = f"{country}{check if good else (check + r.randrange(1, 90)) % 97:02d}{body}"
        return " ".join(own[k : k + 4] for k in range(0, len(own), 4)) if r.random() < 0.3 else own
    at, dot = r.choice(((" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) ")))
    if good:
        return f"{_name(r)}{r.choice(('', '.' + _name(r)))}{at}{_name(r)}{dot}{r.choice(sorted(ENDINGS))}"
    # prose: common words around "at" and "dot", or no ending of a host name
    words = sorted(COMMON)
    return r.choice((f"{r.choice(words)} at {r.choice(words)} dot {r.choice(('it', 'in', 'at', 'product', 'one', _name(r)))}", f"{_name(r)} at {r.choice(words)} dot {_name(r)}", f"{_name(r)} at {_name(r)} dot {_name(r)}xq"))


def training_rows(rows: int = ROWS, seed: int = SEED) -> Iterator[tuple[str, str, int, int, bool, int]]:
    """Made sentences with one candidate each: (text, kind, start, end, passed, label). A good string is personal data
    but after a word that says that it is another number; a bad one never is."""
    r = random.Random(seed)
    made = 0
    while made < rows:
        kind, good, lead = r.choice(KINDS), r.random() < 0.6, r.choice((0, 1, 2, 2))
        label = int(good and lead != 1)
        own = _made(r, kind, good)
        before = r.choice(_LEADS[lead])
        text = f"{r.choice(('the ', '', 'well, '))}{before}{r.choice((' ', ': ')) if before else ''}{own}{r.choice((' now', '.', ', and', '', ' or so'))}"
        start = text.index(own)
        passed = next((c[3] for c in candidates(text) if c[:3] == (kind, start, start + len(own))), None)
        if passed is not None:
            made += 1
            yield text, kind, start, start + len(own), passed, label


class Model:
    """Trees, Platt calibration and a threshold for each kind."""

    def __init__(self, rows: int = ROWS, seed: int = SEED, precision: float = PRECISION):
        made = list(training_rows(rows, seed))
        y, half = np.array([m[5] for m in made], float), len(made) // 2
        #: weight of a context word: its log-odds in the first half of the sentences
        seen: dict[str, list[int]] = {}
        for text, _, start, _, _, label in made[:half]:
            for w in set(context(text, start)):
                seen.setdefault(w, [0, 0])[label] += 1
        self.weights = {w: float(np.log((a + 1) / (b + 1))) for w, (b, a) in seen.items() if a + b >= 5}
        x = np.array([features(*m[:5], self.weights) for m in made])
        self.trees = Boosting().fit(x[:half], y[:half])
        raw, truth = self.trees.raw(x[half:]), y[half:]
        self.a, self.b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(self.a * raw + self.b)))
            w, d = p * (1 - p) + 1e-9, truth - p
            step = np.linalg.solve(np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]]), [(d * raw).sum(), d.sum()])
            self.a, self.b = self.a + step[0], self.b + step[1]
        chance = 1 / (1 + np.exp(-(self.a * raw + self.b)))
        self.threshold = {}
        for k, kind in enumerate(KINDS):
            own = x[half:, 0] == k
            order = np.argsort(-chance[own], kind="stable")
            right = np.cumsum(truth[own][order]) / np.arange(1, own.sum() + 1)
            enough = np.flatnonzero(right >= precision)
            self.threshold[kind] = max(0.5, float(chance[own][order][enough[-1]])) if len(enough) else 1.1

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Selected spans, by start, then kind as listed."""
        found = candidates(text)
        if not found:
            return []
        raw = self.trees.raw(np.array([features(text, *c, self.weights) for c in found]))
        chance = 1 / (1 + np.exp(-(self.a * raw + self.b)))
        kept = [c[:3] for c in found if c[3]]
        base = sorted((a, b) for _, a, b in kept)
        starts, reached = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        own: list[tuple[int, int]] = []  # ascending, and without overlaps
        for c, p in sorted(zip(found, chance, strict=True), key=lambda x: (-x[1], x[0][1])):
            kind, a, b, _ = c
            if kind not in EXTRA or p < self.threshold[kind]:
                continue
            k, j = bisect_left(starts, b), bisect_left(own, (b, b))
            if not (k and reached[k - 1] > a) and not (j and own[j - 1][1] > a):
                kept.append((kind, a, b))
                insort(own, (a, b))
        return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_pii(docs: DataFrame, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """doc_id and spans (array of kind, start, end), for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(rows, seed))
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    signs = np.zeros(256, bool)
    signs[[ord(c) for c in "0123456789@"]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in T.pieces(batch):
                buf, offsets = T.flat(piece.column(1))
                hits = np.concatenate([[0], np.cumsum(signs[buf])])[offsets]
                out = []
                for d in range(piece.num_rows):
                    own = buf[offsets[d] : offsets[d + 1]].tobytes()
                    # a span of any kind has a digit or an @, but for spoken addresses, which say "dot"
                    out.append(model.spans(own.decode("utf-8", "replace")) if hits[d] < hits[d + 1] or b"dot" in own.lower() else [])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in out], kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
