"""Instruction text: cleaning modes, padding, formatting of numbers, durations and names."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: every character that counts as blank: Unicode White_Space and U+001C to U+001F
BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: fixed values: words for true and false
TRUE_WORDS, FALSE_WORDS = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")


def strip(text: Column) -> Column:
    """Without blanks at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def whitespace_clean(text: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def canonicalize(text: Column, keep: str | None = None) -> Column:
    """Underscores become spaces, ASCII punctuation goes (but for the exact token ``keep``), lower case, blanks collapsed."""
    others = PUNCTUATION.replace("_", "")
    if keep:
        spaced = F.translate(text, "_", " ")
        bare = lambda part: F.translate(part, others, "")
        quoted = "".join(f"\\x{{{ord(c):X}}}" for c in keep)
        return whitespace_clean(F.lower(F.array_join(F.transform(F.split(spaced, quoted), bare), keep)))
    # one pass over the text: the first character has a replacement, the rest have none and go
    return whitespace_clean(F.lower(F.translate(text, "_" + others, " ")))


#: characters that bytes 0x80 to 0xBF became when UTF-8 was read as Windows-1252 (Latin-1 where that has none)
_TAIL = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xC0))
#: those of them beyond Latin-1 that took two bytes, as they look when broken once more
_TWICE = "|".join(re.escape(chr(c.encode()[0]) + _TAIL[c.encode()[1] - 0x80]) for c in _TAIL if c > "\xff" and len(c.encode()) == 2)
_BROKEN = re.compile("(?:[ÂÃ][{0}]|â[{0}]{{2}}|ð[{0}]{{3}}|{1})+".format(re.escape(_TAIL), _TWICE))
_BYTES = {c: 0x80 + k for k, c in enumerate(_TAIL)} | {c: ord(c) for c in "ÂÃâðÅÆË"}
_PLAIN = str.maketrans({**dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "\u2028": "\n", "\u2029": "\n", "\x85": "\n"})
_CONTROLS = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\ufeff\ufff9-\ufffb]")


def repair(text: str) -> str:
    """Mojibake read back (UTF-8 once read as Windows-1252 or Latin-1: characters of U+0080 to U+00FF, general
    punctuation and four-byte ones, up to three times over), curly quotes and ligatures made plain, full-width forms made
    half-width, line ends and controls cleaned, then composed (NFC). Clean text stays as it is."""

    def back(m: re.Match) -> str:
        try:
            return bytes(_BYTES[c] for c in m[0]).decode()
        except UnicodeDecodeError:
            return m[0]

    for _ in range(3):
        fixed = _BROKEN.sub(back, text)
        if fixed == text:
            break
        text = fixed
    wide = "".join(unicodedata.normalize("NFKC", c) if "\uff01" <= c <= "\uffee" else " " if c == "\u3000" else c for c in text) if re.search("[\u3000\uff01-\uffee]", text) else text
    return unicodedata.normalize("NFC", _CONTROLS.sub("", wide.translate(_PLAIN).replace("\r\n", "\n").replace("\r", "\n")))


@F.pandas_udf(StringType())
def basic_clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Encoding repaired, HTML entities resolved twice, stripped. There are no built-ins for these, hence Arrow batches."""
    for s in texts:
        yield s.map(lambda t: None if t is None else html.unescape(html.unescape(repair(t))).strip())


def clean(text: Column, mode: str) -> Column:
    """Cleaning by name: whitespace, lower or canonicalize."""
    basic = basic_clean(text)
    if mode == "whitespace":
        return whitespace_clean(basic)
    if mode == "lower":
        return F.lower(whitespace_clean(basic))
    if mode == "canonicalize":
        return canonicalize(basic)
    raise ValueError(f"unknown cleaning mode {mode!r}")


def usable_instructions(texts: Column, strict: bool = True) -> Column:
    """Stripped instructions that are not blank; none is an error (strict) or an empty array."""
    kept = F.filter(F.transform(texts, strip), lambda t: t != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit("no usable instruction"))) if strict else kept


def pad_ids(ids: Column, size: int, pad: int = 0) -> Column:
    """Exactly ``size`` ids: cut, or filled up."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)


def pad_mask(ids: Column, size: int) -> Column:
    """1 for the places that hold an id, 0 for filling."""
    n = F.size(ids)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k < n, 1).otherwise(0))


def format_number(v: Column) -> Column:
    """nan, 0.000, exponent form for very small or large values, 3 decimals from 1000, else up to 6 without zeros;
    NULL stays NULL, here and in the texts of speeds and times below."""
    size = F.abs(v)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""), r"\.$", "")
    return F.when(v.isNull(), None).when(F.isnan(v), "nan").when(v == 0, "0.000").when((size < 1e-4) | (size > 1e6), F.format_string("%.3e", v)).when(size >= 1000, F.format_string("%.3f", v)).otherwise(fixed)


def format_speed(speed: Column, unit: str) -> Column:
    return F.when(speed >= 1000, F.format_string(f"%.3fk {unit}", speed / 1000)).when(speed.isNotNull(), F.format_string(f"%.3f {unit}", speed))


def format_eta(seconds: Column) -> Column:
    whole = F.floor(seconds)
    text = F.format_string("%02dh %02dm %02ds", F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long"), (whole % 60).cast("long"))
    return F.when(seconds.isNotNull(), text)


def format_step(step: Column, digits: int) -> Column:
    return F.lpad(step.cast("string"), digits, "0")


def to_bool(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def random_name(*key, length: int = 8, suffix: str = "") -> Column:
    """A file name of ``length`` bytes in hexadecimal, by a hash of the key, with a suffix."""
    end = suffix if not suffix or suffix.startswith(".") else f".{suffix}"
    return F.concat(F.substring(F.md5(F.concat_ws("_", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))), 1, 2 * length), F.lit(end))


def rollout_name(rank: Column, number: Column, success: Column) -> Column:
    return F.concat_ws("_", rank.cast("string"), number.cast("string"), F.when(success, "success").otherwise("failure"))


def parse_rollout_name(name: Column) -> Column:
    part = lambda k: F.regexp_extract(name, r"^(\d+)_(\d+)_(success|failure)", k)
    return F.struct(part(1).cast("int").alias("rank"), part(2).cast("int").alias("number"), (part(3) == "success").alias("success"))
