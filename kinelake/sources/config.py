"""Configurations: nested mappings from text, with dotted overrides, and their snapshot."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import put_texts

_NUMBER = re.compile(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$")


def scalar(text: str) -> Any:
    """null, true, false, numbers, quoted and plain texts, and lists of these in brackets."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return [scalar(x) for x in re.findall(r"""(?:"[^"]*"|'[^']*'|[^,])+""", inner)] if inner else []
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    low = text.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    if _NUMBER.match(text):
        return int(text) if re.match(r"[-+]?\d+$", text) else float(text)
    return text


def parse(text: str) -> Any:
    """Block mappings and lists by indentation, as configuration files use them; JSON too."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    lines = []
    for raw in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if bare.strip():
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(k: int, indent: int) -> tuple[Any, int]:
        out: Any = [] if lines[k][1].startswith("- ") or lines[k][1] == "-" else {}
        while k < len(lines) and lines[k][0] == indent:
            own = lines[k][1]
            if isinstance(out, list):
                if not (own.startswith("- ") or own == "-"):
                    break
                out.append(scalar(own[1:]))
                k += 1
                continue
            name, found, rest = own.partition(":")
            if not found or own.startswith("- "):
                break
            name = str(scalar(name))
            deeper = k + 1 < len(lines) and (lines[k + 1][0] > indent or (lines[k + 1][0] == indent and lines[k + 1][1].startswith("- ")))
            if rest.strip() or not deeper:
                out[name] = scalar(rest)
                k += 1
            else:
                out[name], k = block(k + 1, lines[k + 1][0])
        return out, k

    if not lines:
        return {}
    out, end = block(0, lines[0][0])
    if end != len(lines):
        raise ValueError(f"line not understood: {lines[end][1]!r}")
    return out


def merged(base: dict, *others: dict) -> dict:
    """Later mappings over earlier ones, key by key; anything else is replaced as a whole."""
    out = dict(base)
    for other in others:
        for key, value in other.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def dotted(overrides: list[str]) -> dict:
    """Mapping of texts like ``a.b=3``."""
    out: dict = {}
    for text in overrides:
        path, found, value = text.partition("=")
        if not found:
            raise ValueError(f"not an override: {text!r}")
        here = out
        *heads, last = path.strip().split(".")
        for name in heads:
            here = here.setdefault(name, {})
        here[last] = scalar(value)
    return out


def flat(config: dict, head: str = "") -> list[tuple[str, str]]:
    """(dotted path, JSON text of the value) of every leaf, in order of paths."""
    found = []
    for key, value in config.items():
        found += flat(value, f"{head}{key}.") if isinstance(value, dict) and value else [(f"{head}{key}", json.dumps(value))]
    return sorted(found)


def snapshot(spark: SparkSession, config: dict, folder: str) -> None:
    """The configuration of a run, beside its results."""
    put_texts(spark, folder, [("config.json", json.dumps(config, indent=2, sort_keys=True))])


def load(spark: SparkSession, path: str) -> dict:
    return parse(spark.read.text(path, wholetext=True).select(F.col("value")).first()["value"])


def leaves(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame(flat(config), "path string, value string")


def both_arms(items: list) -> tuple[Any, Any, float | None]:
    """(left, right, distance) of one embodiment for both arms, or of three items: left, right and their distance."""
    if len(items) == 1:
        return items[0], items[0], None
    if len(items) == 3:
        return items[0], items[1], float(items[2])
    raise ValueError("one embodiment or three items are needed")
