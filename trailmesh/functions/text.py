"""Slugs, keys, links and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .geo import c

#: Letters that don't decompose (fixed values).
PLAIN = {"ð": "d", "þ": "th", "æ": "ae", "ø": "o", "ß": "ss"}


def slug_text(name: str) -> str:
    low = name.lower()
    for a, b in PLAIN.items():
        low = low.replace(a, b)
    low = "".join(ch for ch in unicodedata.normalize("NFD", low) if not unicodedata.combining(ch))
    return "-".join(filter(None, "".join(ch if ch.isascii() and ch.isalnum() else "-" for ch in low).split("-")))


def slug(name) -> Column:
    """Lower case, marks stripped, other characters as single hyphens. ASCII names stay in the JVM."""
    name = c(name)
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(name.rlike(r"\A[\x00-\x7F]*\z"), plain).otherwise(_slug(name))


@F.pandas_udf(StringType())
def _slug(names: pd.Series) -> pd.Series:
    return names.map(slug_text, na_action="ignore")


def pair_key(a, b) -> Column:
    return F.concat_ws("/", F.least(c(a), c(b)), F.greatest(c(a), c(b)))


NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)\z"


def strict_number(text, low: float, high: float) -> Column:
    """A plain decimal within the range, else null."""
    value = F.when(c(text).rlike(NUMBER), c(text).try_cast("double"))
    return F.when((value >= low) & (value <= high), value)


def query_map(url) -> Column:
    """Decoded query parameters of a URL as a map; the last of repeated names stays."""
    query = F.regexp_extract(c(url), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    entries = F.transform(pairs, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), F.when(p.contains("="), decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).otherwise("").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def without_params(url, names: list[str]) -> Column:
    """The URL without those parameters; others stay as they are written."""
    base, query, tail = F.substring_index(F.substring_index(c(url), "#", 1), "?", 1), F.regexp_extract(c(url), r"\?([^#]*)", 1), F.regexp_extract(c(url), r"(#.*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*names)), "&")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), tail)


def number_text(x: float) -> str:
    """A finite double as browsers write it: shortest digits, plain from 1e-6 to under 1e21, else with an exponent."""
    if x == 0:
        return "0"
    sign, digits, power = Decimal(repr(float(x))).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + power
    if 0 < point <= 21:
        out = d + "0" * (point - len(d)) if len(d) <= point else f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{d}"
    else:
        out = f"{d[0]}{'.' if d[1:] else ''}{d[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return ("-" if sign else "") + out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and numbers as browsers write them; integers that a double can't hold raise."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) <= 1 << 53:
            return str(value)
        if abs(value) >> 1023 or int(float(value)) != value:
            raise ValueError(f"{value} isn't exact as a number of JSON; write it as text")
        return number_text(float(value))
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, dict):
        named = sorted(((str(k), v) for k, v in value.items()), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in named) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


def identity(value) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def _read_int(text: str) -> int | float:
    """An integer as readers of JSON take it: a double where it is large."""
    value = int(text)
    return value if abs(value) <= 1 << 53 else float(text)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: canonical(json.loads(t, parse_int=_read_int)), na_action="ignore")


def algorithm_name(tag) -> Column:
    """What stands before the first slash of a versioned tag."""
    return F.substring_index(c(tag), "/", 1)


def id_date(name) -> Column:
    """The date of the last YYYYMMDD in an id such as ``ch-20240131``; null without one or if there is no such day."""
    return F.try_to_date(F.regexp_extract(c(name), r".*(?:\A|\D)(\d{8})(?:\D|\z)", 1), "yyyyMMdd")


def pinned_id(name, prefix: str = "ch-") -> Column:
    """Whether an edition's id is of the region whose landmarks are published."""
    return F.coalesce(c(name).startswith(prefix), F.lit(False))
