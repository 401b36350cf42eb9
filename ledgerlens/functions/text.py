"""Text functions as Catalyst expressions: slugs, names, sentences, pattern matches with offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, the no-break space included.
SPACES = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACES, " "))


def _slug(text: Column, joint: str) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")
    return F.when(trimmed == "", F.lit("unknown")).otherwise(trimmed)


def graph_slug(text: Column) -> Column:
    return _slug(text, "_")


def resource_slug(text: Column) -> Column:
    return _slug(text, "-")


def resource(kind: Column, key: Column) -> Column:
    return F.concat(resource_slug(kind), F.lit("/"), resource_slug(key))


def camel(text: Column) -> Column:
    parts = F.split(text, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 10_000))))
    return F.concat(parts[0], F.array_join(rest, ""))


def padded_cik(cik: Column) -> Column:
    """Ten digits at least; longer numbers keep all of theirs."""
    return F.format_string("%010d", cik.cast("bigint"))


def index_ticker(ticker: Column) -> Column:
    return F.upper(F.replace(ticker, F.lit("."), F.lit("-")))


def sentences(text: Column, least: int = 80, most: int = 800) -> Column:
    """Trimmed sentences (cut after . or ; and white space) of least to most characters."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.;])\s+"), strip)
    return F.filter(parts, lambda s: F.length(s).between(least, most))


def matches(text: Column, pattern: str) -> Column:
    """All matches as array<struct<text, start, end>>: offsets come from the lengths of matches and of the gaps between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    starts = F.transform(
        F.sequence(F.lit(1), F.size(found)),
        lambda k: F.aggregate(F.slice(gaps, F.lit(1), k), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice(found, F.lit(1), k - 1), F.lit(0), lambda n, g: n + F.length(g)),
    )
    rows = F.zip_with(found, starts, lambda m, s: F.named_struct(F.lit("text"), m, F.lit("start"), s, F.lit("end"), s + F.length(m)))
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<text:string,start:int,end:int>>"))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether one of the (lower-case) words is in the text, whatever its case."""
    return F.lower(text).rlike("|".join(words))


def tolerant_json(text: Column) -> Column:
    """The JSON object of a reply: all of it, the fenced part, or what the outermost braces hold; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(F.when(F.try_parse_json(x).isNotNull(), x) for x in (text, fenced, braces)))
