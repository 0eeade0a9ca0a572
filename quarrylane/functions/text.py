"""Text expressions: slugs, keys, number parsing, softening, terms and sort keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric names looked for in questions, and words that are no terms.
METRIC_TERMS = (
    "adjusted net income", "allowance for credit losses", "assets under administration", "assets under management",
    "book value per share", "capital ratio", "cet1", "common equity tier 1", "diluted eps", "efficiency ratio", "expenses",
    "impaired loans", "leverage ratio", "net income", "net interest income", "net interest margin", "non-interest expense",
    "non-interest income", "provision for credit losses", "return on equity", "revenue", "risk-weighted assets", "roe", "rwa",
    "total assets", "total revenue",
)
STOP_WORDS = (
    "about", "across", "after", "also", "and", "are", "bank", "banks", "can", "compare", "did", "does", "for", "from", "give",
    "has", "have", "how", "into", "its", "latest", "me", "of", "on", "please", "q1", "q2", "q3", "q4", "show", "tell", "the",
    "their", "this", "through", "trend", "was", "were", "what", "with", "year",
)
# Numbers of a hypothetical answer, in order, and what stands for them.
SOFTENED = (
    (r"\b\d+(?:\.\d+)?\s*-\s*\d+(?:\.\d+)?%", "a reported percentage range"),
    (r"\b\d+(?:\.\d+)?%", "a reported percentage"),
    (r"(?i)\b\d+(?:\.\d+)?\s*bps?\b", "a reported basis-point change"),
    (r"(?i)\b(?:CAD|USD|C\$|\$)\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:million|billion|bn|mm))?\b", "a reported amount"),
    (r"(?i)\b\d[\d,]*(?:\.\d+)?\s*(?:million|billion|bn|mm)\b", "a reported amount"),
    (r"\s{2,}", " "),
)


def slug(c: Column) -> Column:
    """Runs of anything but letters and digits become one hyphen; none at either end."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")


def file_id(*parts: Column) -> Column:
    return F.concat_ws("_", *[slug(p) for p in parts])


def metric_key(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def compact(c: Column, limit: int) -> Column:
    """Collapsed text of at most ``limit`` characters, the cut shown by dots."""
    flat = collapsed(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def first_present(*aliases: Column) -> Column:
    """The first alias that is neither null nor empty; the last may be empty."""
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in aliases[:-1]], aliases[-1])


def parse_number(c: Column) -> Column:
    """The first number of a text such as ``$1,234.5``; one in parentheses is negative; null without a number."""
    clean = F.regexp_replace(F.trim(c), "[$,]", "")
    number = F.regexp_extract(clean, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    # Only texts with a digit are cast, as a cast that fails is slow.
    return F.when(clean.rlike(r"\d"), F.when(clean.rlike(r"^\(.*\)$"), -F.abs(number)).otherwise(number))


def all_numbers(c: Column) -> Column:
    """All numbers of a text but quarters and years of this century, as doubles."""
    clean = F.regexp_replace(c, "[$,]", "")
    clean = F.regexp_replace(clean, r"(?i)\bQ[1-4]\b|\b20\d{2}\b", " ")
    return F.transform(F.regexp_extract_all(clean, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))


def softened(c: Column) -> Column:
    """Numbers of a hypothetical answer replaced by their kind, in a fixed order, so that they don't steer a search."""
    for pattern, kind in SOFTENED:
        c = F.regexp_replace(c, pattern, kind)
    return F.trim(c)


def metric_terms(c: Column, limit: int = 8) -> Column:
    """Metric names that occur in a text, in the list's order."""
    low = F.lower(c)
    return F.slice(F.filter(F.array(*map(F.lit, METRIC_TERMS)), lambda t: F.contains(low, t)), 1, limit)


def key_terms(c: Column, metrics: Column, limit: int = 12) -> Column:
    """Distinct words that are no stop words and no word of a matched metric, in order of first occurrence."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9&/-]{2,}"), F.lit(0))
    taken = F.flatten(F.transform(metrics, lambda m: F.split(m, " ")))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w) & ~F.array_contains(taken, w))), 1, limit)


def merged_terms(*lists: Column, limit: int = 8) -> Column:
    """Ordered union of term lists: white space collapsed, unique without regard to case, first spelling kept."""
    flat = F.filter(F.transform(F.concat(*lists), collapsed), lambda t: t != "")
    low = F.transform(flat, F.lower)
    keep = F.filter(F.transform(flat, lambda t, i: F.struct(t.alias("t"), (F.array_position(low, F.lower(t)) == i + 1).alias("first"))), lambda x: x["first"])
    return F.slice(F.transform(keep, lambda x: x["t"]), 1, limit)


def search_term(c: Column) -> Column:
    """A term of a full-text query: letters and digits, ``%`` spelled out, one space between words."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("%"), F.lit(" percentage ")), "[^A-Za-z0-9]+", " "))


def fulltext_query(metrics: Column, keywords: Column, fallback: Column, limit: int = 10) -> Column:
    """Terms joined by OR, phrases in quotes; the fallback, as one term, where there are none."""
    quote = lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    terms = merged_terms(F.transform(F.concat(metrics, keywords), search_term), limit=limit)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, quote), " OR ")).otherwise(quote(search_term(fallback)))


def fulltext_text(terms: list[str], fallback: str, limit: int = 10) -> str:
    """The same query from terms on the driver: those of one question."""
    clean = lambda t: re.sub("[^A-Za-z0-9]+", " ", t.replace("%", " percentage ")).strip()
    first: dict[str, str] = {}
    for t in map(clean, terms):
        first.setdefault(t.lower(), t)
    first.pop("", None)
    quote = lambda t: f'"{t}"' if " " in t else t
    return " OR ".join(map(quote, list(first.values())[:limit])) or quote(clean(fallback))


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike(r"^\d"), r.try_cast("long")).otherwise(F.lit(-1).cast("long")).alias("n"), r.alias("s")))


def page_of(chunk_id: Column) -> Column:
    """Page or sheet number of ids such as ``page_12.1``."""
    return F.regexp_extract(chunk_id, r"_(\d+)\.", 1).try_cast("int")


def minor_of(chunk_id: Column) -> Column:
    return F.regexp_extract(chunk_id, r"\.(\d+)$", 1).try_cast("int")


def period_key(label: Column) -> Column:
    """Sortable number of a label such as ``Q2 2024``; -1 where it can't be read."""
    year, quarter = F.regexp_extract(label, r"(20\d{2})", 1).try_cast("int"), F.regexp_extract(label, r"(?i)Q([1-4])", 1).try_cast("int")
    return F.coalesce(year * 4 + quarter, F.lit(-1))


def normalised_year(c: Column) -> Column:
    """Year text without a leading FY."""
    return F.regexp_replace(F.trim(c), "(?i)^FY", "")


def redacted(c: Column) -> Column:
    """Secrets masked in log text."""
    return F.regexp_replace(c, r"(?i)\b(token|password|secret|api[_-]?key)\b(\s*[=:]\s*)\S+", "$1$2***")


def call_period(title: Column) -> Column:
    """(quarter, year) of a title such as ``Q2 2024 Earnings Call``; nulls where it is no such title."""
    rule = r"(?i)\bQ([1-4])\s+(20\d{2})\s+Earnings\s+Call\b"
    part = lambda i: F.regexp_extract(title, rule, i).try_cast("int")
    return F.struct(part(1).alias("quarter"), part(2).alias("year"))
