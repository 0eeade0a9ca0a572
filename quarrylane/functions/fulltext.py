"""Full-text search: OR queries of words and phrases, match and cover-density rank; postings, phrase places and BM25.

Words are runs of letters and digits in lower case; there is no stemming.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Weights of name and summary (A), keywords and metrics (B), content (C).
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _equals(term: str):
    return lambda w: w == term


def _weighted(weight: float):
    return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"))


def weighted_postings(docs: DataFrame, key: str, fields: dict[str, str], terms: list[str] | None = None) -> DataFrame:
    """``key``, ``term``, ``pos``, ``weight``: terms of several fields, positions running on from field to field.

    ``fields`` maps a text column to its weight label, in order. With ``terms``
    only theirs, filtered before anything is exploded.
    """
    parts = []
    for column, label in fields.items():
        parts.append(F.transform(tokens(F.col(column)), _weighted(LABEL_WEIGHTS[label])))
    placed = F.transform(F.concat(*parts), lambda p, i: F.struct(i.alias("pos"), p["term"].alias("term"), p["weight"].alias("weight")))
    if terms is not None:
        placed = F.filter(placed, lambda p: p["term"].isin(*terms))
    return docs.select(key, F.explode(placed).alias("p")).select(key, "p.term", "p.pos", "p.weight")


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key``, ``score`` of documents with any of the terms.

    Only counts of the query's terms leave a document, so no postings are shuffled; corpus
    statistics are one aggregation.
    """
    words = F.col("__w")
    tf = [F.size(F.filter(words, _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = docs.select(key, tokens(F.col(text)).alias("__w")).select(key, F.size(words).alias("n"), *tf)
    stats = counted.agg(
        F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    ).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.lit(float(stats.docs)) - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        f = F.col(f"tf{i}")
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.lit(stats.mean or 1.0)))).otherwise(0.0)
    any_term = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))], F.lit(False))
    return counted.where(any_term).select(key, score.alias("score"))


def phrase_matches(postings: DataFrame, key: str, phrase: str) -> DataFrame:
    """``key``, ``pos``: places where the phrase's words stand in consecutive positions; one aggregation over (document, start)."""
    words = phrase.lower().split()
    wanted = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)])).alias("q")
    hits = postings.where(F.col("term").isin(words)).select(key, "term", "pos", wanted).where("term = q.w")
    return hits.groupBy(key, (F.col("pos") - F.col("q.i")).alias("pos")).agg(F.countDistinct("q.i").alias("n")).where(F.col("n") == len(words)).select(key, "pos")


def query_terms(query: str) -> list[list[str]]:
    """Words of each term of an OR query such as ``"net income" OR revenue``."""
    return [w for t in re.split(r"\s+OR\s+", query) if (w := re.findall(TOKEN, t.lower()))]


def occurrences(text: Column, terms: list[list[str]]) -> Column:
    """Places in a text where a single word of the terms stands, or where a phrase's words stand consecutively.

    Counted by expressions over the lower-cased text: one for all single words,
    one for each phrase, whose places may overlap. No array of words is built.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    begin, end = "(?<![a-z0-9])", "(?![a-z0-9])"
    single = list(dict.fromkeys(t[0] for t in terms if len(t) == 1))
    phrases = list(dict.fromkeys(tuple(t) for t in terms if len(t) > 1))
    patterns = [f"{begin}(?:{'|'.join(single)}){end}"] if single else []
    patterns += [f"{begin}{t[0]}(?=[^a-z0-9]+{'[^a-z0-9]+'.join(t[1:])}{end})" for t in phrases]
    return sum((F.regexp_count(low, F.lit(p)) for p in patterns), F.lit(0))


def cover_rank(texts: dict[str, str], query: str) -> Column:
    """Cover-density rank of an OR query; 0 where nothing matches.

    ``texts`` maps text columns to their weight labels. Under OR each place of a
    word or phrase is a cover of its own without noise, so it adds its weight;
    all words of a phrase have the weight of their field.
    """
    terms = query_terms(query)
    return sum((F.lit(LABEL_WEIGHTS[label]) * occurrences(F.col(c), terms) for c, label in texts.items()), F.lit(0.0))
