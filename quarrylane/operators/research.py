"""Query preparation and the bounded research loop over retrieval results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.functions.providers import Provider, call, hashing_embedder
from quarrylane.operators import retrieval
from quarrylane.session import scratch


@dataclass(frozen=True)
class Prepared:
    """What a question searches with."""

    rewritten: str
    sub_queries: tuple[str, ...]
    keywords: tuple[str, ...]
    metrics: tuple[str, ...]
    hyde: str


def prepare(spark, question: str) -> Prepared:
    """Deterministic preparation: terms of the question itself, its numbers softened, no sub-queries."""
    q = F.lit(question)
    metrics = text.metric_terms(q)
    row = spark.range(1).select(text.collapsed(q).alias("q"), metrics.alias("m"), text.key_terms(q, metrics, 8).alias("k"), text.softened(q).alias("h")).first()
    return Prepared(row.q, (), tuple(row.k), tuple(row.m), row.h)


def facets(p: Prepared, provider: Provider | None = None) -> dict[str, list[float]]:
    """Vectors by facet, blank facets left out."""
    named = {"rewritten": p.rewritten, "hyde": p.hyde, "keywords": " ".join(p.keywords), "metrics": " ".join(p.metrics)}
    named |= {f"sub_query_{i}": q for i, q in enumerate(p.sub_queries[:3])}
    real = {k: v for k, v in named.items() if v.strip()}
    return dict(zip(real, call(provider or hashing_embedder(), list(real.values())), strict=True))


def searches(prepared: Prepared, provider: Provider | None = None, typed: bool = True) -> list[retrieval.VectorSearch]:
    """The searches by distance that a question asks for; without ``typed`` vectors they look at all, and not at sections."""
    found = facets(prepared, provider)
    subs = [f for f in found if f.startswith("sub_query")]
    asked = [("content_vector", "content", "rewritten"), ("section_summary", "section_summary", "rewritten"), ("hyde_vector", "content", "hyde")]
    asked += [("subquery_vector", "content", s) for s in subs] + [("keyword_vector", "keyword", "keywords"), ("metric_vector", "metric", "metrics")]
    out = []
    for strategy, kind, facet in asked:
        if facet in found and (typed or kind != "section_summary"):
            batch, scale = (subs.index(facet), 1 / len(subs)) if facet in subs else (0, 1.0)
            out.append(retrieval.VectorSearch(strategy, kind if typed else None, found[facet], batch, scale))
    return out


def hybrid_search(
    chunks: DataFrame, vectors: DataFrame, prepared: Prepared, provider: Provider | None = None, scope: DataFrame | None = None, on: Sequence[str] = ("bank", "fiscal_year", "quarter"), k: int = 20
) -> DataFrame:
    """Fused top ``k`` of nine strategies: ``key``, ``score``, ``sources``.

    ``chunks``: ``key``, scope columns, and name, summary, keywords, metrics and
    chunk_content, or ``text`` in their place. ``vectors``: ``key``,
    ``embedding``, and, where they are of several kinds, ``embedding_type``; a
    section's vector has ``content_unit_ids``, the keys it stands for, and each
    of these is a hit of its own before hits are limited.
    """
    if scope is not None:
        chunks = retrieval.in_scope(chunks, scope, list(on))
    if "content_unit_ids" in vectors.columns:
        vectors = vectors.withColumn("key", F.explode(F.coalesce("content_unit_ids", F.array("key"))))
    vectors = vectors.join(chunks.select("key"), "key", "left_semi")
    typed = "embedding_type" in vectors.columns
    hits = retrieval.vector_hits(vectors, searches(prepared, provider, typed), k)
    empty = {"name": F.lit(""), "summary": F.lit(""), "keywords": F.array().cast("array<string>"), "metrics": F.array().cast("array<string>"), "chunk_content": F.col("text") if "text" in chunks.columns else F.lit("")}
    data = chunks.select("key", *[F.col(c) if c in chunks.columns else empty[c].alias(c) for c in retrieval.FIELDS])
    if query := text.fulltext_text([*prepared.metrics, *prepared.keywords], prepared.rewritten):
        hits = hits.unionByName(retrieval.text_hits(data, query, prepared.keywords, prepared.metrics, k))
    return retrieval.top(retrieval.fuse(hits), k)


def dispatch(sources: dict[str, Callable[[], DataFrame]], parallel: int = 4) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """(rows of all sources that worked, with their ``source``; (source, status, reason) of each).

    Each source is run and written by itself, a few at a time, so that one that
    fails, even while it runs, takes none of the others with it. Status is
    success, no_available_data or error; a reason is one line.
    """

    def one(name: str) -> tuple[str, DataFrame | None, str, str]:
        try:
            rows = sources[name]()
            path = f"{scratch(rows.sparkSession)}/{uuid.uuid4().hex}"
            rows.write.parquet(path)
            out = rows.sparkSession.read.schema(rows.schema).parquet(path)
            return name, out, "success" if out.limit(1).count() else "no_available_data", ""
        except Exception as e:  # whatever a source raises is its own
            return name, None, "error", " ".join(str(e).split())[:220]

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, sources))
    found = [rows.withColumn("source", F.lit(name)) for name, rows, *_ in done if rows is not None]
    return reduce(DataFrame.unionByName, found) if found else None, [(name, status, reason) for name, _, status, reason in done]


def research(first: DataFrame, judge: Callable[[list], tuple[float, list[str]]], search: Callable[[str], DataFrame], rounds: int = 2, confident: float = 0.8) -> list:
    """Rows gathered by at most ``rounds`` follow-ups. ``first`` holds at most the retrieval's top k.

    ``judge`` gives a confidence and further queries; the loop stops when it is
    confident, asks nothing new, or a search finds nothing new.
    """
    rows, asked = first.collect(), set()
    for _ in range(rounds):
        confidence, queries = judge(rows)
        fresh = [q for q in queries[:3] if q not in asked]
        if confidence >= confident or not fresh:
            break
        asked.update(fresh)
        seen = {r.key for r in rows}
        more = [r for q in fresh for r in search(q).collect() if r.key not in seen]
        if not more:
            break
        rows += list({r.key: r for r in reversed(more)}.values())[::-1]
    return rows
