"""Retrieval: search strategies, score fusion, gap fill, caps and rerank floor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import fulltext, vectors

# Strategies in order of tie-break, with their weights.
WEIGHTS = {
    "content_vector": 0.22,
    "hyde_vector": 0.18,
    "subquery_vector": 0.14,
    "keyword_vector": 0.10,
    "metric_vector": 0.12,
    "section_summary": 0.09,
    "bm25": 0.10,
    "keyword_array": 0.025,
    "metric_array": 0.025,
}
#: A scope table up to this many rows is broadcast; a larger one is joined by a shuffle.
SCOPE_ROWS = 100_000


def in_scope(rows: DataFrame, scope: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key columns stand in ``scope``; that is broadcast only if it is small."""
    keys = scope.select(*on).distinct()
    small = keys.limit(SCOPE_ROWS + 1).count() <= SCOPE_ROWS
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi")


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int = 20) -> DataFrame:
    """``key``, ``raw``: the ``k`` rows of least cosine distance; ties by key."""
    distance = vectors.cosine_distance(F.col(vector), vectors.literal(query))
    return rows.where(F.col(vector).isNotNull()).select(key, distance.alias("raw")).orderBy("raw", key).limit(k)


def containment(rows: DataFrame, key: str, text: str, terms: list[str], k: int = 50) -> DataFrame:
    """``key``, ``raw``: number of distinct terms that a text holds, most first; ties by key."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in dict.fromkeys(terms[:10])), F.lit(0))
    return rows.select(key, found.cast("double").alias("raw")).where("raw > 0").orderBy(F.desc("raw"), key).limit(k)


def fulltext_top(rows: DataFrame, key: str, text: str, terms: list[str], k: int = 20) -> DataFrame:
    return fulltext.bm25(rows, key, text, terms).select(key, F.col("score").alias("raw")).orderBy(F.desc("raw"), key).limit(k)


@dataclass(frozen=True)
class VectorSearch:
    """One search by distance: its strategy, the type of the vectors it looks at (None: all), its query, its batch and scale."""

    strategy: str
    kind: str | None
    query: list[float]
    batch: int = 0
    scale: float = 1.0


def vector_hits(vectors_long: DataFrame, searches: list[VectorSearch], k: int = 20) -> DataFrame:
    """Hits of several searches in one pass over ``key``, ``embedding_type``, ``embedding``: the nearest ``k`` rows of each, ties by key.

    Each task keeps its best ``k`` of a search before the shuffle (window group limit).
    """
    def hit(s: VectorSearch) -> Column:
        d = vectors.cosine_distance(F.col("embedding"), vectors.literal(s.query))
        looked_at = d if s.kind is None else F.when(F.col("embedding_type") == s.kind, d)
        return F.struct(F.lit(s.strategy).alias("strategy"), F.lit(s.batch).alias("batch"), F.lit(float(s.scale)).alias("scale"), looked_at.alias("raw"))

    rows = vectors_long.where("embedding is not null").select("key", F.explode(F.array(*map(hit, searches))).alias("h")).select("key", "h.*").where("raw is not null")
    rank = F.row_number().over(Window.partitionBy("strategy", "batch").orderBy("raw", "key"))
    return rows.withColumn("__n", rank).where(F.col("__n") <= k).select("strategy", "batch", "scale", F.lit(True).alias("invert"), "key", "raw")


# Weight labels of a chunk's fields in full-text search.
FIELDS = {"name": "A", "summary": "A", "keywords": "B", "metrics": "B", "chunk_content": "C"}


def held_terms(values: Column, terms: Sequence[str], most: int = 10) -> Column:
    """How many of the terms an array's text holds, without regard to case; repeated and blank terms count once and not at all."""
    wanted = list(dict.fromkeys(w for t in terms if (w := " ".join(t.split()).lower())))[:most]
    text = F.lower(F.coalesce(F.array_join(values, "\n"), F.lit("")))
    return sum((F.contains(text, F.lit(t)).cast("int") for t in wanted), F.lit(0))


def text_hits(data: DataFrame, query: str, keywords: Sequence[str], metrics: Sequence[str], k: int = 20, contained: int = 50) -> DataFrame:
    """Hits of full text and of containment in keywords and metrics, in one pass over ``key`` and the columns of ``FIELDS``."""
    as_text = {c: F.array_join(c, " ") if c in ("keywords", "metrics") else F.col(c) for c in FIELDS}
    words = data.select("key", "keywords", "metrics", *[t.alias(f"__{c}") for c, t in as_text.items()])
    hit = lambda name, raw: F.struct(F.lit(name).alias("strategy"), raw.cast("double").alias("raw"))
    found = F.array(
        hit("bm25", fulltext.cover_rank({f"__{c}": label for c, label in FIELDS.items()}, query)),
        hit("keyword_array", held_terms(F.col("keywords"), keywords)),
        hit("metric_array", held_terms(F.col("metrics"), metrics)),
    )
    rows = words.select("key", F.explode(found).alias("h")).select("key", "h.*").where("raw > 0")
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("raw"), "key"))
    most = F.when(F.col("strategy") == "bm25", k).otherwise(contained)
    kept = rows.withColumn("__n", rank).where((F.col("__n") <= max(k, contained)) & (F.col("__n") <= most))
    return kept.select("strategy", F.lit(0).alias("batch"), F.lit(1.0).alias("scale"), F.lit(False).alias("invert"), "key", "raw")


# Columns of a candidate.
CANDIDATE = ("source_type", "fiscal_year", "quarter", "bank", "filename", "file_id", "file_type", "file_path", "page_number", "name", "summary", "chunk_id", "chunk_content", "keywords", "metrics")


def candidates(fused: DataFrame, data: DataFrame) -> DataFrame:
    """Fused keys with the columns of ``CANDIDATE``: page 0, no content and empty lists where the store has null. ``fused`` is a few rows."""
    no_terms = F.array().cast("array<string>")
    defaults = {"page_number": F.lit(0), "chunk_content": F.lit(""), "keywords": no_terms, "metrics": no_terms}
    shown = [F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in CANDIDATE]
    small = F.broadcast(fused) if fused.limit(SCOPE_ROWS + 1).count() <= SCOPE_ROWS else fused
    return data.join(small, "key").select("key", *shown, "score", "sources")


def tagged(hits: DataFrame, key: str, strategy: str, batch: int = 0, scale: float = 1.0, invert: bool = False) -> DataFrame:
    """Hits of one search as rows of the fusion's input; ``invert`` where less is better."""
    return hits.select(
        F.lit(strategy).alias("strategy"), F.lit(batch).alias("batch"), F.lit(scale).alias("scale"), F.lit(invert).alias("invert"), F.col(key).alias("key"), F.col("raw").cast("double").alias("raw")
    )


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, dedupe_hits: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``key``, ``score``, ``n_strategies``, ``sources``: weighted sum of each batch's normalised best score.

    Of a batch, a key's best is its least distance or largest score; it is
    normalised by the batch's largest best to max(0, 1 - v / m) or v / m, or to
    1 if m is 0. A key hit several times in one batch counts so many times,
    unless ``dedupe_hits``. ``sources`` lists strategies in order of tie-break.
    With ``by`` columns each of their values is a search of its own.
    """
    weights = weights or WEIGHTS
    table = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*[F.lit(float(w)) for w in weights.values()]))
    order = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*[F.lit(i) for i in range(len(weights))]))
    best = hits.groupBy(*by, "strategy", "batch", "scale", "invert", "key").agg(F.min("raw").alias("least"), F.max("raw").alias("most"), F.count("*").alias("hits"))
    best = best.withColumn("v", F.when(F.col("invert"), F.col("least")).otherwise(F.col("most")))
    m = F.max("v").over(Window.partitionBy(*by, "strategy", "batch"))
    ratio = F.col("v") / F.col("m")
    normal = F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.when(F.col("invert"), 1 - ratio).otherwise(ratio)))
    times = F.lit(1) if dedupe_hits else F.col("hits")
    scored = best.withColumn("m", m).select(*by, "key", "strategy", (F.element_at(table, F.col("strategy")) * F.col("scale") * normal * times).alias("part"), F.element_at(order, F.col("strategy")).alias("ord"))
    return scored.groupBy(*by, "key").agg(
        F.sum("part").alias("score"),
        F.countDistinct("strategy").alias("n_strategies"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "strategy"))), lambda s: s["strategy"]), ",").alias("sources"),
    )


def top(fused: DataFrame, k: int) -> DataFrame:
    return fused.orderBy(F.desc(F.round("score", 9)), "key").limit(k)


def gap_fill(anchors: DataFrame, file_col: str, page_col: str, most: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``file_col``, ``page_col`` of pages that lie between neighbouring anchors of a file, where at most ``most`` are missing."""
    pages = anchors.select(*by, file_col, page_col).distinct()
    nxt = F.lead(page_col).over(Window.partitionBy(*by, file_col).orderBy(page_col))
    missing = F.col("__next") - F.col(page_col) - 1
    return (
        pages.withColumn("__next", nxt)
        .where((missing >= 1) & (missing <= most))
        .select(*by, file_col, F.explode(F.sequence(F.col(page_col) + 1, F.col("__next") - 1)).alias(page_col))
    )


def capped(rows: DataFrame, limit: int, anchor: str, *order: str) -> DataFrame:
    """At most ``limit`` rows, anchors before fillers, each in document order; ``slot`` tells the place."""
    ranked = rows.orderBy(F.desc(anchor), *order).limit(limit)
    return ranked.withColumn("slot", F.row_number().over(Window.orderBy(F.desc(anchor), *order)))


def rerank(candidates: DataFrame, removed: Column, score: str, key: str, pool: int = 30, keep: int = 20, floor: int = 10, gate: int | None = None) -> DataFrame:
    """What is left of the best ``pool`` after a reviewer's removals; with a ``gate``, so many candidates or fewer need no review and all stay.

    If fewer than ``floor`` were left, the best removed come back up to it.
    ``removed`` is a condition on a candidate. The pool is bounded, so its order is found in one task.
    """
    order = [F.desc(score), F.col(key)]
    few = F.count("*").over(Window.partitionBy()) <= (gate or 0)
    pooled = candidates.orderBy(*order).limit(pool).withColumn("removed", F.when(few, F.lit(False)).otherwise(F.coalesce(removed, F.lit(False))))
    rank = F.row_number().over(Window.orderBy("removed", *order))
    kept = F.count_if(~F.col("removed")).over(Window.partitionBy())
    return pooled.withColumn("__rank", rank).withColumn("__kept", kept).where((F.col("__rank") <= F.greatest("__kept", F.lit(floor))) & (F.col("__rank") <= keep)).drop("__rank", "__kept")


def follow_up(hits: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """New keys of follow-up searches: none seen before, the first search's hit of each, score max(0, 1 - distance)."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("batch", "raw"))
    fresh = hits.join(seen.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("__n", first).where("__n = 1").select(key, "batch", F.greatest(F.lit(0.0), 1 - F.col("raw")).alias("score"))
