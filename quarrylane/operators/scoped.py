"""Many questions over many scopes in one search.

A scope is a value of some columns of the chunks (bank and period, say) with
limits of its own. All questions meet the vectors in one pass, a batch of
vectors times all searches, with norms taken once for each vector and search;
and the texts in one pass. Limits, fusion, gap fill and caps hold for each
scope and question; every limit keeps its best rows in each task before
anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions import fulltext, text
from quarrylane.functions.providers import Provider
from quarrylane.operators import research
from quarrylane.operators.retrieval import FIELDS, SCOPE_ROWS, VectorSearch, fuse, gap_fill, held_terms


@dataclass(frozen=True)
class Question:
    """A named question: its searches by distance, its full-text query and the terms looked for in keywords and metrics."""

    name: str
    searches: Sequence[VectorSearch] = ()
    query: str = ""
    keywords: Sequence[str] = field(default=())
    metrics: Sequence[str] = field(default=())

    @classmethod
    def prepared(cls, name: str, p: research.Prepared, provider: Provider | None = None, typed: bool = True) -> Question:
        return cls(name, research.searches(p, provider, typed), text.fulltext_text([*p.metrics, *p.keywords], p.rewritten) or "", p.keywords, p.metrics)


def in_scopes(rows: DataFrame, scopes: DataFrame, on: Sequence[str], limit: str = "k") -> DataFrame:
    """Rows of the scopes, with each scope's ``limit``; scopes are broadcast only if they are few."""
    keys = scopes.select(*on, limit).dropDuplicates(list(on))
    return rows.join(F.broadcast(keys) if keys.limit(SCOPE_ROWS + 1).count() <= SCOPE_ROWS else keys, list(on))


def _best(hits: DataFrame, on: Sequence[str], most: int, limit: Column, *order: Column) -> DataFrame:
    """Hits of rank ``limit`` or better for each scope, question, strategy and batch; ``most`` is the largest limit of all."""
    rank = F.row_number().over(Window.partitionBy(*on, "question", "strategy", "batch").orderBy(*order))
    return hits.withColumn("__n", rank).where((F.col("__n") <= most) & (F.col("__n") <= limit)).drop("__n")


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dim`` components as rows in double precision, and the places they come from."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim), at


def vector_hits(vectors: DataFrame, questions: Sequence[Question], on: Sequence[str], most: int) -> DataFrame:
    """Nearest vectors of each scope, question, strategy and batch, as many as the row's ``k``; ties by key.

    ``vectors``: ``on``, ``k``, ``key``, ``embedding_type``, ``embedding``. Null and
    zero vectors and those of another size than the search's are no hits.
    """
    searches = [(q.name, s) for q in questions for s in q.searches]
    names = [*on, "k", "key"]
    if not searches:
        return _empty(vectors, names)
    dim = len(searches[0][1].query)
    asked = np.array([s.query for _, s in searches], dtype=np.float64)
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    kinds = [s.kind for _, s in searches]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = _matrix(b.column("embedding"), dim)
            norm = np.linalg.norm(rows, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.maximum(0, 1 - rows @ asked.T / norm[:, None])
            kind = np.array(b.column("embedding_type").to_pylist(), dtype=object)[at]
            looked_at = np.array([[True] * len(at) if k is None else kind == k for k in kinds], dtype=bool).reshape(len(kinds), len(at)).T
            i, j = np.nonzero(looked_at & np.isfinite(distance))
            taken = b.select(names).take(pa.array(at[i]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(j.astype(np.int32)), pa.array(distance[i, j])], names=[*names, "search", "raw"])

    shown = vectors.where("embedding is not null").select(*names, "embedding_type", "embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.select(*names).schema)
    hits = shown.mapInArrow(run, f"{schema}, search int, raw double")
    what = [F.struct(F.lit(q).alias("question"), F.lit(s.strategy).alias("strategy"), F.lit(s.batch).alias("batch"), F.lit(float(s.scale)).alias("scale")) for q, s in searches]
    hits = hits.withColumn("s", F.get(F.array(*what), F.col("search"))).select(*names, "s.*", F.lit(True).alias("invert"), "raw")
    return _best(hits, on, most, F.col("k"), F.col("raw"), F.col("key")).drop("k")


def _empty(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    made = {"question": F.lit(""), "strategy": F.lit(""), "batch": F.lit(0), "scale": F.lit(1.0), "invert": F.lit(True), "raw": F.lit(0.0)}
    return rows.where("false").select(*names, *[c.alias(n) for n, c in made.items()]).drop("k")


def text_hits(chunks: DataFrame, questions: Sequence[Question], on: Sequence[str], most: int, contained: int = 50) -> DataFrame:
    """Hits of full text and of containment in keywords and metrics for each scope and question, in one pass over ``on``, ``k``, ``key`` and ``FIELDS``."""
    as_text = {c: F.array_join(c, " ") if c in ("keywords", "metrics") else F.col(c) for c in FIELDS}
    words = chunks.select(*on, "k", "key", "keywords", "metrics", *[t.alias(f"__{c}") for c, t in as_text.items()])
    labels = {f"__{c}": label for c, label in FIELDS.items()}
    hit = lambda q, name, raw: F.struct(F.lit(q.name).alias("question"), F.lit(name).alias("strategy"), raw.cast("double").alias("raw"))
    found = []
    for q in questions:
        found += [hit(q, "bm25", fulltext.cover_rank(labels, q.query))] if q.query else []
        found += [hit(q, f"{c.removesuffix('s')}_array", held_terms(F.col(c), terms)) for c, terms in (("keywords", q.keywords), ("metrics", q.metrics)) if terms]
    if not found:
        return _empty(chunks, [*on, "k", "key"])
    rows = words.select(*on, "k", "key", F.explode(F.array(*found)).alias("h")).where("h.raw > 0")
    hits = rows.select(*on, "k", "key", "h.question", "h.strategy", F.lit(0).alias("batch"), F.lit(1.0).alias("scale"), F.lit(False).alias("invert"), "h.raw")
    limit = F.when(F.col("strategy") == "bm25", F.col("k")).otherwise(contained)
    return _best(hits, on, max(most, contained), limit, F.desc("raw"), F.col("key")).drop("k")


def search(chunks: DataFrame, vectors: DataFrame, questions: Sequence[Question], scopes: DataFrame, on: Sequence[str] = ("bank", "fiscal_year", "quarter"), weights: dict[str, float] | None = None) -> DataFrame:
    """``on``, ``question``, ``key``, ``score``, ``sources``, ``rank``: the fused best of each scope and question.

    ``scopes``: ``on`` and ``k``, how many hits of a strategy and how many fused
    rows a scope gets. ``chunks``: ``key``, ``on`` and ``FIELDS``; ``vectors``:
    ``key``, ``embedding_type``, ``embedding``. A scope without a hit has no row.
    """
    mine = in_scopes(chunks, scopes, on)
    most = scopes.agg(F.max("k")).first()[0] or 0
    placed = vectors.join(mine.select("key", *on, "k"), "key")
    hits = vector_hits(placed, questions, on, most).unionByName(text_hits(mine, questions, on, most))
    by = [*on, "question"]
    fused = in_scopes(fuse(hits, weights, by=by), scopes, on)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "key"))
    return fused.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") <= F.col("k"))).select(*by, "key", "score", "sources", "rank")


def expanded(found: DataFrame, pages: DataFrame, on: Sequence[str], extra: int = 5, most: int = 2) -> DataFrame:
    """What ``search`` found in document order, with the pages between neighbouring hits of a file, at most ``extra`` of these for each scope and question.

    ``pages``: ``key``, ``on``, ``file_id``, ``page``; a filler is a page of the scope.
    ``slot`` counts hits first, then fillers.
    """
    by = [*on, "question"]
    anchors = found.join(pages, [*on, "key"]).select(*by, "key", "file_id", "page", F.round("score", 9).alias("score"))
    fill = gap_fill(anchors, "file_id", "page", most, by).join(pages, [*on, "file_id", "page"])
    order = Window.partitionBy(*by).orderBy("file_id", "page", "key")
    fill = fill.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= extra)
    n = anchors.groupBy(*by).agg(F.count("*").alias("n"))
    hits = anchors.withColumn("slot", F.row_number().over(order))
    fill = fill.join(n, by).select(*by, "key", "file_id", "page", F.lit(None).cast("double").alias("score"), (F.col("slot") + F.col("n")).cast("int").alias("slot"))
    return hits.withColumn("anchor", F.lit(True)).unionByName(fill.withColumn("anchor", F.lit(False)))
