"""Queries of many questions over many scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.functions import fulltext
from quarrylane.operators import retrieval, scoped
from quarrylane.plans.search import DATA_SQL, VECTORS_SQL, data, vectors_long
from quarrylane.session import table

CATALOG = Catalog()
ON = ["bank", "quarter"]
#: Each question: (strategy, batch, scale, kind, id of the query's vector), full-text terms, keywords, metrics.
QUESTIONS = {
    "growth": ((("content_vector", 0, 1.0, "content", 0), ("hyde_vector", 0, 1.0, "content", 1), ("keyword_vector", 0, 1.0, "keyword", 2)), ("with", "thing"), ("ontionthe", "thing"), ()),
    "risk": ((("content_vector", 0, 1.0, "content", 3), ("subquery_vector", 0, 0.5, "content", 4), ("subquery_vector", 1, 0.5, "content", 5), ("section_summary", 0, 1.0, "section_summary", 3)), ("haing", "and"), (), ("tionandthe", "ingthe")),
}


def _questions(spark: SparkSession, sf_dir: str) -> list[scoped.Question]:
    wanted = sorted({s[4] for searches, *_ in QUESTIONS.values() for s in searches})
    found = {r.vec_id: list(r.embedding) for r in table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(wanted)).collect()}
    made = lambda searches: [retrieval.VectorSearch(name, kind, found[q], batch, scale) for name, batch, scale, kind, q in searches]
    return [scoped.Question(name, made(searches), " OR ".join(words), keywords, metrics) for name, (searches, words, keywords, metrics) in QUESTIONS.items()]


_ORD = {s: i for i, s in enumerate(retrieval.WEIGHTS)}
_SEARCHES = ", ".join(f"('{q}', '{s}', {_ORD[s]}, {b}, {retrieval.WEIGHTS[s] * scale}::DOUBLE, '{kind}', {v})" for q, (searches, *_) in QUESTIONS.items() for s, b, scale, kind, v in searches)
_WORDS = {"name": "name", "summary": "coalesce(summary, '')", "keywords": "array_to_string(keywords, ' ')", "metrics": "array_to_string(metrics, ' ')", "chunk_content": "chunk_content"}


def _rank(words) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return " + ".join(f"{fulltext.LABEL_WEIGHTS[retrieval.FIELDS[f]]}::DOUBLE * len([x FOR x IN regexp_extract_all(lower({c}), '[a-z0-9]+') IF x IN ({listed})])" for f, c in _WORDS.items())


def _held(column: str, terms) -> str:
    return " + ".join(f"CAST(contains(lower(array_to_string({column}, chr(10))), '{t}') AS INTEGER)" for t in terms)


def _of_text(q: str, strategy: str, raw: str, limit: str) -> str:
    return f"""SELECT bank, quarter, '{q}' AS question, '{strategy}' AS s, {_ORD[strategy]} AS ord, 0 AS b, {retrieval.WEIGHTS[strategy]}::DOUBLE AS w, false AS inv, key, raw FROM (
      SELECT bank, quarter, k, key, CAST({raw} AS DOUBLE) AS raw FROM data JOIN sc USING (bank, quarter)) WHERE raw > 0
      QUALIFY row_number() OVER (PARTITION BY bank, quarter ORDER BY raw DESC, key) <= {limit}"""


_TEXTS = [_of_text(q, "bm25", _rank(words), "k") for q, (_, words, _, _) in QUESTIONS.items()]
_TEXTS += [_of_text(q, f"{c}_array", _held(f"{c}s", terms), "50") for q, (_, _, *both) in QUESTIONS.items() for c, terms in zip(("keyword", "metric"), both, strict=True) if terms]

SQL = f"""WITH {DATA_SQL}, {VECTORS_SQL},
sc AS (SELECT bank, quarter, CASE WHEN quarter = 'Q1' THEN 8 ELSE 5 END AS k FROM data GROUP BY bank, quarter),
q(question, s, ord, b, w, kind, qid) AS (VALUES {_SEARCHES}),
hits AS (
  SELECT bank, quarter, question, s, ord, b, w, true AS inv, key, raw FROM (
    SELECT d.bank, d.quarter, sc.k, q.question, q.s, q.ord, q.b, q.w, vs.key, greatest(0, 1 - list_cosine_similarity(CAST(vs.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS raw
    FROM q JOIN embeddings e ON e.vec_id = q.qid JOIN vs ON vs.kind = q.kind JOIN data d ON d.key = vs.key JOIN sc ON sc.bank = d.bank AND sc.quarter = d.quarter)
  QUALIFY row_number() OVER (PARTITION BY bank, quarter, question, s, b ORDER BY raw, key) <= k
  UNION ALL {" UNION ALL ".join(_TEXTS)}),
best AS (SELECT bank, quarter, question, s, ord, b, w, inv, key, CASE WHEN inv THEN min(raw) ELSE max(raw) END AS v, count(*) AS n FROM hits GROUP BY bank, quarter, question, s, ord, b, w, inv, key),
normed AS (
  SELECT bank, quarter, question, key, s, ord, w * n * CASE WHEN m = 0 THEN 1 WHEN inv THEN greatest(0, 1 - v / m) ELSE v / m END AS part
  FROM (SELECT *, max(v) OVER (PARTITION BY bank, quarter, question, s, b) AS m FROM best)),
fused AS (
  SELECT bank, quarter, question, key, sum(part) AS score, array_to_string(list_transform(list_sort(list_distinct(list(CAST(ord AS VARCHAR) || s))), lambda x: x[2:]), ',') AS sources
  FROM normed GROUP BY bank, quarter, question, key),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY bank, quarter, question ORDER BY round(score, 9) DESC, key) AS rank, k FROM fused f JOIN sc USING (bank, quarter) QUALIFY rank <= k)"""


def _scopes(rows: DataFrame) -> DataFrame:
    return rows.select(*ON).distinct().withColumn("k", F.when(F.col("quarter") == "Q1", 8).otherwise(5))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = data(spark, sf_dir)
    return scoped.search(chunks, vectors_long(spark, sf_dir), _questions(spark, sf_dir), _scopes(chunks), ON)


@CATALOG.query("scoped_hybrid_search", f"{SQL} SELECT bank, quarter, question, key, round(score, 6) AS score, sources, CAST(rank AS INTEGER) AS rank FROM ranked")
def scoped_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions over every bank and quarter, each with its own limit."""
    return _found(spark, sf_dir).withColumn("score", F.round("score", 6))


@CATALOG.query(
    "scoped_gap_fill",
    f"""{SQL},
    pages AS (SELECT doc_id AS key, source AS bank, 'Q' || (doc_id % 4 + 1) AS quarter, source || '_' || lang AS file_id, row_number() OVER (PARTITION BY source, lang, doc_id % 4 ORDER BY doc_id) AS page FROM documents),
    anchors AS (SELECT r.bank, r.quarter, r.question, r.key, p.file_id, p.page, round(r.score, 6) AS score FROM ranked r JOIN pages p ON r.key = p.key),
    gaps AS (SELECT *, lead(page) OVER (PARTITION BY bank, quarter, question, file_id ORDER BY page) AS nx FROM anchors),
    fill AS (SELECT g.bank, g.quarter, g.question, p.key, p.file_id, p.page, NULL::DOUBLE AS score FROM (SELECT bank, quarter, question, file_id, u.p AS page FROM gaps, unnest(range(page + 1, nx)) AS u(p) WHERE nx - page - 1 BETWEEN 1 AND 2) g
      JOIN pages p ON p.bank = g.bank AND p.quarter = g.quarter AND p.file_id = g.file_id AND p.page = g.page
      QUALIFY row_number() OVER (PARTITION BY g.bank, g.quarter, g.question ORDER BY p.file_id, p.page, p.key) <= 5)
    SELECT bank, quarter, question, key, file_id, page, score, anchor, CAST(row_number() OVER (PARTITION BY bank, quarter, question ORDER BY anchor DESC, file_id, page, key) AS INTEGER) AS slot
    FROM (SELECT *, true AS anchor FROM anchors UNION ALL SELECT *, false FROM fill)""",
)
def scoped_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with the pages between hits of a file, hits and fillers in document order."""
    page = F.row_number().over(Window.partitionBy("source", "lang", F.col("doc_id") % 4).orderBy("doc_id")).cast("long")
    quarter = F.concat(F.lit("Q"), (F.col("doc_id") % 4 + 1).cast("string"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("bank"), quarter.alias("quarter"), F.concat_ws("_", "source", "lang").alias("file_id"), page.alias("page"))
    return scoped.expanded(_found(spark, sf_dir), pages, ON).withColumn("score", F.round("score", 6))
