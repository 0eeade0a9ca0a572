"""Search queries: vectors, containment, full text, fusion, gap fill, rerank, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.functions import fulltext, text, vectors
from quarrylane.operators import ordering, retrieval
from quarrylane.plans.views import CHUNKS_SQL, chunks
from quarrylane.session import table

CATALOG = Catalog()
TERMS = ["with", "tion", "the thing", "und"]
WORDS = ["the", "and", "with"]

_DIST = "greatest(0, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)))"


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


@CATALOG.query("knn_topk", f"SELECT vec_id, label, round({_DIST}, 6) AS distance FROM embeddings WHERE embedding IS NOT NULL ORDER BY {_DIST}, vec_id LIMIT 20")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vectors.cosine_distance(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir)))
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", d.alias("d"))
    return rows.orderBy("d", "vec_id").limit(20).select("vec_id", "label", F.round("d", 6).alias("distance"))


@CATALOG.query(
    "knn_per_label",
    f"""SELECT vec_id, label, round(d, 6) AS distance, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, label, {_DIST} AS d FROM embeddings)) WHERE rank <= 3""",
)
def knn_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vectors.cosine_distance(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", d.alias("d"))
    # Spark keeps each task's best three per label before the shuffle (window group limit).
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("d", "vec_id")).cast("long"))
    return ranked.where("rank <= 3").select("vec_id", "label", F.round("d", 6).alias("distance"), "rank")


@CATALOG.query(
    "knn_scoped_join",
    f"""WITH {CHUNKS_SQL} SELECT c.doc_id, c.file_id, c.page, round({_DIST}, 6) AS distance
      FROM embeddings e JOIN chunks c ON e.vec_id = c.doc_id WHERE c.bank IN ('src0', 'src1') AND c.source_type = 'en' ORDER BY {_DIST}, c.doc_id LIMIT 20""",
)
def knn_scoped_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spark.createDataFrame([("src0", "en"), ("src1", "en")], "bank string, source_type string")
    scoped = retrieval.in_scope(chunks(spark, sf_dir, n=F.lit(0)), scope, ["bank", "source_type"]).select("doc_id", "file_id", "page")
    d = vectors.cosine_distance(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir)))
    rows = table(spark, sf_dir, "embeddings").join(scoped, F.col("vec_id") == F.col("doc_id")).select("doc_id", "file_id", "page", d.alias("d"))
    return rows.orderBy("d", "doc_id").limit(20).select("doc_id", "file_id", "page", F.round("d", 6).alias("distance"))


_FOUND = " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in TERMS)


@CATALOG.query("keyword_containment", f"SELECT doc_id, CAST({_FOUND} AS DOUBLE) AS raw FROM documents WHERE {_FOUND} > 0 ORDER BY raw DESC, doc_id LIMIT 50")
def keyword_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.containment(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


_BM25_SQL = f"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
stat AS (SELECT count(*)::DOUBLE AS docs, avg(len(w)) AS mean, {", ".join(f"count(*) FILTER (list_contains(w, '{t}')) AS df{i}" for i, t in enumerate(WORDS))} FROM tok),
tf AS (SELECT doc_id, len(w) AS n, {", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(WORDS))} FROM tok),
bm AS (SELECT doc_id, {" + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (docs - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) ELSE 0 END" for i in range(len(WORDS)))} AS raw
  FROM tf, stat WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(WORDS)))})"""


@CATALOG.query("bm25_topk", f"WITH {_BM25_SQL} SELECT doc_id, round(raw, 6) AS score FROM bm ORDER BY raw DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fulltext_top(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS).select("doc_id", F.round("raw", 6).alias("score"))


#: The chunk store on the test tables: one chunk per document; keywords and metrics are its long words.
DATA_SQL = """data AS (
  SELECT doc_id AS key, lang AS source_type, 2020 + doc_id % 4 AS fiscal_year, 'Q' || (doc_id % 4 + 1) AS quarter, source AS bank, source || '.pdf' AS filename, source || '_' || lang AS file_id,
         'pdf' AS file_type, '/in/' || source || '.pdf' AS file_path, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END AS page_number, source || ' ' || lang AS name, split_part(text, '.', 1) AS summary,
         'page_' || doc_id || '.1' AS chunk_id, text AS chunk_content, regexp_extract_all(lower(text), '[a-z]{9,}') AS keywords, regexp_extract_all(lower(text), '[a-z]{12,}') AS metrics
  FROM documents)"""


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, source, text_ = F.col("doc_id"), F.col("source"), F.col("text")
    words = F.regexp_extract_all(F.lower(text_), F.lit("[a-z]{9,}"), F.lit(0))
    columns = {
        "key": k, "source_type": F.col("lang"), "fiscal_year": 2020 + k % 4, "quarter": F.concat(F.lit("Q"), (k % 4 + 1).cast("string")), "bank": source,
        "filename": F.concat(source, F.lit(".pdf")), "file_id": F.concat_ws("_", "source", "lang"), "file_type": F.lit("pdf"), "file_path": F.concat(F.lit("/in/"), source, F.lit(".pdf")),
        "page_number": F.when(k % 5 > 0, k % 5), "name": F.concat_ws(" ", "source", "lang"), "summary": F.split_part(text_, F.lit("."), F.lit(1)),
        "chunk_id": F.concat(F.lit("page_"), k.cast("string"), F.lit(".1")), "chunk_content": text_, "keywords": words,
    }
    rows = table(spark, sf_dir, "documents").select(*[c.alias(n) for n, c in columns.items()])
    return rows.withColumn("metrics", F.filter("keywords", lambda w: F.length(w) >= 12))


#: Vectors by kind: four to a unit, the last of them its section's, which stands for three units.
VECTORS_SQL = """vl AS (SELECT embedding, CASE vec_id % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'keyword' WHEN 2 THEN 'metric' ELSE 'section_summary' END AS kind,
  unnest(CASE WHEN vec_id % 4 = 3 THEN [vec_id // 4, vec_id // 4 + 1, vec_id // 4 + 2] ELSE [vec_id // 4] END) AS key FROM embeddings),
vs AS (SELECT * FROM vl WHERE key IN (SELECT doc_id FROM documents))"""


def vectors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, unit = F.col("vec_id") % 4, F.floor(F.col("vec_id") / 4)
    named = F.when(kind == 0, "content").when(kind == 1, "keyword").when(kind == 2, "metric").otherwise("section_summary")
    units = F.when(kind == 3, F.array(unit, unit + 1, unit + 2)).otherwise(F.array(unit))
    rows = table(spark, sf_dir, "embeddings").select("embedding", named.alias("embedding_type"), F.explode(units).alias("key"))
    return rows.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), "key", "left_semi")


QUERY = '"of the" OR with OR haing OR thing'
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_FIELD_WORDS = {"name": "name", "summary": "coalesce(summary, '')", "keywords": "array_to_string(keywords, ' ')", "metrics": "array_to_string(metrics, ' ')", "chunk_content": "chunk_content"}
_COUNTS = " + ".join(
    f"{fulltext.LABEL_WEIGHTS[retrieval.FIELDS[f]]}::DOUBLE * (len([i FOR i IN range(1, len({f}_w)) IF {f}_w[i] = 'of' AND {f}_w[i + 1] = 'the']) + len([x FOR x IN {f}_w IF x IN ('with', 'haing', 'thing')]))" for f in _FIELD_WORDS
)
RANK_SQL = f"""{DATA_SQL}, fw AS (SELECT key, {", ".join(f"{_WORDS.format(c)} AS {f}_w" for f, c in _FIELD_WORDS.items())} FROM data),
ft AS (SELECT key, {_COUNTS} AS raw FROM fw)"""


@CATALOG.query("fts_cover_topk", f"WITH {RANK_SQL} SELECT key, round(raw, 6) AS score FROM ft WHERE raw > 0 ORDER BY raw DESC, key LIMIT 20")
def fts_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best chunks of an OR query with a phrase, over name, summary, keywords, metrics and content by their weights."""
    hits = retrieval.text_hits(data(spark, sf_dir), QUERY, [], [])
    return hits.where("strategy = 'bm25'").select("key", F.round("raw", 6).alias("score"))


@CATALOG.query(
    "phrase_search",
    r"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
    SELECT doc_id, count(*) AS places, min(u.i) - 1 AS first_pos FROM tok, unnest(range(1, len(w))) AS u(i) WHERE w[u.i] = 'of' AND w[u.i + 1] = 'the' GROUP BY doc_id""",
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = fulltext.weighted_postings(table(spark, sf_dir, "documents"), "doc_id", {"text": "C"}, ["of", "the"])
    found = fulltext.phrase_matches(postings, "doc_id", "of the")
    return found.groupBy("doc_id").agg(F.count("*").alias("places"), F.min("pos").cast("long").alias("first_pos"))


KEYWORDS, METRICS = ["ontionthe", "Thing ", "andand"], ["tionandthe", "ingthe"]
_SEARCHES = (("content_vector", 0, 1.0, "content", 0), ("section_summary", 0, 1.0, "section_summary", 0), ("hyde_vector", 0, 1.0, "content", 1), ("subquery_vector", 0, 0.5, "content", 2), ("subquery_vector", 1, 0.5, "content", 3), ("keyword_vector", 0, 1.0, "keyword", 4), ("metric_vector", 0, 1.0, "metric", 5))


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all nine strategies: one pass over the vectors, one over the chunks."""
    wanted = sorted({q for *_, q in _SEARCHES})
    found = {r.vec_id: list(r.embedding) for r in table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(wanted)).collect()}
    searches = [retrieval.VectorSearch(name, kind, found[q], batch, scale) for name, batch, scale, kind, q in _SEARCHES]
    return retrieval.vector_hits(vectors_long(spark, sf_dir), searches).unionByName(retrieval.text_hits(data(spark, sf_dir), QUERY, KEYWORDS, METRICS))


def _dist(n: int) -> str:
    return f"greatest(0, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {n})))"


_ORD = {s: i for i, s in enumerate(retrieval.WEIGHTS)}
_VALUES = ", ".join(f"('{s}', {_ORD[s]}, {b}, {retrieval.WEIGHTS[s] * scale}::DOUBLE, '{kind}', {q})" for s, b, scale, kind, q in _SEARCHES)


def _held(column: str, terms: list[str]) -> str:
    text_ = f"lower(array_to_string({column}, chr(10)))"
    return " + ".join(f"CAST(contains({text_}, '{t.strip().lower()}') AS INTEGER)" for t in terms)


def _text_hits(name: str, raw: str, source: str, limit: int) -> str:
    return f"SELECT '{name}', {_ORD[name]}, 0, {retrieval.WEIGHTS[name]}::DOUBLE, false, key, raw FROM (SELECT key, CAST({raw} AS DOUBLE) AS raw FROM {source} WHERE {raw} > 0 ORDER BY raw DESC, key LIMIT {limit})"


FUSED_SQL = f"""{RANK_SQL}, {VECTORS_SQL},
q(s, ord, b, w, kind, qid) AS (VALUES {_VALUES}),
hits AS (
  SELECT s, ord, b, w, true AS inv, key, raw FROM (
    SELECT q.s, q.ord, q.b, q.w, vs.key, greatest(0, 1 - list_cosine_similarity(CAST(vs.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS raw
    FROM q JOIN embeddings e ON e.vec_id = q.qid JOIN vs ON vs.kind = q.kind) QUALIFY row_number() OVER (PARTITION BY s, b ORDER BY raw, key) <= 20
  UNION ALL {_text_hits("bm25", "raw", "ft", 20)}
  UNION ALL {_text_hits("keyword_array", _held("keywords", KEYWORDS), "data", 50)}
  UNION ALL {_text_hits("metric_array", _held("metrics", METRICS), "data", 50)}),
best AS (SELECT s, ord, b, w, inv, key, CASE WHEN inv THEN min(raw) ELSE max(raw) END AS v, count(*) AS n FROM hits GROUP BY s, ord, b, w, inv, key),
normed AS (
  SELECT key, s, ord, w * n * CASE WHEN m = 0 THEN 1 WHEN inv THEN greatest(0, 1 - v / m) ELSE v / m END AS part
  FROM (SELECT *, max(v) OVER (PARTITION BY s, b) AS m FROM best)),
fused AS (
  SELECT key, sum(part) AS score, count(DISTINCT s) AS n_strategies,
         array_to_string(list_transform(list_sort(list_distinct(list(CAST(ord AS VARCHAR) || s))), lambda x: x[2:]), ',') AS sources
  FROM normed GROUP BY key)"""


@CATALOG.query(
    "candidate_projection",
    f"""WITH {FUSED_SQL}, best20 AS (SELECT key, score, sources FROM fused ORDER BY round(score, 9) DESC, key LIMIT 20)
    SELECT key, source_type, fiscal_year, quarter, bank, filename, file_id, file_type, file_path, coalesce(page_number, 0) AS page_number, name, summary, chunk_id, coalesce(chunk_content, '') AS chunk_content,
      array_to_string(keywords, ',') AS keywords, array_to_string(metrics, ',') AS metrics, round(score, 6) AS score, sources FROM best20 JOIN data USING (key)""",
)
def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.top(retrieval.fuse(_strategies(spark, sf_dir)), 20)
    rows = retrieval.candidates(best, data(spark, sf_dir))
    return rows.withColumns({"keywords": F.array_join("keywords", ","), "metrics": F.array_join("metrics", ","), "score": F.round("score", 6)})


@CATALOG.query("hybrid_fusion", f"WITH {FUSED_SQL} SELECT key, round(score, 6) AS score, n_strategies, sources FROM fused")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_strategies(spark, sf_dir)).select("key", F.round("score", 6).alias("score"), "n_strategies", "sources")


@CATALOG.query(
    "hybrid_topk_gap_fill",
    f"""WITH {CHUNKS_SQL}, {FUSED_SQL},
    a AS (SELECT key, score FROM fused ORDER BY round(score, 9) DESC, key LIMIT 20),
    anchors AS (SELECT c.file_id, c.page, a.score FROM a JOIN chunks c ON a.key = c.doc_id),
    gaps AS (SELECT file_id, page, lead(page) OVER (PARTITION BY file_id ORDER BY page) AS nx FROM anchors),
    fill AS (SELECT file_id, u.p AS page FROM gaps, unnest(range(page + 1, nx)) AS u(p) WHERE nx - page - 1 BETWEEN 1 AND 2),
    allrows AS (SELECT file_id, page, true AS anchor, round(score, 6) AS score FROM anchors UNION ALL SELECT file_id, page, false, NULL FROM fill)
    SELECT c.doc_id, r.file_id, r.page, r.anchor, r.score, CAST(row_number() OVER (ORDER BY r.anchor DESC, r.file_id, r.page) AS INTEGER) AS slot
    FROM allrows r JOIN chunks c USING (file_id, page) QUALIFY slot <= 25""",
)
def hybrid_topk_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: fused top-20, neighbours of a file filled in where one or two pages are missing, anchors first."""
    pages = chunks(spark, sf_dir, n=F.lit(0)).select("doc_id", "file_id", "page")
    best = retrieval.top(retrieval.fuse(_strategies(spark, sf_dir)), 20)
    anchors = best.join(pages, F.col("key") == F.col("doc_id")).select("file_id", "page", F.round("score", 6).alias("score"))
    fill = retrieval.gap_fill(anchors, "file_id", "page")
    rows = anchors.withColumn("anchor", F.lit(True)).unionByName(fill.withColumn("anchor", F.lit(False)), allowMissingColumns=True)
    return retrieval.capped(rows.join(pages, ["file_id", "page"]), 25, "anchor", "file_id", "page").select("doc_id", "file_id", "page", "anchor", "score", "slot")


@CATALOG.query(
    "page_gap_fill",
    f"""WITH {CHUNKS_SQL}, a AS (SELECT file_id, page FROM chunks WHERE n_chars > 2500),
    g AS (SELECT file_id, page, lead(page) OVER (PARTITION BY file_id ORDER BY page) AS nx FROM a)
    SELECT file_id, u.p AS page FROM g, unnest(range(page + 1, nx)) AS u(p) WHERE nx - page - 1 BETWEEN 1 AND 2""",
)
def page_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.gap_fill(chunks(spark, sf_dir, n=F.lit(0)).where("n_chars > 2500").select("file_id", "page"), "file_id", "page")


@CATALOG.query(
    "rerank_floor",
    f"""WITH {FUSED_SQL}, pool AS (SELECT key, score, key % 3 <> 0 AS removed FROM fused ORDER BY score DESC, key LIMIT 30),
    r AS (SELECT *, row_number() OVER (ORDER BY removed, score DESC, key) AS rk, count(*) FILTER (NOT removed) OVER () AS kept FROM pool)
    SELECT key, round(score, 6) AS score, removed FROM r WHERE rk <= greatest(kept, 10) AND rk <= 20""",
)
def rerank_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.fuse(_strategies(spark, sf_dir))
    return retrieval.rerank(fused, F.col("key") % 3 != 0, "score", "key").select("key", F.round("score", 6).alias("score"), "removed")


@CATALOG.query(
    "follow_up_search",
    f"""WITH seen AS (SELECT vec_id FROM embeddings ORDER BY {_dist(0)}, vec_id LIMIT 20),
    h AS (SELECT 0 AS batch, vec_id, raw FROM (SELECT vec_id, {_dist(1)} AS raw FROM embeddings ORDER BY raw, vec_id LIMIT 10)
      UNION ALL SELECT 1, vec_id, raw FROM (SELECT vec_id, {_dist(2)} AS raw FROM embeddings ORDER BY raw, vec_id LIMIT 10))
    SELECT vec_id, batch, round(greatest(0, 1 - raw), 6) AS score FROM h WHERE vec_id NOT IN (SELECT vec_id FROM seen)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY batch, raw) = 1""",
)
def follow_up_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    near = lambda n, k: retrieval.nearest(emb, "vec_id", "embedding", query_vector(spark, sf_dir, n), k)
    hits = near(1, 10).withColumn("batch", F.lit(0)).unionByName(near(2, 10).withColumn("batch", F.lit(1)))
    return retrieval.follow_up(hits, near(0, 20), "vec_id").select("vec_id", "batch", F.round("score", 6).alias("score"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_METRICS = ", ".join(f"'{w}'" for w in text.METRIC_TERMS)
TERMS_SQL = f"""t AS (SELECT item_id, text, [m FOR m IN [{_METRICS}] IF contains(lower(text), m)][1:8] AS metrics,
    regexp_extract_all(lower(text), '[a-z][a-z0-9&/-]{{2,}}') AS words FROM benchmark),
k AS (SELECT item_id, text, metrics, [w FOR w, i IN words IF NOT list_contains([{_STOP}], w) AND list_position(words, w) = i
    AND NOT list_contains(flatten([string_split(m, ' ') FOR m IN metrics]), w)][1:12] AS keywords FROM t)"""


@CATALOG.query("term_extraction", f"WITH {TERMS_SQL} SELECT item_id, array_to_string(metrics, '|') AS metrics, array_to_string(keywords, '|') AS keywords FROM k")
def term_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("m", text.metric_terms(F.col("text"))).withColumn("k", text.key_terms(F.col("text"), F.col("m")))
    return rows.select("item_id", F.array_join("m", "|").alias("metrics"), F.array_join("k", "|").alias("keywords"))


_CLEAN = "trim(regexp_replace(replace({}, '%', ' percentage '), '[^A-Za-z0-9]+', ' ', 'g'))"
_QUOTED = "CASE WHEN contains({0}, ' ') THEN '\"' || {0} || '\"' ELSE {0} END"


@CATALOG.query(
    "fulltext_query_builder",
    f"""WITH {TERMS_SQL}, c AS (SELECT item_id, text, [x FOR x IN [{_CLEAN.format('t')} FOR t IN list_concat(metrics, keywords)] IF x <> ''] AS terms FROM k),
    u AS (SELECT item_id, text, [x FOR x, i IN terms IF list_position([lower(y) FOR y IN terms], lower(x)) = i][1:10] AS terms FROM c)
    SELECT item_id, CASE WHEN len(terms) > 0 THEN array_to_string([{_QUOTED.format('x')} FOR x IN terms], ' OR ') ELSE {_QUOTED.format(_CLEAN.format('text'))} END AS query FROM u""",
)
def fulltext_query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("m", text.metric_terms(F.col("text"))).withColumn("k", text.key_terms(F.col("text"), F.col("m")))
    return rows.select("item_id", text.fulltext_query(F.col("m"), F.col("k"), F.col("text")).alias("query"))


def _soft_sql(c: str) -> str:
    for pattern, kind in text.SOFTENED:
        c = f"regexp_replace({c}, '{pattern.removeprefix('(?i)')}', '{kind}', '{'gi' if pattern.startswith('(?i)') else 'g'}')"
    return f"trim({c})"


@CATALOG.query(
    "hyde_soften",
    f"""WITH p AS (SELECT o_orderkey, 'Margin rose ' || (o_orderkey % 90) || '% to 12 - ' || (13 + o_orderkey % 7) || '%, up ' || (o_orderkey % 50) || ' bps, on C$' || CAST(round(o_totalprice, 1) AS DECIMAL(18,1)) || ' mm and USD  ' || o_custkey || ' billion loans' AS t FROM orders)
    SELECT o_orderkey, {_soft_sql("t")} AS soft FROM p""",
)
def hyde_soften(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(
        F.lit("Margin rose "), (F.col("o_orderkey") % 90).cast("string"), F.lit("% to 12 - "), (13 + F.col("o_orderkey") % 7).cast("string"), F.lit("%, up "), (F.col("o_orderkey") % 50).cast("string"),
        F.lit(" bps, on C$"), F.round("o_totalprice", 1).cast("decimal(18,1)").cast("string"), F.lit(" mm and USD  "), F.col("o_custkey").cast("string"), F.lit(" billion loans"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.softened(s).alias("soft"))


@CATALOG.query(
    "natural_sort",
    f"""WITH {CHUNKS_SQL} SELECT doc_id, file_id, 'page_' || page || '.1' AS chunk_id, row_number() OVER (ORDER BY file_id, page, doc_id) AS place FROM chunks""",
)
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir, n=F.lit(0)).select("doc_id", "file_id", F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit(".1")).alias("chunk_id"))
    keyed = rows.withColumn("k", text.natural_key(F.col("chunk_id")))
    return ordering.numbered_globally(keyed, ["file_id", "k", "doc_id"], "place").drop("k")


@CATALOG.query("prefix_lookup", f"""WITH {CHUNKS_SQL} SELECT doc_id, 'page_' || page || '.1' AS chunk_id FROM chunks WHERE starts_with('page_' || page || '.1', 'page_7.')""")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir, n=F.lit(0)).select("doc_id", F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit(".1")).alias("chunk_id"))
    return rows.where(F.col("chunk_id").startswith("page_7."))
