"""Queries of reviews by scope, groups in order of sight, embedding rows of all scopes, and charts that are planned or fill slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.operators import charts, chunking, ordering, review
from quarrylane.plans.views import CHUNKS_SQL, FACTS_SQL, chunks, facts
from quarrylane.session import table

CATALOG = Catalog()

# A scope is 16 customers; its reviewer names every third remainder of its orders' keys, some as texts, beside what is no index.
_REVIEW_SQL = """h AS (SELECT o_custkey // 16 AS scope, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey // 16 ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, count(*) OVER (PARTITION BY o_custkey // 16) AS n FROM orders),
out AS (SELECT DISTINCT o_custkey // 16 AS scope, o_orderkey % 40 AS rank FROM orders WHERE (o_orderkey % 40 + o_custkey // 16) % 3 <> 1 AND (o_custkey // 16) % 5 > 1),
pool AS (SELECT h.*, n > 20 AND out.rank IS NOT NULL AS gone FROM h LEFT JOIN out USING (scope, rank) WHERE n <= 20 OR h.rank < 30),
c AS (SELECT *, sum(gone::INT) OVER (PARTITION BY scope ORDER BY rank) AS nth, count(*) FILTER (NOT gone) OVER (PARTITION BY scope) AS stay, count(*) OVER (PARTITION BY scope) AS m FROM pool),
k AS (SELECT *, gone AND nth <= greatest(0, least(10, m) - stay) AS restored FROM c)
SELECT scope, o_orderkey, CAST(rank AS INTEGER) AS rank, restored FROM k WHERE NOT gone OR restored QUALIFY row_number() OVER (PARTITION BY scope ORDER BY rank) <= 20"""


@CATALOG.query("reviewed_scopes", f"WITH {_REVIEW_SQL}")
def reviewed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each scope that its reviewer leaves."""
    hits = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 16).alias("scope"), "o_orderkey", "o_totalprice")
    named = hits.select("scope", (F.col("o_orderkey") % 40).alias("i")).distinct().where("(i + scope) % 3 <> 1")
    shown = F.when(F.col("i") % 4 == 0, F.concat(F.lit('" '), F.col("i").cast("string"), F.lit('"'))).when(F.col("i") % 4 == 1, F.concat(F.col("i").cast("string"), F.lit(".0"))).otherwise(F.col("i").cast("string"))
    lists = named.groupBy("scope").agg(F.concat(F.lit("["), F.array_join(F.collect_list(shown), ", "), F.lit(', true, 1.5, "x", null, -1]')).alias("list"))
    kind = F.col("scope") % 5
    answers = lists.select("scope", F.when(kind == 0, F.concat("list", F.lit(" is my answer"))).when(kind == 1, F.concat(F.lit('{"remove": '), "list", F.lit("}"))).otherwise(F.col("list")).alias("answer"))
    return review.reviewed(hits, answers, ["scope"], "o_totalprice", "o_orderkey").select("scope", "o_orderkey", "rank", "restored")


@CATALOG.query(
    "first_seen_periods",
    """WITH o AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders),
    f AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, y, q) AS first, row_number() OVER (PARTITION BY o_custkey, y, q ORDER BY o_orderkey) AS place FROM o)
    SELECT o_orderkey, o_custkey, y AS year, q AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY first) AS group_no, place FROM f""",
)
def first_seen_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by period, periods in the order of their first order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    return ordering.grouped_by_first(rows, ["o_custkey"], ["year", "quarter"], "o_orderkey")


_ISSUE_SQL = f"""{CHUNKS_SQL}, u AS (SELECT doc_id, text, file_id || '#' || (page - 1) // 40 AS document_id, CAST((page - 1) % 40 // 4 AS VARCHAR) AS section_id,
  regexp_extract_all(lower(text), '[a-z]{{9,}}')[1:3] AS words FROM chunks),
s AS (SELECT document_id, section_id, list(doc_id ORDER BY doc_id) AS ids, min(text) AS low FROM u GROUP BY ALL),
d AS (SELECT document_id, list(doc_id ORDER BY doc_id) AS ids FROM u GROUP BY ALL),
w AS (SELECT document_id, section_id, doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM u),
e AS (
  SELECT document_id || '::' || doc_id || '::content' AS embedding_id, 'content' AS embedding_type, 'content_unit' AS embedding_scope, document_id, section_id, [doc_id] AS ids, text FROM u
  UNION ALL SELECT document_id || '::' || doc_id || '::keyword::' || lpad(CAST(i AS VARCHAR), 3, '0') || '::' || substr(sha256(term), 1, 12), 'keyword', 'content_unit', document_id, section_id, [doc_id], term FROM w
  UNION ALL SELECT document_id || '::section::' || section_id || '::summary', 'section_summary', 'section', document_id, section_id, ids, substr(low, 1, 80) FROM s WHERE CAST(section_id AS INTEGER) <> 3
  UNION ALL SELECT document_id || '::document_summary', 'document_summary', 'document', document_id, NULL, ids, len(ids) || ' chunks' FROM d)
SELECT embedding_id, embedding_type, embedding_scope, document_id, section_id, array_to_string(ids, ',') AS unit_ids, length(text) AS n_chars, sha256(text) AS text_hash FROM e WHERE trim(coalesce(text, '')) <> ''"""


@CATALOG.query("embedding_index", f"WITH {_ISSUE_SQL}")
def embedding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to embed: chunks with their words, sections of four pages, issues of forty. One section in ten has no summary."""
    at = F.col("page") - 1
    units = chunks(spark, sf_dir).select(
        F.concat("file_id", F.lit("#"), F.floor(at / 40).cast("string")).alias("document_id"), F.floor(at % 40 / 4).cast("string").alias("section_id"), F.col("doc_id").alias("unit_id"), F.col("text").alias("content"),
        F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)), 1, 3).alias("words"),
    )
    low = F.when(F.col("section_id") != "3", F.substring(F.min("content"), 1, 80))
    sections = units.groupBy("document_id", "section_id").agg(low.alias("summary"))
    documents = units.groupBy("document_id").agg(F.concat(F.count("*").cast("string"), F.lit(" chunks")).alias("summary"))
    rows = chunking.index_rows(units, sections, documents, {"keyword": "words"})
    return rows.select("embedding_id", "embedding_type", "embedding_scope", "document_id", "section_id", F.array_join("unit_ids", ",").alias("unit_ids"), F.length("text").cast("long").alias("n_chars"), "text_hash")


QUESTION = "How do sales of the small ring and of standard parts compare across banks in 2024?"
_WANTED = ", ".join(f"'{w}'" for w in charts.subjects(QUESTION))


@CATALOG.query(
    "planned_charts",
    f"""WITH c AS (SELECT p_size AS plan, p_partkey, ['trend_line', 'multi_series_line', 'scatter_plot', 'waterfall', 'pie'][p_partkey % 5 + 1] AS chart, p_partkey % 7 AS pts, p_partkey % 3 AS srs, p_partkey % 2 = 0 AS xy,
      list_has_any(regexp_extract_all(lower(p_name || ' ' || p_type), '{charts.TERM}'), [{_WANTED}]) AS fits FROM part)
    SELECT plan, p_partkey, chart, CAST(row_number() OVER (PARTITION BY plan ORDER BY p_partkey) AS INTEGER) AS slot FROM c
    WHERE fits AND CASE chart WHEN 'trend_line' THEN pts >= 2 WHEN 'multi_series_line' THEN srs >= 2 AND pts >= 4 WHEN 'scatter_plot' THEN pts >= 4 AND xy WHEN 'waterfall' THEN pts >= 3 ELSE false END
    QUALIFY row_number() OVER (PARTITION BY plan ORDER BY p_partkey) <= 4""",
)
def planned_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four charts of each size of part that have their data and fit the question."""
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("trend_line", "multi_series_line", "scatter_plot", "waterfall", "pie")))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("plan"), "p_partkey", F.element_at(kinds, (k % 5 + 1).cast("int")).alias("chart"), F.concat_ws(" ", "p_name", "p_type").alias("shown"), (k % 7).alias("n_points"), (k % 3).alias("n_series"), (k % 2 == 0).alias("xy")
    )
    return charts.planned(rows, QUESTION, ["plan"], "p_partkey").select("plan", "p_partkey", "chart", "slot")


_SLOT_TYPES = ("small_multiple_panel", "peer_rank_bar", "trend_line", "multi_series_line", "heatmap")
_SLOTS_SQL = f"""{FACTS_SQL}, f AS (SELECT year * 4 + quarter AS p, bank, lower(segment) AS m, CASE WHEN substr(segment, 1, 1) IN ('1', '2') THEN '$' ELSE '%' END AS unit, round(value, 2) AS value FROM facts),
s AS (SELECT c_custkey AS slot_id, {list(_SLOT_TYPES)}[c_custkey % 5 + 1] AS t, c_custkey % 7 AS k7, [0, c_custkey % 3] AS ev,
  CASE WHEN c_custkey % 7 < 3 THEN [n_name] ELSE [n_name, 'NATION_' || (n_nationkey + 1) % 25] END AS banks, list_slice([1995 * 4 + c_custkey % 12, 1995 * 4 + c_custkey % 12 + 1], 1, CAST(c_custkey % 3 AS INTEGER)) AS ps, c_custkey % 4 = 0 AS any_m
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
met AS (SELECT slot_id, t, f.* FROM (SELECT slot_id, t, ps, any_m, unnest(banks) AS b FROM s) s JOIN f ON f.bank = s.b WHERE (len(ps) = 0 OR list_contains(ps, p)) AND (any_m OR contains(m, 'urgent') OR contains(m, 'low'))),
g AS (SELECT slot_id, t, m, unit, count(*) AS n, count(DISTINCT bank) AS nb, count(DISTINCT p) AS np, min(p) AS first FROM met GROUP BY ALL),
six AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY m, unit) AS i FROM g WHERE t = 'small_multiple_panel') WHERE i <= 6 AND n >= 2),
pts AS (SELECT slot_id, m, unit, string_agg(CASE WHEN np > 1 THEN CAST(p AS VARCHAR) ELSE bank END || '=' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR), ',' ORDER BY p, bank) AS shown
  FROM (SELECT met.*, np, row_number() OVER (PARTITION BY slot_id, m, unit ORDER BY p, bank) AS j FROM met JOIN six USING (slot_id, m, unit)) WHERE j <= 40 GROUP BY ALL),
panel AS (SELECT slot_id, string_agg(m || '[' || unit || ']' || shown, ';' ORDER BY m, unit) AS series FROM pts GROUP BY slot_id HAVING count(*) >= 2),
cand AS (SELECT slot_id, arg_min(o_orderkey, (-(o_orderkey % 17), o_orderkey)) AS id FROM s JOIN orders ON o_custkey = slot_id WHERE {list(_SLOT_TYPES)}[o_orderkey % 5 + 1] = t AND o_orderkey % 11 <> 0 AND list_contains(ev, o_orderkey % 3) GROUP BY slot_id),
own AS (SELECT slot_id, m, unit FROM g WHERE CASE WHEN t = 'peer_rank_bar' THEN np = 1 AND nb >= 2 WHEN t = 'trend_line' THEN nb = 1 AND np >= 2 WHEN t = 'multi_series_line' THEN nb >= 2 AND np >= 2 ELSE false END
  QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY first, m, unit) = 1)
SELECT slot_id, CASE WHEN series IS NOT NULL THEN 'panel' WHEN id IS NOT NULL THEN 'candidate' ELSE 'facts' END AS tier, CASE WHEN series IS NULL THEN id END AS candidate_id,
  CASE WHEN series IS NULL AND id IS NULL THEN own.m END AS metric_key, CASE WHEN series IS NULL AND id IS NULL THEN own.unit END AS unit, series
FROM s LEFT JOIN panel USING (slot_id) LEFT JOIN cand USING (slot_id) LEFT JOIN own USING (slot_id) WHERE series IS NOT NULL OR id IS NOT NULL OR own.m IS NOT NULL"""


@CATALOG.query("slot_charts", f"WITH {_SLOTS_SQL}")
def slot_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart for each customer's slot: a panel, one of its orders as a candidate, or one of the facts of its nations."""
    kind = lambda c: F.element_at(F.array(*map(F.lit, _SLOT_TYPES)), (c % 5 + 1).cast("int"))
    c, n = F.col("c_custkey"), F.col("n_name")
    start = (F.lit(1995 * 4) + c % 12).cast("int")
    slots = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        c.alias("slot_id"), kind(c).alias("chart_type"), F.array(F.lit(0).cast("long"), c % 3).alias("evidence_ids"),
        F.when(c % 7 < 3, F.array(n)).otherwise(F.array(n, F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 1) % 25).cast("string")))).alias("banks"),
        F.slice(F.array(start, start + 1), F.lit(1), (c % 3).cast("int")).alias("periods"), F.when(c % 4 != 0, F.array(F.lit("urgent"), F.lit("low"))).alias("metrics"),
    )
    unit = F.when(F.substring("segment", 1, 1).isin("1", "2"), "$").otherwise("%")
    period = F.col("year") * 4 + F.col("quarter")
    known = facts(spark, sf_dir).select(period.alias("pos"), "bank", period.alias("period"), F.lower("segment").alias("metric_key"), unit.alias("unit"), F.round("value", 2).alias("value"))
    o = F.col("o_orderkey")
    used = F.when(o % 11 != 0, F.array(o % 3)).otherwise(F.array().cast("array<bigint>"))
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slot_id"), o.alias("candidate_id"), kind(o).alias("chart"), (o % 17).alias("score"), used.alias("used_ids"))
    point = lambda p: F.concat(p["label"], F.lit("="), F.round(p["value"]).cast("long").cast("string"))
    series = F.array_join(F.transform("series", lambda s: F.concat(s["metric_key"], F.lit("["), s["unit"], F.lit("]"), F.array_join(F.transform(s["points"], point), ","))), ";")
    return charts.slot_charts(slots, known, found).select("slot_id", "tier", "candidate_id", "metric_key", "unit", series.alias("series"))
