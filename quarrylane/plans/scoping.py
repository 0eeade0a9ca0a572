"""Queries over scopes, memberships, rendering and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.functions import providers, vectors
from quarrylane.operators import render, research, scopes
from quarrylane.plans.search import query_vector
from quarrylane.plans.views import CHUNKS_SQL, chunks
from quarrylane.session import table

CATALOG = Catalog()


@CATALOG.query("bank_alias_match", "SELECT n_nationkey FROM nation WHERE list_has_any(['nation_3', ' 7 ', 'region-1'], [lower(CAST(n_nationkey AS VARCHAR)), lower(n_name), 'region-' || n_regionkey]) OR n_nationkey = 7")
def bank_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(F.lit("Nation_3"), F.lit(" 7 "), F.lit("REGION-1"), F.lit(None).cast("string"))
    tags = F.array(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")))
    return table(spark, sf_dir, "nation").where(scopes.bank_matches(wanted, F.col("n_nationkey"), F.col("n_name"), F.col("n_name"), F.lit(None).cast("array<string>"), tags)).select("n_nationkey")


@CATALOG.query("array_text_membership", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 OR o_orderpriority = '1-URGENT'")
def array_text_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat(F.lit('{"'), F.when(F.col("o_orderkey") % 3 == 1, "Target").otherwise("other"), F.lit('", '), F.when(F.col("o_orderpriority") == "1-URGENT", " target ").otherwise("x"), F.lit("}"))
    return table(spark, sf_dir, "orders").where(scopes.has_member(scopes.listed(names), F.lit(" TARGET"))).select("o_orderkey")


@CATALOG.query("source_whitelist", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'rts,' || event_type ELSE 'rts' END AS kept FROM events")
def source_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(F.lit("RTS"), F.col("event_type"), F.lit(" rts "), F.lit("unknown"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(scopes.whitelisted(asked, ["click", "view", "rts"]), ",").alias("kept"))


@CATALOG.query("completed_items", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) AS items, bool_and(o_orderstatus = 'F') AS all_done FROM orders GROUP BY o_custkey")
def completed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("done"))
    return scopes.all_completed(rows, "o_custkey", "done")


@CATALOG.query("format_consensus", "SELECT o_custkey, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) ELSE 'mixed' END AS consensus FROM orders GROUP BY o_custkey")
def format_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes.consensus(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@CATALOG.query("free_ids", "SELECT n_nationkey, 'C' || (CASE WHEN n_nationkey < 5 THEN 2 * n_nationkey + 1 ELSE n_nationkey + 5 END) AS id FROM nation")
def free_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = table(spark, sf_dir, "region").select(F.concat(F.lit("C"), (2 * F.col("r_regionkey")).cast("string")).alias("id"))
    return scopes.free_ids(table(spark, sf_dir, "nation").select("n_nationkey"), taken, "n_nationkey")


@CATALOG.query("metric_substring_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'economy plated') OR contains('economy plated', lower(p_type))")
def metric_substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(scopes.metric_matches(F.col("p_type"), F.lit("Economy plated"))).select("p_partkey")


@CATALOG.query("series_zip", "SELECT c_custkey, c_name || '=' || CAST(c_nationkey AS VARCHAR) || ';' || c_mktsegment || '=' AS zipped FROM customer")
def series_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scopes.zipped(F.array("c_name", "c_mktsegment"), F.array("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(pairs, lambda x: F.concat(x["category"], F.lit("="), x["value"])), ";").alias("zipped"))


@CATALOG.query("embedding_text", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Section: ' || source || '. ' ELSE '' END || '[' || lang || '] ' || text AS text FROM documents WHERE trim(text) <> ''")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    return rows.select("doc_id", render.embedding_text(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("lang"), F.col("text")).alias("text"))


#: The chunks of each bank that are nearest to a query vector: what a retrieval hands on, at most 20.
_NEAREST = f"""{CHUNKS_SQL}, near AS (SELECT c.*, row_number() OVER (PARTITION BY bank ORDER BY greatest(0, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))), doc_id) AS rank
  FROM chunks c JOIN embeddings ON vec_id = doc_id)"""


@CATALOG.query("evidence_blocks", f"WITH {_NEAREST} SELECT bank, string_agg('### page_' || page || chr(10) || CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 185) || chr(10) || '...[truncated]' END, chr(10) || chr(10) ORDER BY doc_id) AS block, count(*) AS n FROM near WHERE rank <= 20 GROUP BY bank")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a retrieval's results: the 20 nearest chunks of each bank."""
    d = vectors.cosine_distance(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir)))
    rank = F.row_number().over(Window.partitionBy("bank").orderBy("d", "doc_id"))
    near = chunks(spark, sf_dir, n=F.lit(0)).join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("doc_id")).withColumn("d", d)
    best = near.withColumn("rank", rank).where("rank <= 20").select("doc_id", "bank", "page")
    rows = best.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("ident", F.concat(F.lit("page_"), F.col("page").cast("string")))
    return render.evidence_block(rows, ["bank"], "doc_id", "ident", "text", 200)


@CATALOG.query("status_lines", "SELECT user_id, arg_max(props, CASE WHEN event_type = 'purchase' THEN 1000000000000 ELSE 0 END + event_id) AS line FROM events GROUP BY user_id")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "props", F.when(F.col("event_type") == "purchase", "summary").otherwise("note").alias("kind"))
    return render.status_line(rows, ["user_id"], "kind", "props", "event_id")


@CATALOG.query("evidence_links", "SELECT p_partkey, 'https://store/' || replace(replace(url_encode(p_name), '%20', '+'), '~', '%7E') || '#page=' || p_size AS href FROM part")
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", render.link("https://store/", F.col("p_name"), F.col("p_size")).alias("href"))


@CATALOG.query("provider_summaries")
def provider_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.apply(table(spark, sf_dir, "documents"), "doc_id", "text", providers.first_sentence, "string", name="summary")


@CATALOG.query("prepared_search")
def prepared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question end to end: preparation, hashing embedder for question and chunks, nine-strategy fusion."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    vectors = providers.apply(docs, "key", "text", providers.hashing_embedder(), "array<double>", name="embedding")
    return research.hybrid_search(docs, vectors, research.prepare(spark, "How did the net interest margin and loans of the other bank grow with rates?"))
