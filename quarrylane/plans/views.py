"""Stand-ins for the engine's tables on the standard test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.session import table

#: Chunks: one per document; a file is a source and language, a page the document's rank in it.
CHUNKS_SQL = """chunks AS (
  SELECT doc_id, source AS bank, lang AS source_type, source || '_' || lang AS file_id, text, n_chars,
         CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS BIGINT) AS page
  FROM documents)"""


#: Width of the id ranges in which pages are numbered first.
ID_RANGE = 4096


def _ranks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``page``: a row's rank by id among its source and language, however many rows share them.

    A window numbers each source's and language's rows of one range of ids; the
    rows of the ranges before come from a table of counts, one row for each
    range. A source and language is thus never sorted in one task.
    """
    span = F.floor(F.col("doc_id") / ID_RANGE)
    counts = docs.groupBy("source", "lang", span.alias("__span")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("source", "lang").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("__span").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("source", "lang", "__span").orderBy("doc_id"))
    placed = docs.withColumn("__span", span).withColumn("__place", place)
    same = F.col("source").eqNullSafe(F.col("__source")) & F.col("lang").eqNullSafe(F.col("__lang")) & F.col("__span").eqNullSafe(F.col("__of"))
    joined = placed.join(offsets, same).withColumn("page", (F.col("__place") + F.col("__before")).cast("long"))
    return joined.drop("__span", "__place", "__source", "__lang", "__of", "__before")


def chunks(spark: SparkSession, sf_dir: str, pages: bool = True, **counted: Column) -> DataFrame:
    """Chunks with their texts, or, with ``counted``, without them but with those expressions over the text.

    What is counted in a text is counted before pages are numbered, so that texts stay out of the numbering's exchange.
    Plans that need neither pages nor texts say ``pages=False`` and have no exchange.
    """
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", F.col("source").alias("bank"), F.col("lang").alias("source_type"), F.concat_ws("_", "source", "lang").alias("file_id"), "n_chars"]
    if not pages:
        return docs.select(*names)
    if counted:
        rows = docs.select("doc_id", "source", "lang", "n_chars", *[c.alias(n) for n, c in counted.items()])
        return _ranks(rows).select(*names, *counted, "page")
    return _ranks(docs.select("doc_id", "source", "lang", "n_chars", "text")).select(*names, "text", "page")


#: Facts: revenue of orders by nation (bank), order priority (segment), year and quarter.
FACTS_SQL = """facts AS (
  SELECT n_name AS bank, o_orderpriority AS segment, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3, 4)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("bank"), F.col("o_orderpriority").alias("segment"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"), F.count("*").alias("n_orders"))
    )
