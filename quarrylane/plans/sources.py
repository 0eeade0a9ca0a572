"""Queries over pages and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.operators import sheet_ranges
from quarrylane.session import table
from quarrylane.sources import markup

CATALOG = Catalog()

_CLEAN = "replace(replace(replace(replace(replace(replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
UNITS_SQL = rf"""parts AS (SELECT page_id, string_split_regex(regexp_replace(html, '{markup.DROPPED}', ' ', 'g'), '{markup.BLOCKS}') AS ps, html FROM pages),
units AS (SELECT page_id, html, [u FOR u IN [trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g')) FOR p IN ps] IF u <> ''] AS us FROM parts)"""


@CATALOG.query("html_extract_units", f"WITH {UNITS_SQL} SELECT page_id, CAST(i AS INTEGER) - 1 AS unit, us[i] AS text FROM units, unnest(range(1, len(us) + 1)) AS r(i)")
def html_extract_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(markup.page_units(F.col("html"))).alias("unit", "text"))


@CATALOG.query("html_page_summary", f"WITH {UNITS_SQL} SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, len(us) AS n_units FROM units")
def html_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.page_title(F.col("html")).alias("title"), F.size(markup.page_units(F.col("html"))).cast("long").alias("n_units"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by order year as cells: suppliers' balances as numbers, shares as percentages."""
    s = table(spark, sf_dir, "supplier")
    sheet = F.concat(F.lit("sheet"), (F.col("s_suppkey") % 4).cast("string"))
    row = F.floor(F.col("s_suppkey") / 4).cast("int") + 1
    a = s.select(sheet.alias("sheet"), row.alias("row"), F.lit(1).alias("col"), F.col("s_name").alias("value"), F.lit(False).alias("numeric"), F.lit(False).alias("percent"))
    b = s.select(sheet.alias("sheet"), row.alias("row"), F.lit(2).alias("col"), F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string").alias("value"), F.lit(True).alias("numeric"), F.lit(False).alias("percent"))
    c = s.where("s_suppkey % 3 = 0").select(sheet.alias("sheet"), row.alias("row"), F.lit(27).alias("col"), F.lit("0.1234").alias("value"), F.lit(True).alias("numeric"), F.lit(True).alias("percent"))
    return a.unionByName(b).unionByName(c)


@CATALOG.query(
    "cell_text",
    """SELECT s_suppkey, CASE WHEN contains(t, '.') THEN rtrim(rtrim(t, '0'), '.') ELSE t END AS plain, CASE WHEN contains(p, '.') THEN rtrim(rtrim(p, '0'), '.') ELSE p END || '%' AS percent
    FROM (SELECT s_suppkey, CAST(CAST(round(s_acctbal, 2) AS DECIMAL(12, 2)) AS VARCHAR) AS t, CAST(CAST(s_suppkey AS DECIMAL(18, 2)) / 8 * 100 AS DECIMAL(18, 2))::VARCHAR AS p FROM supplier)""",
)
def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = F.lit(True), F.lit(False)
    value = F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string")
    eighth = (F.col("s_suppkey").cast("decimal(18,4)") / 8).cast("decimal(18,6)").cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", markup.cell_text(value, yes, no).alias("plain"), markup.cell_text(eighth, yes, yes).alias("percent"))


@CATALOG.query("sheet_markdown")
def sheet_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("text", markup.cell_text(F.col("value"), F.col("numeric"), F.col("percent")))
    return markup.sheet_markdown(cells, ["sheet"])


_BALANCE = "CASE WHEN contains(b, '.') THEN rtrim(rtrim(b, '0'), '.') ELSE b END"
SERIES_SQL = f"""cells AS (SELECT s_suppkey, s_nationkey AS nation, 'sheet' || s_suppkey % 4 AS sheet, CAST(floor(s_suppkey / 4) AS INTEGER) + 1 AS r, s_name AS name,
  CAST(CAST(round(s_acctbal, 2) AS DECIMAL(12, 2)) AS VARCHAR) AS b FROM supplier),
series AS (SELECT sheet, nation, min(r) AS lo, max(r) AS hi FROM cells GROUP BY sheet, nation),
points AS (SELECT s.sheet, s.nation, c.r - s.lo + 1 AS i, c.name || ': ' || {_BALANCE} AS point FROM series s JOIN cells c ON c.sheet = s.sheet AND c.r BETWEEN s.lo AND s.hi)"""


@CATALOG.query(
    "chart_references",
    f"""WITH {SERIES_SQL} SELECT sheet, nation, count(*) AS n_points, string_agg(point, '; ' ORDER BY i) FILTER (i <= 12) AS preview FROM points GROUP BY sheet, nation""",
)
def chart_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each sheet and nation, from its first supplier's row to its last one's; names are categories, balances values."""
    cells = _cells(spark, sf_dir).withColumn("text", markup.cell_text(F.col("value"), F.col("numeric"), F.col("percent"))).withColumn("book", F.lit("book"))
    supplier = table(spark, sf_dir, "supplier")
    row = F.floor(F.col("s_suppkey") / 4).cast("int") + 1
    ends = supplier.groupBy(F.concat(F.lit("sheet"), (F.col("s_suppkey") % 4).cast("string")).alias("sheet"), F.col("s_nationkey").alias("nation")).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    ref = lambda c: F.concat(F.lit("'"), "sheet", F.lit(f"'!${c}$"), F.col("lo").cast("string"), F.lit(f":${c}$"), F.col("hi").cast("string"))
    series = ends.select(F.lit("book").alias("book"), "sheet", "nation", ref("A").alias("categories"), ref("B").alias("values"))
    return sheet_ranges.previews(sheet_ranges.series_points(series, cells, "book", ["sheet", "nation"]), ["sheet", "nation"])
