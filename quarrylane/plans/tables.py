"""Query of chart candidates from tables of the lines of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.operators import tables
from quarrylane.session import table

CATALOG = Catalog()
QUESTION = "What is the trend of the share of each segment?"
# Each order's lines are a table of one of four kinds: over periods, over banks, of parts, of steps.
COLUMNS = {0: ("Metric", "Q2 2024", "Q1 2024", "Q3 2024"), 1: ("Measure", "RY", "TD", "Other"), 2: ("Segment", "First", "Second", "Note"), 3: ("Item", "Amount", "Note", "More")}
# Rows name the second column in upper case.
KEYS = {k: (a, b.upper(), *more) for k, (a, b, *more) in COLUMNS.items()}
TITLES = {0: "Key figures", 1: "Peers", 2: "Revenue by line", 3: "Capital walk"}

SQL = """WITH l AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS r, chr(CAST(64 + l_linenumber AS INTEGER)) AS label, l_returnflag = 'R' AS pct, CAST(l_quantity AS BIGINT) AS a, CAST(round(l_tax * 100) AS BIGINT) AS b,
         CASE WHEN l_linenumber % 3 <> 0 THEN CAST(round(l_discount * 100) AS BIGINT) END AS c FROM lineitem),
t AS (SELECT k, min(label) AS only_label, count(*) AS m, count(DISTINCT pct) AS units, bool_or(pct) AS any_pct, sum(a) AS sa, sum(b) AS sb FROM l GROUP BY k),
u AS (SELECT *, CASE WHEN units > 1 THEN '' WHEN any_pct THEN '%' ELSE '$' END AS one_unit, CASE WHEN any_pct THEN '%' ELSE '$' END AS any_unit FROM t),
s AS (SELECT k, string_agg(label || '[' || CASE WHEN pct THEN '%' ELSE '$' END || ']' || CASE k % 4 WHEN 0 THEN '/Q1 2024=' || b || ',/Q2 2024=' || a || CASE WHEN c IS NULL THEN '' ELSE ',/Q3 2024=' || c END ELSE '/RY=' || a || ',/TD=' || b END, ';' ORDER BY r) AS shown
  FROM l WHERE r < 6 AND k % 4 < 2 GROUP BY k),
period AS (
  SELECT u.k, CASE WHEN m = 1 THEN 'trend_line' WHEN units > 1 THEN 'small_multiple_panel' ELSE 'multi_series_line' END AS chart,
         CASE WHEN m = 1 THEN 'BANK ' || only_label || ' trend' ELSE 'Key figures trend' END AS title, CASE WHEN m = 1 THEN 'Q1 2024 to Q3 2024 | table-derived' ELSE m || ' series from BANK Q1 2024' END AS subtitle, one_unit AS unit,
         CASE WHEN m = 1 THEN 98 WHEN units > 1 THEN 80 ELSE 108 END AS score, shown AS series, '' AS points
  FROM u JOIN s USING (k) WHERE u.k % 4 = 0),
bank AS (
  SELECT u.k, CASE WHEN m = 1 THEN 'peer_rank_bar' ELSE 'small_multiple_panel' END, CASE WHEN m = 1 THEN only_label || ' peer ranking' ELSE 'Peers peer metrics' END, CASE WHEN m = 1 THEN 'BANK Q1 2024' ELSE m || ' metrics with separate scales' END,
         CASE WHEN m = 1 THEN any_unit ELSE '' END, CASE WHEN m = 1 THEN 92 ELSE 76 END, CASE WHEN m = 1 THEN '' ELSE shown END, CASE WHEN m = 1 THEN split_part(shown, ']', 2) ELSE '' END
  FROM u JOIN s USING (k) WHERE u.k % 4 = 1),
parts AS (
  SELECT u.k, CASE WHEN any_pct OR (sa BETWEEN 95 AND 105 AND sb BETWEEN 95 AND 105) THEN 'composition_100_bar' ELSE 'composition_stacked_bar' END, 'Revenue by line composition', 'BANK Q1 2024', any_unit, 76 + 10 + 14, '',
         string_agg('First/' || label || '=' || a, ',' ORDER BY r) || ',' || string_agg('Second/' || label || '=' || b, ',' ORDER BY r)
  FROM u JOIN l USING (k) WHERE k % 4 = 2 AND m >= 2 GROUP BY u.k, any_pct, sa, sb, any_unit),
steps AS (
  SELECT u.k, 'waterfall', 'Capital walk bridge', 'BANK Q1 2024', any_unit, 84 + 16, '', string_agg('/' || label || '=' || a || CASE WHEN r = 0 OR r = m - 1 THEN '*' ELSE '' END, ',' ORDER BY r)
  FROM u JOIN l USING (k) WHERE k % 4 = 3 AND m >= 3 GROUP BY u.k, any_unit)
SELECT k AS table_id, chart, title, subtitle, unit, CAST(score AS INTEGER) AS score, series, points FROM (
  SELECT * FROM period UNION ALL SELECT * FROM bank UNION ALL SELECT * FROM parts UNION ALL SELECT * FROM steps)"""


def lines_as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table for each order: its lines as rows of texts, with units, blanks and cells that hold no number."""
    kind = (F.col("l_orderkey") % 4).cast("int")
    of_kind = lambda values: F.element_at(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in values.values()]), kind + 1)
    number = lambda c: F.round(c).cast("long").cast("string")

    def row(x: Column) -> Column:
        with_unit = lambda n: F.when(x["l_returnflag"] == "R", F.concat(n, F.lit("%"))).otherwise(F.concat(F.lit("$"), n))
        third = F.when(x["l_linenumber"] % 3 == 0, "n/a").otherwise(with_unit(number(x["l_discount"] * 100)))
        more = F.when(kind == 0, third).otherwise(F.lit("see text"))
        second = F.when(kind == 3, F.lit("see text")).otherwise(with_unit(number(x["l_tax"] * 100)))
        return F.map_from_arrays(of_kind(KEYS), F.array(F.concat(F.lit(" "), F.chr(64 + x["l_linenumber"])), with_unit(number(x["l_quantity"])), second, more))

    # Lines meet as they are; their texts are made where the table is.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_tax"))).alias("lines"))
    return lines.select(
        F.col("l_orderkey").alias("table_id"), of_kind(TITLES).alias("title"), F.lit("").alias("summary"), F.lit("Slides: BANK Q1 2024").alias("combo"), of_kind(COLUMNS).alias("columns"),
        F.transform("lines", row).alias("rows"), F.array(F.lit("E1")).alias("evidence_ids"),
    )


@CATALOG.query("table_candidates", SQL)
def table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of the tables of all orders, their series and points as texts."""
    shown = lambda p: F.concat(F.coalesce(p["group"], F.lit("")), F.lit("/"), p["label"], F.lit("="), p["value"].cast("long").cast("string"), F.when(p["is_total"], "*").otherwise(""))
    listed = lambda points: F.array_join(F.transform(points, shown), ",")
    found = tables.candidates(lines_as_tables(spark, sf_dir), QUESTION)
    series = F.array_join(F.transform("series", lambda s: F.concat(s["name"], F.lit("["), s["unit"], F.lit("]"), listed(s["points"]))), ";")
    return found.withColumns({"series": series, "points": listed(F.col("points"))})
