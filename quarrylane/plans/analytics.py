"""Queries over facts: rankings, trends, deltas, compositions, shapes, slots and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.functions import text
from quarrylane.operators import facts as ops
from quarrylane.plans.views import FACTS_SQL, facts
from quarrylane.session import table

CATALOG = Catalog()

BANK_SQL = f"{FACTS_SQL}, bank AS (SELECT bank, year, quarter, year * 4 + quarter AS period, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM facts GROUP BY bank, year, quarter)"


def by_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).groupBy("bank", "year", "quarter").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return rows.withColumn("period", F.col("year") * 4 + F.col("quarter"))


@CATALOG.query("fact_build", f"WITH {FACTS_SQL} SELECT bank, segment, year, quarter, round(value, 2) AS value, n_orders FROM facts")
def fact_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("value", F.round("value", 2))


_RAW_SQL = """raw AS (SELECT o_orderkey AS pos, 'revenue_' || o_orderkey % 3 AS metric_key, CASE o_orderkey % 2 WHEN 0 THEN 'USD' ELSE 'usd' END AS unit, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter,
  CASE o_custkey % 2 WHEN 0 THEN 'Bank' ELSE 'BANK' END || o_custkey % 9 AS bank, o_orderpriority AS segment, o_totalprice AS value FROM orders),
dd AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY metric_key, lower(unit), year, quarter, lower(bank), lower(segment) ORDER BY pos) = 1)"""


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("pos"),
        F.concat(F.lit("revenue_"), (k % 3).cast("string")).alias("metric_key"),
        F.when(k % 2 == 0, "USD").otherwise("usd").alias("unit"),
        F.year("o_orderdate").alias("year"),
        F.quarter("o_orderdate").alias("quarter"),
        F.concat(F.when(F.col("o_custkey") % 2 == 0, "Bank").otherwise("BANK"), (F.col("o_custkey") % 9).cast("string")).alias("bank"),
        F.col("o_orderpriority").alias("segment"),
        F.col("o_totalprice").alias("value"),
    )


@CATALOG.query("fact_dedupe", f"WITH {_RAW_SQL} SELECT pos, metric_key, unit, bank FROM dd")
def fact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedupe(raw_facts(spark, sf_dir)).select("pos", "metric_key", "unit", "bank")


_GROUP_SQL = f"{_RAW_SQL}, grp AS (SELECT metric_key, unit, count(*) AS n, count(DISTINCT bank) AS banks, count(DISTINCT year * 4 + quarter) AS periods FROM dd GROUP BY metric_key, unit HAVING count(*) >= 2)"


@CATALOG.query("fact_groups", f"WITH {_GROUP_SQL} SELECT * FROM grp")
def fact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.groups(ops.dedupe(raw_facts(spark, sf_dir)))


_BASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ops.BASE_SCORES.items())


@CATALOG.query(
    "shape_classify_score",
    f"""WITH {FACTS_SQL}, g0 AS (SELECT segment AS metric_key, year, quarter, bank FROM facts),
    grp AS (SELECT metric_key, CAST(year AS VARCHAR) AS unit, count(*) AS n, count(DISTINCT bank) AS banks, count(DISTINCT quarter) AS periods FROM g0 GROUP BY metric_key, year HAVING count(*) >= 2),
    s AS (SELECT *, unnest(CASE WHEN banks >= 2 AND periods = 1 THEN [{{'c': 'peer_rank_bar', 'a': 0}}] WHEN banks = 1 AND periods = 2 THEN [{{'c': 'trend_line', 'a': 0}}, {{'c': 'trend_bar', 'a': -12}}, {{'c': 'delta_bar', 'a': 0}}]
      WHEN banks = 1 AND periods > 2 THEN [{{'c': 'trend_line', 'a': 0}}, {{'c': 'trend_bar', 'a': -12}}]
      WHEN banks >= 2 AND periods = 2 THEN [{{'c': 'slopegraph', 'a': 0}}, {{'c': 'delta_bar', 'a': -6}}, {{'c': 'heatmap', 'a': CASE WHEN banks * periods >= 12 THEN 12 ELSE -8 END}}]
      WHEN banks >= 2 AND periods >= 3 THEN [{{'c': 'multi_series_line', 'a': 0}}, {{'c': 'heatmap', 'a': CASE WHEN banks * periods >= 12 THEN 12 ELSE -8 END}}] ELSE [] END) AS s FROM grp)
    SELECT metric_key, unit, s.c AS chart, CAST(CASE s.c {_BASE} ELSE 50 END + least(12, n) + least(8, n) + CASE WHEN banks >= 2 THEN 4 ELSE 0 END + CASE WHEN periods >= 3 THEN 5 ELSE 0 END + s.a AS BIGINT) AS score
    FROM s ORDER BY score DESC, metric_key, unit, chart LIMIT 40""",
)
def shape_classify_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    grouped = f.groupBy(F.col("segment").alias("metric_key"), F.col("year").cast("string").alias("unit")).agg(F.count("*").alias("n"), F.countDistinct("bank").alias("banks"), F.countDistinct("quarter").alias("periods")).where("n >= 2")
    return ops.scored_shapes(grouped, keep=40).select("metric_key", "unit", "chart", "score")


@CATALOG.query("peer_rank", f"WITH {BANK_SQL} SELECT bank, period, round(value, 2) AS value, CAST(row_number() OVER (PARTITION BY period ORDER BY value DESC, bank) AS INTEGER) AS rank FROM bank QUALIFY rank <= 5")
def peer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("value"), "bank"))
    return by_bank(spark, sf_dir).withColumn("rank", rank).where("rank <= 5").select("bank", "period", F.round("value", 2).alias("value"), "rank")


@CATALOG.query("trend", f"WITH {BANK_SQL} SELECT bank, period, round(value, 2) AS value, round(value - lag(value) OVER (PARTITION BY bank ORDER BY period), 2) AS change FROM bank")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.col("value") - F.lag("value").over(Window.partitionBy("bank").orderBy("period"))
    return by_bank(spark, sf_dir).select("bank", "period", F.round("value", 2).alias("value"), F.round(change, 2).alias("change"))


@CATALOG.query("delta", f"WITH {BANK_SQL} SELECT bank, round(arg_min(value, period), 2) AS start_value, round(arg_max(value, period), 2) AS end_value, count(DISTINCT period) AS periods, round(arg_max(value, period) - arg_min(value, period), 2) AS delta FROM bank GROUP BY bank")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.delta(by_bank(spark, sf_dir), ["bank"], "period", "value")
    return rows.select("bank", "periods", *[F.round(c, 2).alias(c) for c in ("start_value", "end_value", "delta")])


@CATALOG.query("slopegraph", f"WITH {BANK_SQL} SELECT bank, round(max(CASE WHEN year = 1996 AND quarter = 1 THEN value END), 2) AS left_value, round(max(CASE WHEN year = 2000 AND quarter = 1 THEN value END), 2) AS right_value FROM bank WHERE quarter = 1 AND year IN (1996, 2000) GROUP BY bank HAVING count(*) = 2")
def slopegraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    rows = by_bank(spark, sf_dir).where("quarter = 1 and year in (1996, 2000)").groupBy("bank").agg(at(1996).alias("l"), at(2000).alias("r"), F.count("*").alias("n")).where("n = 2")
    return rows.select("bank", F.round("l", 2).alias("left_value"), F.round("r", 2).alias("right_value"))


@CATALOG.query("heatmap", f"WITH {BANK_SQL} SELECT bank, period, round(value, 2) AS value, round(value / max(value) OVER (PARTITION BY period), 6) AS shade FROM bank")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for each bank and period, shaded by its share of the period's largest value."""
    shade = F.col("value") / F.max("value").over(Window.partitionBy("period"))
    return by_bank(spark, sf_dir).select("bank", "period", F.round("value", 2).alias("value"), F.round(shade, 6).alias("shade"))


_PARTS = f"{FACTS_SQL}, shares AS (SELECT year, quarter, bank, segment, round(100 * value / sum(value) OVER (PARTITION BY year, quarter, bank), 4) AS share FROM facts)"


@CATALOG.query("composition_100", f"WITH {_PARTS}, t AS (SELECT year, quarter, bank, sum(share) AS total FROM shares GROUP BY year, quarter, bank) SELECT year, quarter, bank, round(total, 2) AS total, bool_and(total BETWEEN 95 AND 105) OVER (PARTITION BY year, quarter) AS is_percent FROM t")
def composition_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.round(100 * F.col("value") / F.sum("value").over(Window.partitionBy("year", "quarter", "bank")), 4)
    return ops.composition(facts(spark, sf_dir).select("year", "quarter", "bank", share.alias("share")), ["year", "quarter", "bank"], "share").withColumn("total", F.round("total", 2))


@CATALOG.query("waterfall", f"WITH {FACTS_SQL}, s AS (SELECT year, segment, sum(CAST(value AS DECIMAL(18,2))) AS v FROM facts GROUP BY year, segment), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY segment) AS n, count(*) OVER (PARTITION BY year) AS m, sum(v) OVER (PARTITION BY year ORDER BY segment) AS run FROM s) SELECT year, segment, CAST(v AS DOUBLE) AS value, CAST(run AS DOUBLE) AS running, n = 1 AS is_first, n = m AS is_last FROM r")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each year."""
    s = facts(spark, sf_dir).groupBy("year", "segment").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    w = Window.partitionBy("year").orderBy("segment")
    n, m = F.row_number().over(w), F.count("*").over(Window.partitionBy("year"))
    run = F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("year", "segment", F.col("v").cast("double").alias("value"), run.cast("double").alias("running"), (n == 1).alias("is_first"), (n == m).alias("is_last"))


@CATALOG.query(
    "scatter_pairs",
    f"""WITH {FACTS_SQL}, a AS (SELECT bank, year, quarter, segment, value FROM facts)
    SELECT x.bank, x.year, x.quarter, x.segment AS metric_x, y.segment AS metric_y, round(x.value, 2) AS x, round(y.value, 2) AS y
    FROM a x JOIN a y USING (bank, year, quarter) WHERE x.segment < y.segment QUALIFY count(*) OVER (PARTITION BY x.segment, y.segment) >= 4""",
)
def scatter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.pairs(facts(spark, sf_dir), ["bank", "year", "quarter"], "segment", "value")
    return rows.select("bank", "year", "quarter", "metric_x", "metric_y", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@CATALOG.query("small_multiples", f"WITH {FACTS_SQL}, g AS (SELECT segment, bank, year, count(*) AS n FROM facts GROUP BY segment, bank, year), s AS (SELECT segment, bank, count(*) AS points FROM g GROUP BY segment, bank HAVING count(*) >= 2) SELECT segment, count(*) AS series, CAST(sum(points) AS BIGINT) AS points FROM s GROUP BY segment HAVING count(*) >= 2 AND sum(points) >= 4")
def small_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = facts(spark, sf_dir).groupBy("segment", "bank").agg(F.countDistinct("year").alias("points")).where("points >= 2")
    return s.groupBy("segment").agg(F.count("*").alias("series"), F.sum("points").alias("points")).where("series >= 2 and points >= 4")


_SLOTS = "slots AS (SELECT 'slot' || n_nationkey AS slot_id, [n_name, 'NOBODY'] AS banks, [7985, 7990, 9000] AS periods, ['urgent', 'price of 5-LOW'] AS metrics FROM nation)"


@CATALOG.query(
    "slot_audit",
    f"""WITH {FACTS_SQL}, {_SLOTS}, w AS (SELECT slot_id, b.x AS bank, p.x AS period, m.x AS metric FROM slots, unnest(banks) AS b(x), unnest(periods) AS p(x), unnest(metrics) AS m(x))
    SELECT slot_id, bank, period, metric FROM w WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE lower(f.bank) = lower(w.bank) AND f.year * 4 + f.quarter = w.period
      AND (contains(lower(w.metric), lower(f.segment)) OR contains(lower(f.segment), lower(w.metric))))""",
)
def slot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("slot"), F.col("n_nationkey").cast("string")).alias("slot_id"),
        F.array("n_name", F.lit("NOBODY")).alias("banks"),
        F.array(F.lit(7985), F.lit(7990), F.lit(9000)).alias("periods"),
        F.array(F.lit("urgent"), F.lit("price of 5-LOW")).alias("metrics"),
    )
    f = facts(spark, sf_dir).select("bank", (F.col("year") * 4 + F.col("quarter")).alias("period"), F.col("segment").alias("metric"))
    return ops.missing_slots(slots, f)


@CATALOG.query("backfill_scope", f"WITH {BANK_SQL} SELECT DISTINCT n.n_name AS bank, y.p AS period FROM nation n, (SELECT DISTINCT period AS p FROM bank) y WHERE NOT EXISTS (SELECT 1 FROM bank b WHERE b.bank = n.n_name AND b.period = y.p AND b.value > 5500000)")
def backfill_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bank's periods without enough revenue; the periods are one small array, exploded per bank."""
    b = by_bank(spark, sf_dir)
    periods = [r.period for r in b.select("period").distinct().collect()]
    wanted = table(spark, sf_dir, "nation").select(F.col("n_name").alias("bank"), F.explode(F.array(*map(F.lit, periods))).alias("period"))
    return wanted.join(b.where("value > 5500000"), ["bank", "period"], "left_anti")


@CATALOG.query(
    "grounding_tolerance",
    """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, l_orderkey AS evidence_id, min(l_extendedprice) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber),
    e AS (SELECT l_orderkey AS evidence_id, l_extendedprice * (1 + l_linenumber * 0.0004::DOUBLE) AS number FROM lineitem)
    SELECT point_id, EXISTS (SELECT 1 FROM e WHERE e.evidence_id = p.evidence_id AND abs(p.value - e.number) <= greatest(0.01::DOUBLE, 0.001::DOUBLE * abs(p.value))) AS grounded FROM p""",
)
def grounding_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    points = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("value"))
    points = points.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), F.col("l_orderkey").alias("evidence_id"), "value")
    evidence = li.select(F.col("l_orderkey").alias("evidence_id"), (F.col("l_extendedprice") * (1 + F.col("l_linenumber") * F.lit(0.0004))).alias("number"))
    return ops.grounded(points, evidence).select("point_id", "grounded")


@CATALOG.query(
    "numeric_parse",
    r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || o_totalprice WHEN 1 THEN '(' || o_totalprice || ')' WHEN 2 THEN 'n/a' ELSE 'up ' || o_custkey || '% in Q1' END AS s FROM orders),
    c AS (SELECT o_orderkey, regexp_replace(trim(s), '[$,]', '', 'g') AS s FROM t), n AS (SELECT *, TRY_CAST(regexp_extract(s, '-?\d+(?:\.\d+)?', 0) AS DOUBLE) AS v FROM c)
    SELECT o_orderkey, CASE WHEN regexp_matches(s, '^\(.*\)$') THEN -abs(v) ELSE v END AS value FROM n""",
)
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("string")
    s = F.when(k == 0, F.concat(F.lit("$"), price)).when(k == 1, F.concat(F.lit("("), price, F.lit(")"))).when(k == 2, "n/a").otherwise(F.concat(F.lit("up "), F.col("o_custkey").cast("string"), F.lit("% in Q1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_number(s).alias("value"))


@CATALOG.query(
    "evidence_numbers",
    r"""WITH t AS (SELECT o_orderkey, 'Q' || o_orderkey % 4 + 1 || ' 2024: $' || o_custkey || ',500 or ' || o_orderkey % 90 || '.5%' AS s FROM orders),
    c AS (SELECT o_orderkey, regexp_replace(regexp_replace(s, '[$,]', '', 'g'), '(?i)\bQ[1-4]\b|\b20\d{2}\b', ' ', 'g') AS s FROM t)
    SELECT o_orderkey, unnest([CAST(x AS DOUBLE) FOR x IN regexp_extract_all(s, '-?\d+(?:\.\d+)?')]) AS number FROM c""",
)
def evidence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("Q"), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit(" 2024: $"), F.col("o_custkey").cast("string"), F.lit(",500 or "), (F.col("o_orderkey") % 90).cast("string"), F.lit(".5%"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.all_numbers(s)).alias("number"))


@CATALOG.query("table_profile", "SELECT c AS column_name, count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) AS n_numeric, count(*) AS n, count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) >= least(2, count(*)) AS is_numeric FROM (SELECT unnest([{'c': 'c_name', 'v': c_name}, {'c': 'c_acctbal', 'v': CAST(c_acctbal AS VARCHAR)}, {'c': 'c_mktsegment', 'v': c_mktsegment}], recursive := true) FROM customer) GROUP BY c")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns melted to rows, each counted for values that parse as numbers."""
    names = ["c_name", "c_acctbal", "c_mktsegment"]
    rows = table(spark, sf_dir, "customer").select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in names])).alias("x"))
    numeric = F.count_if(F.col("x.v").try_cast("double").isNotNull())
    return rows.groupBy(F.col("x.c").alias("column_name")).agg(numeric.alias("n_numeric"), F.count("*").alias("n")).withColumn("is_numeric", F.col("n_numeric") >= F.least(F.lit(2), F.col("n")))


_POINTS = """pt AS (SELECT o_orderkey AS point_id, [o_orderkey, o_orderkey + 1] AS ev, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 1.002::DOUBLE ELSE o_totalprice * 0.5::DOUBLE END AS value,
  CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice * 0.5::DOUBLE END AS s, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS e FROM orders),
evd AS (SELECT o_orderkey AS id, o_totalprice AS number FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 0.5::DOUBLE FROM orders WHERE o_orderkey % 2 = 0),
num AS (SELECT point_id, ev, 'value' AS name, value AS v FROM pt UNION ALL SELECT point_id, ev, 'start', s FROM pt WHERE s IS NOT NULL UNION ALL SELECT point_id, ev, 'end', e FROM pt WHERE e IS NOT NULL),
hit AS (SELECT DISTINCT point_id, name FROM (SELECT point_id, name, v, unnest(ev) AS id FROM num) n JOIN evd USING (id) WHERE abs(v - number) <= greatest(0.01::DOUBLE, 0.001::DOUBLE * abs(v))),
agg AS (SELECT n.point_id, bool_and(h.name IS NOT NULL) AS al, bool_and(h.name IS NOT NULL OR n.name = 'value') AS oth FROM num n LEFT JOIN hit h ON n.point_id = h.point_id AND n.name = h.name GROUP BY n.point_id)"""


@CATALOG.query(
    "planner_points",
    f"WITH {_POINTS} SELECT point_id FROM agg JOIN pt USING (point_id) WHERE al OR (oth AND coalesce(abs((e - s) - value) <= greatest(0.01::DOUBLE, 0.001::DOUBLE * abs(e - s)), false))",
)
def planner_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a planned chart that their evidence bears out."""
    from quarrylane.operators import charts

    o, k, price = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    points = o.select(
        k.alias("point_id"),
        F.array(k, k + 1).alias("evidence_ids"),
        F.when(k % 3 == 0, price).when(k % 3 == 1, price * F.lit(1.002)).otherwise(price * F.lit(0.5)).alias("value"),
        F.when(k % 3 == 2, price * F.lit(0.5)).alias("start"),
        F.when(k % 3 == 2, price).alias("end"),
    )
    numbers = o.where(k % 7 != 0).select(k.alias("evidence_id"), price.alias("number")).union(o.where(k % 2 == 0).select(k, price * F.lit(0.5)))
    return charts.valid_points(points, numbers)


@CATALOG.query(
    "slot_artifacts",
    """WITH s AS (SELECT n_nationkey AS slot_id, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS chart_type, [0, 1, n_nationkey % 5] AS ids FROM nation),
    c AS (SELECT n_nationkey AS slot_id, r_regionkey AS candidate_id, CASE WHEN r_regionkey % 2 = 0 THEN 'A' ELSE 'B' END AS chart, (r_regionkey * 7 + n_nationkey) % 5 AS score, [r_regionkey] AS used FROM nation, region)
    SELECT slot_id, candidate_id, chart FROM s JOIN c USING (slot_id) WHERE list_has_all(ids, used) QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY chart <> chart_type, score DESC, candidate_id) = 1""",
)
def slot_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylane.operators import charts

    n = F.col("n_nationkey")
    slots = table(spark, sf_dir, "nation").select(n.alias("slot_id"), F.when(n % 2 == 0, "A").otherwise("B").alias("chart_type"), F.array(F.lit(0), F.lit(1), n % 5).alias("evidence_ids"))
    each = table(spark, sf_dir, "nation").select(n.alias("slot_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("candidate_id"))
    c = F.col("candidate_id")
    made = each.select("slot_id", "candidate_id", F.when(c % 2 == 0, "A").otherwise("B").alias("chart"), ((c * 7 + F.col("slot_id")) % 5).alias("score"), F.array(c).alias("used_ids"))
    return charts.slot_artifacts(slots, made)
