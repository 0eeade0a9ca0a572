"""Facts, their shapes, rankings, deltas, compositions, slots and grounding of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base score of each kind of chart, and words of a question that favour some kinds.
BASE_SCORES = {
    "trend_line": 78, "trend_bar": 62, "peer_rank_bar": 82, "multi_series_line": 86, "slopegraph": 86, "delta_bar": 74,
    "heatmap": 70, "scatter_plot": 72, "small_multiple_panel": 68, "composition_stacked_bar": 76, "composition_100_bar": 76,
    "waterfall": 84,
}
INTENTS = {
    "trend": (("trend", "over time", "qoq", "yoy", "trajectory"), ("trend_line", "trend_bar", "multi_series_line")),
    "peer": (("peer", "compare", "comparison", "rank", "ranking"), ("peer_rank_bar", "slopegraph", "heatmap")),
    "change": (("change", "delta", "increase", "decrease", "movement"), ("delta_bar",)),
    "mix": (("mix", "share", "composition", "segment"), ("composition_stacked_bar", "composition_100_bar")),
    "bridge": (("bridge", "walk", "movement", "reconciliation"), ("waterfall",)),
}
INTENT_BOOST = 10
OTHER_SCORE = 50
#: Absolute and relative tolerance of a grounded number.
TOLERANCE, SHARE = 0.01, 0.001


def tolerance(value: Column) -> Column:
    return F.greatest(F.lit(TOLERANCE), SHARE * F.abs(value))


# The label of a bank and period, after an optional source.
SOURCE_PREFIX = r"^[A-Za-z][A-Za-z 0-9&-]*:\s+"
COMBO = r"^(.+?)\s+(Q[1-4])\s+(\d{4})$"


def from_findings(findings: DataFrame) -> DataFrame:
    """Facts of the findings that have a metric with a name and a number, evidence, and a label such as ``Slides: RY Q1 2024``.

    ``findings``: ``finding_id``, ``combo_label``, ``metric_name``,
    ``metric_value``, ``unit``, ``period``, ``segment``, ``evidence_ids``. A
    blank period is the label's; blank evidence ids don't count.
    """
    blank = F.lit("")
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), blank))
    label = F.regexp_replace(trimmed("combo_label"), SOURCE_PREFIX, "")
    part = lambda i: F.regexp_extract(label, COMBO, i)
    number = F.regexp_replace(F.regexp_extract(F.replace(trimmed("metric_value"), F.lit("$")), r"-?\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("double")
    negative = trimmed("metric_value").startswith("(") & trimmed("metric_value").endswith(")")
    evidence = F.filter(F.coalesce("evidence_ids", F.array().cast("array<string>")), lambda e: F.coalesce(e, blank) != "")
    rows = findings.select(
        "finding_id",
        part(1).alias("bank"),
        F.coalesce(F.nullif(trimmed("period"), blank), F.concat_ws(" ", part(2), part(3))).alias("period"),
        part(3).try_cast("int").alias("year"),
        part(2).alias("quarter"),
        trimmed("metric_name").alias("metric"),
        F.when(negative, -number).otherwise(number).alias("value"),
        trimmed("unit").alias("unit"),
        trimmed("segment").alias("segment"),
        evidence.alias("evidence_ids"),
    )
    return rows.where("bank <> '' and metric <> '' and value is not null and size(evidence_ids) > 0")


def dedupe(facts: DataFrame) -> DataFrame:
    """The first fact of each (metric, unit, period, bank, segment), case of unit, bank and segment apart."""
    key = ["metric_key", F.lower("unit"), "year", "quarter", F.lower("bank"), F.lower("segment")]
    return facts.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("__n = 1").drop("__n")


def groups(facts: DataFrame) -> DataFrame:
    """Facts by metric and unit with at least two: counts of facts, banks and periods."""
    period = F.col("year") * 4 + F.col("quarter")
    return facts.groupBy("metric_key", "unit").agg(F.count("*").alias("n"), F.countDistinct("bank").alias("banks"), F.countDistinct(period).alias("periods")).where("n >= 2")


def shapes(banks: Column, periods: Column) -> Column:
    """Array of (chart, adjustment) that fit so many banks and periods."""
    opt = lambda name, by: F.struct(F.lit(name).alias("chart"), (by if isinstance(by, Column) else F.lit(by)).cast("int").alias("adjust"))
    grid = F.when(banks * periods >= 12, 12).otherwise(-8)
    none = F.array().cast("array<struct<chart:string,adjust:int>>")
    return (
        F.when((banks >= 2) & (periods == 1), F.array(opt("peer_rank_bar", 0)))
        .when((banks == 1) & (periods == 2), F.array(opt("trend_line", 0), opt("trend_bar", -12), opt("delta_bar", 0)))
        .when((banks == 1) & (periods > 2), F.array(opt("trend_line", 0), opt("trend_bar", -12)))
        .when((banks >= 2) & (periods == 2), F.array(opt("slopegraph", 0), opt("delta_bar", -6), opt("heatmap", grid)))
        .when((banks >= 2) & (periods >= 3), F.array(opt("multi_series_line", 0), opt("heatmap", grid)))
        .otherwise(none)
    )


def intent_boost(chart: Column, question: str) -> Column:
    """What a question's words add to the score of a kind of chart."""
    low = question.lower()
    favoured = [c for words, charts in INTENTS.values() if any(w in low for w in words) for c in charts]
    return F.when(chart.isin(*favoured), INTENT_BOOST).otherwise(0) if favoured else F.lit(0)


def scored_shapes(grouped: DataFrame, evidence: Column | None = None, keep: int | None = 6, question: str = "") -> DataFrame:
    """Best ``keep`` charts (None: all) by score over all groups: base, facts up to 12, evidence up to 8, peers, periods, the question's intent, adjustment."""
    base = F.map_from_arrays(F.array(*map(F.lit, BASE_SCORES)), F.array(*map(F.lit, BASE_SCORES.values())))
    rows = grouped.withColumn("s", F.explode(shapes(F.col("banks"), F.col("periods")))).select("*", F.col("s.chart").alias("chart"), F.col("s.adjust").alias("adjust")).drop("s")
    score = F.coalesce(F.try_element_at(base, F.col("chart")), F.lit(OTHER_SCORE)) + F.least(F.lit(12), F.col("n")) + F.least(F.lit(8), evidence if evidence is not None else F.col("n"))
    score = score + F.when(F.col("banks") >= 2, 4).otherwise(0) + F.when(F.col("periods") >= 3, 5).otherwise(0) + intent_boost(F.col("chart"), question) + F.col("adjust")
    ranked = rows.withColumn("score", score.cast("long"))
    return ranked if keep is None else ranked.orderBy(F.desc("score"), "metric_key", "unit", "chart").limit(keep)


def delta(facts: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """First and last value of each group by period, and their difference; one aggregation."""
    return facts.groupBy(*by).agg(F.min_by(value, period).alias("start_value"), F.max_by(value, period).alias("end_value"), F.countDistinct(period).alias("periods")).withColumn(
        "delta", F.col("end_value") - F.col("start_value")
    )


def composition(parts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Totals of each group, and whether all lie within 95 and 105, so that the parts are percentages."""
    totals = parts.groupBy(*by).agg(F.sum(value).alias("total"))
    return totals.withColumn("is_percent", F.bool_and(F.col("total").between(95, 105)).over(Window.partitionBy(*by[:-1])) if len(by) > 1 else F.col("total").between(95, 105))


def grounded(points: DataFrame, evidence: DataFrame) -> DataFrame:
    """Points with ``grounded``: whether their evidence holds a number within the tolerance.

    An equality join on the evidence id, with the band as a further condition.
    """
    e = evidence.select(F.col("evidence_id").alias("__e"), F.col("number").alias("__n"))
    near = (F.col("evidence_id") == F.col("__e")) & (F.abs(F.col("value") - F.col("__n")) <= tolerance(F.col("value")))
    found = points.join(e, near, "left_semi").select("point_id").distinct().withColumn("__hit", F.lit(True))
    return points.join(found, "point_id", "left").withColumn("grounded", F.coalesce("__hit", F.lit(False))).drop("__hit")


def missing_slots(slots: DataFrame, facts: DataFrame) -> DataFrame:
    """(slot, bank, period, metric) that a slot asks for and no fact has.

    A slot's arrays are exploded; its metric matches a fact's if either holds the other, so the metrics of facts, few and distinct,
    are matched to those of slots first.
    """
    wanted = slots.select("slot_id", F.explode("banks").alias("bank"), "periods", "metrics")
    wanted = wanted.select("slot_id", "bank", F.explode("periods").alias("period"), "metrics").select("slot_id", "bank", "period", F.explode("metrics").alias("metric"))
    f = facts.select(F.lower("bank").alias("__b"), F.col("period").alias("__p"), F.lower("metric").alias("__m")).distinct()
    metric = F.lower("metric")
    match = (F.lower("bank") == F.col("__b")) & (F.col("period") == F.col("__p")) & (F.contains(metric, F.col("__m")) | F.contains(F.col("__m"), metric))
    return wanted.join(f, match, "left_anti")


def pairs(facts: DataFrame, on: list[str], metric: str, value: str, peers: int = 4) -> DataFrame:
    """Values of two metrics side by side per key, for pairs of metrics with at least ``peers`` points."""
    a = facts.select(*on, F.col(metric).alias("metric_x"), F.col(value).alias("x"))
    b = facts.select(*on, F.col(metric).alias("metric_y"), F.col(value).alias("y"))
    both = a.join(b, on).where("metric_x < metric_y")
    return both.withColumn("__n", F.count("*").over(Window.partitionBy("metric_x", "metric_y"))).where(F.col("__n") >= peers).drop("__n")


def usage_cost(prompt: Column, completion: Column, rate_in: float, rate_out: float) -> Column:
    """Cost of tokens at prices per thousand, to six places."""
    per = lambda n, rate: n.cast("decimal(18,0)") / F.lit(1000) * F.lit(str(rate)).cast("decimal(12,6)")
    return F.round(per(prompt, rate_in) + per(completion, rate_out), 6).cast("decimal(12,6)")
