"""Queries over records in model output: fenced, wrapped, malformed and drifting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.operators import model_records
from quarrylane.session import table

CATALOG = Catalog()

# A response of each order, by its key: the text before and after, and the findings. {k}, {c} and {p} are numbers and a text of the order.
_GOOD = '{"finding": " Order {k} ", "page": {c}.7, "location_detail": "row {k}", "metric_value": {c}, "unit": null, "period": "{p}", "finding_type": "Table", "source_ref_ids": ["S{k}", null, 2], "table": {"title": "T", "columns": ["a", " b "], "rows": [{"a": 1, "b": "x"}, [{k}, "y", "z"], "odd"]}}'
_SHAPES = (
    '```json\n{"findings": [' + _GOOD + "]}\n```",
    'Here it is: {"findings": [' + _GOOD + ', {"finding": "second", "page": true, "location_detail": "x", "metric_value": 0, "source_ref_ids": "[\\"A\\", \\"B\\"]", "finding_type": "odd"}]} - done',
    '{"findings": [{"finding": "no page", "page": "{c}", "location_detail": "x"}, ' + _GOOD + "]}",
    '{"findings": [{"finding": "cut',
    '{"findings": {"finding": "not a list"}}',
    '{"findings": ["text", {"finding": "  ", "page": 1, "location_detail": "x"}, {"finding": "f", "page": {c}, "location_detail": null}, {"finding": "f", "page": {c}, "location_detail": "here", "source_ref_ids": "S{k}", "table": {"rows": []}}]}',
    "no object at all",
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("o_orderkey") % len(_SHAPES)).cast("int") + 1)
    for name, c in (("{k}", F.col("o_orderkey")), ("{c}", F.col("o_custkey")), ("{p}", F.col("o_orderpriority"))):
        shape = F.replace(shape, F.lit(name), c.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shape.alias("said"))


_QUOTED = ", ".join("'" + s.replace("'", "''") + "'" for s in _SHAPES)
_TEXT = lambda name: f"CASE json_type(f, '$.{name}') WHEN 'BOOLEAN' THEN CASE WHEN f->>'$.{name}' = 'true' THEN 'True' ELSE '' END ELSE CASE WHEN f->>'$.{name}' IN ('0', '[]', '{{}}') THEN '' ELSE coalesce(f->>'$.{name}', '') END END"

SQL = f"""WITH r AS (SELECT o_orderkey, replace(replace(replace(([{_QUOTED}])[o_orderkey % {len(_SHAPES)} + 1], '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{c}}', CAST(o_custkey AS VARCHAR)), '{{p}}', o_orderpriority) AS said FROM orders),
s AS (SELECT o_orderkey, regexp_replace(regexp_replace(trim(said, ' ' || chr(10)), '^```(?:json)?\\s*', '', 'i'), '\\s*```$', '') AS t FROM r),
o AS (SELECT o_orderkey, CASE WHEN contains(t, '{{') AND contains(t, '}}') THEN substr(t, instr(t, '{{'), length(t) - instr(reverse(t), '}}') + 2 - instr(t, '{{')) ELSE t END AS t FROM s),
j AS (SELECT o_orderkey, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN CAST(t AS JSON) END END AS v FROM o),
e AS (SELECT o_orderkey, unnest(v->'$.findings[*]') AS f, generate_subscripts(v->'$.findings[*]', 1) - 1 AS place FROM j WHERE json_type(v, '$.findings') = 'ARRAY'),
c AS (SELECT *, CASE WHEN json_type(f) <> 'OBJECT' THEN 'each finding must be an object'
    WHEN coalesce(json_type(f, '$.finding'), '') <> 'VARCHAR' OR trim(f->>'$.finding') = '' THEN 'finding text is required'
    WHEN coalesce(json_type(f, '$.page'), '') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN 'finding page is required'
    WHEN coalesce(json_type(f, '$.location_detail'), '') <> 'VARCHAR' OR trim(f->>'$.location_detail') = '' THEN 'finding location_detail is required' END AS error FROM e),
g AS (
  SELECT o_orderkey, place, error, trim(f->>'$.finding') AS finding, CASE json_type(f, '$.page') WHEN 'BOOLEAN' THEN 1 ELSE CAST(trunc(CAST(f->>'$.page' AS DOUBLE)) AS BIGINT) END AS page, trim(f->>'$.location_detail') AS location_detail,
         {_TEXT("metric_value")} AS metric_value, {_TEXT("unit")} AS unit, {_TEXT("period")} AS period,
         CASE WHEN lower(f->>'$.finding_type') = 'table' THEN 'table' ELSE '' END AS finding_type,
         CASE json_type(f, '$.source_ref_ids') WHEN 'ARRAY' THEN array_to_string([x FOR x IN (f->>'$.source_ref_ids[*]') IF x IS NOT NULL AND x <> 'null'], ',')
           WHEN 'VARCHAR' THEN CASE WHEN (f->>'$.source_ref_ids') LIKE '[%' THEN array_to_string(CAST(f->>'$.source_ref_ids' AS JSON)->>'$[*]', ',') ELSE f->>'$.source_ref_ids' END ELSE '' END AS refs,
         CASE WHEN json_type(f, '$.table.columns') = 'ARRAY' THEN 'T|a,b|a=1;b=x|a=' || o_orderkey || ';b=y' END AS shown_table
  FROM c WHERE error IS NULL)"""


@CATALOG.query(
    "model_findings",
    f"""{SQL} SELECT * FROM g
    UNION ALL SELECT o_orderkey, place, error, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c WHERE error IS NOT NULL
    UNION ALL SELECT o_orderkey, NULL, CASE WHEN v IS NULL THEN 'no JSON object' ELSE 'findings must be an array' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM j WHERE v IS NULL OR coalesce(json_type(v, '$.findings'), '') <> 'ARRAY'""",
)
def model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in a response of every order, each with its error or its fields; tables as texts."""
    found = model_records.findings(responses(spark, sf_dir), "o_orderkey", "said")
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    row = lambda r: F.array_join(F.transform(F.array_sort(F.map_entries(r)), entry), ";")
    t = F.col("table")
    shown = F.when(t.isNotNull(), F.concat_ws("|", t["title"], F.array_join(t["columns"], ","), F.array_join(F.transform(t["rows"], row), "|")))
    return found.select(
        "o_orderkey", "place", "error", "finding", "page", "location_detail", "metric_value", "unit", "period", "finding_type", F.array_join("source_ref_ids", ",").alias("refs"), shown.alias("shown_table")
    )


@CATALOG.query(
    "model_responses",
    f"""{SQL}, a AS (SELECT o_orderkey, place, error FROM c UNION ALL SELECT o_orderkey, NULL, CASE WHEN v IS NULL THEN 'no JSON object' ELSE 'findings must be an array' END FROM j WHERE v IS NULL OR coalesce(json_type(v, '$.findings'), '') <> 'ARRAY')
    SELECT o_orderkey, CASE WHEN count(error) = 0 THEN count(*) ELSE 0 END AS n, arg_min(coalesce('finding ' || place || ': ', '') || error, coalesce(place, -1)) FILTER (error IS NOT NULL) AS error FROM a GROUP BY o_orderkey""",
)
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each response brings, or the first error and where it is."""
    return model_records.accepted(model_records.findings(responses(spark, sf_dir), "o_orderkey", "said"), "o_orderkey")
