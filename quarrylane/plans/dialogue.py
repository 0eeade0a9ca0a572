"""Queries over conversations, findings and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.functions import text
from quarrylane.operators import evidence, ordering, scopes
from quarrylane.plans.views import CHUNKS_SQL, chunks
from quarrylane.session import table

CATALOG = Catalog()


@CATALOG.query(
    "qa_sessionize",
    """SELECT conv_id, turn, role, CAST(sum(o) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS session FROM
    (SELECT *, CASE WHEN role = 'user' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 1 ELSE 0 END AS o FROM conversations)""",
)
def qa_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordering.sessionise(turns, ["conv_id"], ["turn"], F.col("role") == "user")


@CATALOG.query("turn_numbering", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user', turn) AS INTEGER) AS unit FROM conversations WHERE role <> 'system' AND length(trim(text)) > 0")
def turn_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role <> 'system' and length(trim(text)) > 0").select("conv_id", "turn", "role")
    return ordering.numbered(turns, ["conv_id"], [F.col("role") == "user", "turn"], "unit").select("conv_id", "turn", F.col("unit").cast("int").alias("unit"))


@CATALOG.query("last_n_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE n <= 3")
def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_messages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role")


@CATALOG.query("speaker_blocks", "SELECT conv_id, count(DISTINCT g) AS blocks, max(c) AS longest FROM (SELECT conv_id, g, count(*) OVER (PARTITION BY conv_id, g) AS c FROM (SELECT conv_id, role, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) || role AS g FROM conversations)) GROUP BY conv_id")
def speaker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordering.numbered(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], ["turn"])
    runs = turns.groupBy("conv_id", "role", F.col("turn") - F.col("n")).agg(F.count("*").alias("c"))
    return runs.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.max("c").alias("longest"))


#: Findings: documents stand for findings; what a finding says is its text, its place the page.
FINDINGS_SQL = f"""{CHUNKS_SQL}, findings AS (
  SELECT doc_id AS finding_id, bank AS source_id, file_id AS file_name, page % 5 AS page, NULL AS sheet, source_type AS section,
         CASE WHEN doc_id % 3 = 0 THEN 'Page ' || page % 5 ELSE '' END AS location, lower(trim(text)) AS finding FROM chunks)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page") % 5
    return chunks(spark, sf_dir).select(
        F.col("doc_id").alias("finding_id"),
        F.col("bank").alias("source_id"),
        F.col("file_id").alias("file_name"),
        F.lit(None).cast("string").alias("sheet"),
        F.col("source_type").alias("section"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Page "), page.cast("string"))).otherwise("").alias("location"),
        F.lower(F.trim("text")).alias("finding"),
        page.alias("page"),
    )


@CATALOG.query("ordered_dedupe", f"WITH {FINDINGS_SQL} SELECT finding_id, finding, page FROM findings QUALIFY row_number() OVER (PARTITION BY finding, page ORDER BY finding_id) = 1")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.dedupe_findings(findings(spark, sf_dir), [F.col("finding"), F.col("page")], "finding_id").select("finding_id", "finding", "page")


@CATALOG.query(
    "evidence_ids",
    f"""WITH {FINDINGS_SQL} SELECT source_id, file_name, CAST(page AS VARCHAR) AS page, '' AS sheet, section, location, min(finding_id) AS first_pos,
      'E' || row_number() OVER (ORDER BY min(finding_id)) AS id FROM findings GROUP BY source_id, file_name, page, section, location""",
)
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_ids(findings(spark, sf_dir), "finding_id")


@CATALOG.query(
    "finding_references",
    f"""WITH {FINDINGS_SQL}, refs AS (SELECT file_name, finding_id AS ref_id, (page + 1) % 5 AS page, location FROM findings WHERE finding_id % 4 = 0),
    j AS (SELECT f.finding_id, r.ref_id, CASE WHEN f.page = r.page THEN 0 WHEN contains(lower(f.location), lower(r.location)) OR contains(lower(r.location), lower(f.location)) THEN 1 ELSE 2 END AS rk
      FROM findings f LEFT JOIN refs r USING (file_name))
    SELECT finding_id, ref_id, CASE WHEN ref_id IS NOT NULL THEN rk END AS match_rank FROM j QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY rk, ref_id) = 1""",
)
def finding_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    refs = f.where("finding_id % 4 = 0").select("file_name", F.col("finding_id").alias("ref_id"), ((F.col("page") + 1) % 5).alias("page"), "location")
    return evidence.references(f, refs, "file_name")


@CATALOG.query(
    "catalog_reference_match",
    f"""WITH {CHUNKS_SQL}, c AS (SELECT doc_id AS chunk_key, 'page_' || page AS chunk_id, '/in/' || file_id AS file_path, file_id AS file_name FROM chunks),
    k AS (SELECT chunk_key AS ref_id, chunk_id, CASE WHEN chunk_key % 2 = 0 THEN file_path ELSE 'elsewhere' END AS file_path, CASE WHEN chunk_key % 3 = 0 THEN file_name ELSE 'other' END AS file_name FROM c)
    SELECT c.chunk_key, k.ref_id FROM c JOIN k ON c.chunk_id = k.chunk_id AND (c.file_path = k.file_path OR c.file_name = k.file_name)""",
)
def catalog_reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("chunk_key"), F.concat(F.lit("page_"), F.col("page").cast("string")).alias("chunk_id"), F.concat(F.lit("/in/"), "file_id").alias("file_path"), F.col("file_id").alias("file_name"))
    k = c.select(
        F.col("chunk_key").alias("ref_id"), "chunk_id", F.when(F.col("chunk_key") % 2 == 0, F.col("file_path")).otherwise("elsewhere").alias("file_path"), F.when(F.col("chunk_key") % 3 == 0, F.col("file_name")).otherwise("other").alias("file_name")
    )
    return evidence.catalog_matches(c, k)


@CATALOG.query("coverage_summary", f"WITH {CHUNKS_SQL} SELECT bank, source_type, count(*) AS n_chunks, array_to_string(list_sort(list_distinct(list('part ' || page % 11)))[1:8], ',') AS sections FROM chunks GROUP BY bank, source_type")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).withColumn("section", F.concat(F.lit("part "), (F.col("page") % 11).cast("string")))
    return evidence.coverage(rows, ["bank", "source_type"], "section")


@CATALOG.query(
    "status_by_combo",
    """SELECT source AS bank, CASE WHEN bool_or(n_chars > 9000) AND bool_or(n_chars < 200) THEN 'partial_success' WHEN bool_or(n_chars > 9000) THEN 'success' ELSE 'no_available_data' END AS status FROM documents GROUP BY source""",
)
def status_by_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("bank")).agg(F.bool_or(F.col("n_chars") > 9000).alias("f"), F.bool_or(F.col("n_chars") < 200).alias("g"))
    return rows.select("bank", evidence.status(F.col("f"), F.col("g")).alias("status"))


@CATALOG.query("source_catalog_refs", "SELECT source, lang, 'S' || row_number() OVER (ORDER BY source, lang) AS ref FROM (SELECT DISTINCT source, lang FROM documents)")
def source_catalog_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    return ordering.numbered_globally(rows, ["source", "lang"], "n").select("source", "lang", F.concat(F.lit("S"), F.col("n").cast("string")).alias("ref"))


@CATALOG.query(
    "term_union",
    """WITH t AS (SELECT o_orderkey, ['Net  Income', 'net income', 'Tier ' || o_orderkey % 3, ' ', 'tier 1', 'Loans'] AS x FROM orders),
    c AS (SELECT o_orderkey, [trim(regexp_replace(e, '\\s+', ' ', 'g')) FOR e IN x] AS y FROM t), d AS (SELECT o_orderkey, [e FOR e IN y IF e <> ''] AS y FROM c)
    SELECT o_orderkey, array_to_string([e FOR e, i IN y IF list_position([lower(z) FOR z IN y], lower(e)) = i][1:8], '|') AS terms FROM d""",
)
def term_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.lit("Net  Income"), F.lit("net income"), F.concat(F.lit("Tier "), (F.col("o_orderkey") % 3).cast("string")))
    b = F.array(F.lit(" "), F.lit("tier 1"), F.lit("Loans"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.merged_terms(a, b), "|").alias("terms"))


@CATALOG.query("id_set_difference", "SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def id_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.subtract(lab).select(F.lit("missing").alias("side"), "doc_id").union(d.intersect(lab).select(F.lit("both").alias("side"), "doc_id"))


@CATALOG.query("scope_completeness", "SELECT event_id, array_to_string([x FOR x IN [CASE WHEN event_id % 2 = 0 THEN 'question' END, CASE WHEN event_id % 3 = 0 THEN 'bank' END, CASE WHEN value < 20 THEN 'year' END, CASE WHEN event_type = 'error' THEN 'quarter' END] IF x IS NOT NULL], ',') AS missing FROM events")
def scope_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a request that are null, blank or nothing but blanks."""
    absent = {"question": F.col("event_id") % 2 == 0, "bank": F.col("event_id") % 3 == 0, "year": F.col("value") < 20, "quarter": F.col("event_type") == "error"}
    without = {"question": F.lit(None).cast("string"), "bank": F.lit(""), "year": F.lit(None).cast("string"), "quarter": F.lit("  ")}
    fields = {n: F.when(c, without[n]).otherwise(F.lit("given")) for n, c in absent.items()}
    return table(spark, sf_dir, "events").select("event_id", F.array_join(scopes.missing_fields(fields), ",").alias("missing"))


@CATALOG.query("compact_text", r"SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 57)) || '...' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.compact(F.col("text"), 60).alias("short"))


@CATALOG.query("file_id_slug", r"SELECT p_partkey, regexp_replace(regexp_replace(p_name || '.', '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '_' || regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_id, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS metric_key FROM part")
def file_id_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.file_id(F.concat("p_name", F.lit(".")), F.col("p_brand")).alias("file_id"), text.metric_key(F.col("p_type")).alias("metric_key"))


@CATALOG.query("log_redaction", r"SELECT doc_id, regexp_replace(text, '(?i)\b(token|password|secret|api[_-]?key)\b(\s*[=:]\s*)\S+', '\1\2***', 'g') AS clean FROM documents WHERE regexp_matches(text, '(?i)\b(token|password|secret|api[_-]?key)\b\s*[=:]')")
def log_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?i)\b(token|password|secret|api[_-]?key)\b\s*[=:]")).select("doc_id", text.redacted(F.col("text")).alias("clean"))


@CATALOG.query("usage_cost_rollup", """SELECT event_type, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(round(CAST(p AS DECIMAL(18,0)) / 1000 * 0.0025::DECIMAL(12,6) + CAST(c AS DECIMAL(18,0)) / 1000 * 0.01::DECIMAL(12,6), 6)) AS DOUBLE) AS cost
  FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS p, event_id % 400 AS c FROM events) GROUP BY event_type""")
def usage_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylane.operators import facts

    p, c = F.get_json_object("props", "$.k").cast("long") * 10, F.col("event_id") % 400
    rows = table(spark, sf_dir, "events").select("event_type", p.alias("p"), facts.usage_cost(p, c, 0.0025, 0.01).alias("cost"))
    return rows.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("p").alias("prompt_tokens"), F.sum("cost").cast("double").alias("cost"))


@CATALOG.query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error'")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
