"""Queries over findings as facts, source-derived titles, transcripts, catalogs, item records, dispatch and the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.functions import providers, text
from quarrylane.operators import chunking, evidence, facts, merge, ordering, render, research, scopes
from quarrylane.plans import views
from quarrylane.plans.views import FACTS_SQL
from quarrylane.session import scratch, table
from quarrylane.sources import markup
from quarrylane.streaming import progress

CATALOG = Catalog()

_FINDINGS_SQL = r"""f AS (SELECT o_orderkey AS finding_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'Investor Slides: ' WHEN 1 THEN '' ELSE 'x1: ' END || CASE WHEN o_orderkey % 11 = 0 THEN 'no period' ELSE 'BANK ' || o_custkey % 9 || ' Q' || (o_orderkey % 4 + 1) || ' ' || year(o_orderdate) END AS combo_label,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ' Revenue ' END AS metric_name,
    CASE o_orderkey % 4 WHEN 0 THEN '$' || o_custkey || ',500.5' WHEN 1 THEN '(' || o_custkey || ')' WHEN 2 THEN 'about -' || o_custkey ELSE CASE WHEN o_custkey % 2 = 0 THEN 'n/a' ELSE o_custkey || '%' END END AS metric_value,
    CASE WHEN o_orderkey % 5 = 0 THEN 'FY' || year(o_orderdate) ELSE ' ' END AS period,
    CASE o_orderkey % 6 WHEN 0 THEN [] WHEN 1 THEN [''] ELSE ['E' || o_orderkey, ''] END AS ev FROM orders),
g AS (SELECT *, regexp_replace(trim(combo_label), '^[A-Za-z][A-Za-z 0-9&-]*:\s+', '') AS label, regexp_replace(regexp_extract(replace(trim(metric_value), '$', ''), '-?\d[\d,]*(?:\.\d+)?', 0), ',', '', 'g') AS num FROM f)"""


@CATALOG.query(
    "finding_facts",
    rf"""WITH {_FINDINGS_SQL}, h AS (SELECT *, regexp_extract(label, '^(.+?)\s+(Q[1-4])\s+(\d{{4}})$', 1) AS bank, regexp_extract(label, '^(.+?)\s+(Q[1-4])\s+(\d{{4}})$', 2) AS quarter,
      regexp_extract(label, '^(.+?)\s+(Q[1-4])\s+(\d{{4}})$', 3) AS y, TRY_CAST(num AS DOUBLE) AS n, [e FOR e IN ev IF e <> ''] AS real_ev FROM g)
    SELECT finding_id, bank, CASE WHEN trim(period) = '' THEN quarter || ' ' || y ELSE trim(period) END AS period, CAST(y AS INTEGER) AS year, quarter, trim(metric_name) AS metric,
      CASE WHEN starts_with(metric_value, '(') AND ends_with(metric_value, ')') THEN -n ELSE n END AS value, array_to_string(real_ev, ',') AS evidence
    FROM h WHERE bank <> '' AND trim(metric_name) <> '' AND n IS NOT NULL AND len(real_ev) > 0""",
)
def finding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, y = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")
    text = F.lit
    period_label = F.concat(text("BANK "), (F.col("o_custkey") % 9).cast("string"), text(" Q"), (k % 4 + 1).cast("string"), text(" "), y)
    odd = F.when(F.col("o_custkey") % 2 == 0, "n/a").otherwise(F.concat(c, text("%")))
    findings = table(spark, sf_dir, "orders").select(
        k.alias("finding_id"),
        F.concat(F.when(k % 3 == 0, "Investor Slides: ").when(k % 3 == 1, "").otherwise("x1: "), F.when(k % 11 == 0, "no period").otherwise(period_label)).alias("combo_label"),
        F.when(k % 13 == 0, "").otherwise(" Revenue ").alias("metric_name"),
        F.when(k % 4 == 0, F.concat(text("$"), c, text(",500.5"))).when(k % 4 == 1, F.concat(text("("), c, text(")"))).when(k % 4 == 2, F.concat(text("about -"), c)).otherwise(odd).alias("metric_value"),
        text("USD").alias("unit"),
        F.when(k % 5 == 0, F.concat(text("FY"), y)).otherwise(" ").alias("period"),
        text(None).cast("string").alias("segment"),
        F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, F.array(text(""))).otherwise(F.array(F.concat(text("E"), k.cast("string")), text(""))).alias("evidence_ids"),
    )
    found = facts.from_findings(findings)
    return found.select("finding_id", "bank", "period", "year", "quarter", "metric", "value", F.array_join("evidence_ids", ",").alias("evidence"))


_ASKED = "Compare the banks by their share of revenue"


@CATALOG.query(
    "intent_scores",
    f"""WITH {FACTS_SQL}, f AS (SELECT * FROM facts WHERE segment NOT IN ('1-URGENT', '2-HIGH') OR year = 1996 AND (quarter = 1 OR quarter = 2 AND segment = '2-HIGH')),
    g AS (SELECT segment, bank AS part, 'bank' AS by_what, bank, year, quarter FROM f UNION ALL SELECT segment, '', 'all', bank, year, quarter FROM f),
    n AS (SELECT segment, part, count(*) AS n, count(DISTINCT bank) AS banks, count(DISTINCT year * 4 + quarter) AS periods FROM g GROUP BY segment, part HAVING count(*) >= 2),
    s(need, least, most, chart, adjust) AS (VALUES ('peer', 1, 1, 'peer_rank_bar', 0), ('one', 2, 99999, 'trend_line', 0), ('one', 2, 99999, 'trend_bar', -12), ('one', 2, 2, 'delta_bar', 0), ('peer', 2, 2, 'slopegraph', 0), ('peer', 2, 2, 'delta_bar', -6),
      ('peer', 3, 99999, 'multi_series_line', 0), ('peer', 2, 99999, 'heatmap', NULL)),
    b(chart, base) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in facts.BASE_SCORES.items())})
    SELECT segment || part AS metric_key, chart, CAST(base + least(12, n) + least(8, n) + CASE WHEN banks >= 2 THEN 4 ELSE 0 END + CASE WHEN periods >= 3 THEN 5 ELSE 0 END
      + CASE WHEN chart IN ('peer_rank_bar', 'slopegraph', 'heatmap', 'composition_stacked_bar', 'composition_100_bar') THEN 10 ELSE 0 END + coalesce(adjust, CASE WHEN banks * periods >= 12 THEN 12 ELSE -8 END) AS BIGINT) AS score
    FROM n JOIN s ON need = CASE WHEN banks >= 2 THEN 'peer' ELSE 'one' END AND periods BETWEEN s.least AND s.most JOIN b USING (chart)""",
)
def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of all groups of facts, of banks together and each alone, scored with the boost of a question's intent."""
    kept = views.facts(spark, sf_dir).where("segment not in ('1-URGENT', '2-HIGH') or year = 1996 and (quarter = 1 or quarter = 2 and segment = '2-HIGH')")
    either = kept.withColumn("metric_key", F.explode(F.array("segment", F.concat("segment", "bank")))).withColumn("unit", F.lit("USD"))
    return facts.scored_shapes(facts.groups(either), keep=None, question=_ASKED).select("metric_key", "chart", "score")


_SHELLED = f"CASE doc_id % 3 WHEN 0 THEN chr(10) || ' {progress.SHELL_OPEN} {{\"id\": ' || doc_id || '}} {progress.SHELL_CLOSE}' || text WHEN 1 THEN '{progress.SHELL_OPEN}' || text ELSE text END"
_START = r"regexp_replace(t, '^\s+', '')"


@CATALOG.query(
    "leading_blocks",
    f"""WITH s AS (SELECT doc_id, {_SHELLED} AS t FROM documents), w AS (SELECT *, doc_id % 3 = 0 AS whole, {_START} AS st FROM s)
    SELECT doc_id, CASE WHEN whole THEN '{{"id": ' || doc_id || '}}' END AS shell, CASE WHEN whole THEN split_part(st, '{progress.SHELL_CLOSE}', 2) ELSE t END AS body FROM w""",
)
def leading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id"), F.col("text")
    head = F.concat(F.lit(f'\n {progress.SHELL_OPEN} {{"id": '), k.cast("string"), F.lit(f"}} {progress.SHELL_CLOSE}"))
    shown = F.when(k % 3 == 0, F.concat(head, text)).when(k % 3 == 1, F.concat(F.lit(progress.SHELL_OPEN), text)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", progress.leading_block(shown).alias("b")).select("doc_id", "b.shell", "b.body")


@CATALOG.query("catalog_filter", "SELECT n_nationkey, n_name FROM nation WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (3, 7)) UNION ALL SELECT r_regionkey, r_name FROM region")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by a list of ids, one of them unknown, and all entries where the list is empty."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = [r.n_name for r in nation.where("n_nationkey in (3, 7)").select("n_name").collect()]
    return scopes.catalog_filter(nation, [*names, "no such entry"], "n_name").select("n_nationkey", "n_name").union(scopes.catalog_filter(region, [], "r_name"))


@CATALOG.query(
    "item_records",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN coalesce(p.p_size, 0)::BIGINT END AS markdown_chars, CASE WHEN c_custkey % 2 = 1 THEN coalesce(n.n_regionkey, 0)::BIGINT END AS row_count,
      CASE WHEN c_custkey % 2 = 1 THEN coalesce(n.n_name, '') END AS used_range
    FROM customer LEFT JOIN part p ON c_custkey % 2 = 0 AND c_custkey = p.p_partkey AND p.p_partkey % 3 > 0 LEFT JOIN nation n ON c_custkey % 2 = 1 AND c_custkey = n.n_nationkey""",
)
def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, one = F.col("c_custkey"), F.lit("f").alias("file_id")
    chunks = table(spark, sf_dir, "customer").select("c_custkey", one, F.when(k % 2 == 0, "page").otherwise("sheet").alias("item_type"), k.alias("item_number"))
    pages = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(one, F.col("p_partkey").alias("page_number"), F.col("p_size").alias("markdown_chars"))
    sheets = table(spark, sf_dir, "nation").select(one, F.col("n_nationkey").alias("sheet_number"), F.col("n_regionkey").alias("row_count"), F.col("n_name").alias("used_range"))
    return chunking.item_records(chunks, pages, sheets, "file_id").select("c_custkey", "markdown_chars", "row_count", "used_range")


@CATALOG.query(
    "source_titles",
    """WITH d AS (SELECT doc_id, source AS bank, CASE WHEN doc_id % 7 = 0 THEN 'later' ELSE '2024_q' || (doc_id % 4 + 1) END AS period, CASE doc_id % 3 WHEN 0 THEN 'Investor Slides' WHEN 1 THEN 'financial_supp' ELSE 'pillar3' END AS src,
      CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' ELSE 'txt' END AS ft, n_chars % 3 AS items FROM documents),
    t AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '' ELSE upper(bank) || ' 2024 Q' || (doc_id % 4 + 1) || CASE doc_id % 3 WHEN 0 THEN ' Investor Slides' WHEN 1 THEN ' Financial Supplement' ELSE ' Pillar3' END END AS title FROM d)
    SELECT doc_id, title, CASE WHEN ft = 'xlsx' THEN 'sheet_based' WHEN doc_id % 3 = 0 THEN 'slide_deck' WHEN doc_id % 2 = 0 THEN 'chapters' ELSE 'semantic' END AS structure_type,
      CASE WHEN title = '' THEN bank || '.' || ft ELSE title END || ' contains ' || items || ' ' || CASE ft WHEN 'pdf' THEN 'page' WHEN 'xlsx' THEN 'sheet' ELSE 'item' END || CASE WHEN items = 1 THEN '' ELSE 's' END || ' prepared for retrieval.' AS summary FROM t""",
)
def source_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, bank = F.col("doc_id"), F.col("source")
    period = F.when(k % 7 == 0, "later").otherwise(F.concat(F.lit("2024_q"), (k % 4 + 1).cast("string")))
    source = F.when(k % 3 == 0, "Investor Slides").when(k % 3 == 1, "financial_supp").otherwise("pillar3")
    kind = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "xlsx").otherwise("txt")
    title = render.source_title(bank, period, source)
    proposed = F.when(k % 2 == 0, "chapters").otherwise("unheard of")
    summary = render.fallback_summary(title, F.concat(bank, F.lit("."), kind), kind, F.col("n_chars") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), render.structure_type(kind, source, proposed).alias("structure_type"), summary.alias("summary"))


_SECTION = "CASE turn % 3 WHEN 0 THEN 'Management  Discussion' WHEN 1 THEN 'Questions and answers' ELSE '' END"


@CATALOG.query(
    "transcript_turns",
    f"""WITH t AS (SELECT *, {_SECTION} AS s FROM conversations), n AS (SELECT *, CASE WHEN contains(lower(s), 'management') THEN 'MANAGEMENT DISCUSSION SECTION' WHEN contains(lower(s), 'question') THEN 'Q&A' ELSE 'Transcript' END AS section FROM t)
    SELECT conv_id, turn, section, CASE WHEN turn % 4 = 0 THEN 'Question' WHEN turn % 4 = 1 THEN 'Answer' WHEN role = 'user' THEN 'Question' WHEN role = 'assistant' THEN 'Answer' ELSE 'Speaker' END AS spoken_as,
      trim('# Management Discussion: ' || role || chr(10) || chr(10) || 'Section: ' || section || chr(10) || chr(10) || 'Speaker: ' || role || chr(10) || chr(10) || 'Speaker block ID: ' || turn || chr(10) || chr(10) || chr(10) || chr(10) || text) AS markdown FROM n""",
)
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    section = render.section_name(F.when(turn % 3 == 0, "Management  Discussion").when(turn % 3 == 1, "Questions and answers").otherwise(""))
    kind = F.when(role == "user", "Analyst").when(role == "assistant", "Executive").otherwise("other")
    spoken = render.turn_role(F.when(turn % 4 == 0, "q").when(turn % 4 == 1, "a"), kind)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", section.alias("section"), spoken.alias("spoken_as"), render.block_markdown(role, section, turn, F.col("text")).alias("markdown"))


@CATALOG.query(
    "transcript_companies",
    """WITH p AS (SELECT o_custkey, o_orderkey, o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%URGENT%' AS own, trim(CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END) AS company FROM orders),
    w AS (SELECT * FROM p WHERE own OR NOT (SELECT bool_or(own) FROM p q WHERE q.o_custkey = p.o_custkey)),
    f AS (SELECT o_custkey, lower(company) AS low, min(o_orderkey) AS k, arg_min(company, o_orderkey) AS company FROM w GROUP BY ALL)
    SELECT o_custkey, string_agg(company, '|' ORDER BY k) AS companies FROM f GROUP BY o_custkey""",
)
def transcript_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.when(p.contains("HIGH") | p.contains("URGENT"), "Executive").otherwise("Analyst").alias("participant_type"), F.when(F.col("o_orderkey") % 2 == 0, F.upper(p)).otherwise(F.lower(p)).alias("affiliation")
    )
    return render.companies(rows, "o_custkey", "o_orderkey").withColumn("companies", F.array_join("companies", "|"))


@CATALOG.query("source_dispatch", "SELECT 'documents' AS source, 'success' AS status, count(*) AS n FROM documents UNION ALL SELECT 'none', 'no_available_data', 0 UNION ALL SELECT 'missing', 'error', 0 UNION ALL SELECT 'broken', 'error', 0 UNION ALL SELECT 'labels', 'success', count(*) FROM labels")
def source_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources at once; one has no table, one fails while it runs, and the others' rows come all the same."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    rows, status = research.dispatch(
        {
            "documents": lambda: docs,
            "none": lambda: docs.where("key < 0"),
            "missing": lambda: spark.table(f"no_such_table_{uuid.uuid4().hex}"),
            "broken": lambda: docs.select(F.raise_error(F.lit("this source is broken")).cast("long").alias("key")),
            "labels": lambda: table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")),
        }
    )
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    named = spark.createDataFrame([(s, t) for s, t, _ in status], "source string, status string")
    return named.join(counts, "source", "left").na.fill(0, ["n"])


@CATALOG.query("keyed_summaries", "SELECT item_id, length(text) AS size FROM benchmark WHERE trim(text) <> ''")
def keyed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that loses an id in every batch of more than three: batches are halved until ids agree."""

    def forgetful(texts: dict[int, str]) -> dict[int, int]:
        found = {k: len(t) for k, t in texts.items()}
        if len(found) > 3:
            found.popitem()
        return found

    return providers.apply_keyed(table(spark, sf_dir, "benchmark"), "item_id", "text", forgetful, "long", name="size")


@CATALOG.query(
    "used_ranges",
    """SELECT s_nationkey, chr((64 + min(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END))::INTEGER) || min(s_suppkey) || ':' || chr((64 + max(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END))::INTEGER) || max(s_suppkey) AS used_range,
      max(s_suppkey) - min(s_suppkey) + 1 AS n_rows, CAST(max(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END) - min(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END) + 1 AS INTEGER) AS n_cols FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY s_nationkey""",
)
def used_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cells = table(spark, sf_dir, "supplier").select("s_nationkey", k.alias("row"), F.when(k % 2 == 0, 1).otherwise(3).alias("col"), F.when(k % 5 > 0, F.col("s_name")).alias("text"))
    return markup.used_range(cells, ["s_nationkey"])


@CATALOG.query("event_log", "SELECT event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY event_type")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events appended to a log in two parts and read back as a stream; the last state is written to the shared folder."""
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    progress.append_events(events.where("event_id % 2 = 0"), f"{path}/log")
    progress.append_events(events.where("event_id % 2 = 1"), f"{path}/log")
    counted = progress.watch(spark, f"{path}/log", "event_id long, ts timestamp_ntz, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    query = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/table"))
    query.start().awaitTermination()
    return spark.read.parquet(f"{path}/table")


@CATALOG.query(
    "cumulative_findings",
    """WITH r AS (SELECT 0 AS round, o_orderkey AS pos, o_custkey AS finding FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1),
    f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY finding ORDER BY round, pos) = 1)
    SELECT pos, finding, 'E' || row_number() OVER (ORDER BY round, pos) AS id FROM f""",
)
def cumulative_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("finding"))
    return evidence.cumulative([orders.where("pos % 2 = 0"), orders.where("pos % 2 = 1")], ["finding"], "pos")


@CATALOG.query("vector_validate", "SELECT vec_id, len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AS is_valid FROM embeddings")
def vector_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", merge.finite_vector(F.col("embedding"), 64).alias("is_valid"))


@CATALOG.query(
    "period_sort",
    """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'undated' ELSE 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END AS label, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE year(o_orderdate) * 4 + quarter(o_orderdate) END AS k FROM orders WHERE year(o_orderdate) >= 2000
      UNION ALL SELECT o_orderkey, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate), -1 FROM orders WHERE year(o_orderdate) < 2000)
    SELECT o_orderkey, label, row_number() OVER (ORDER BY k, o_orderkey) AS place FROM l""",
)
def period_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of periods in order; those that can't be read, as of another century, come first."""
    d = F.col("o_orderdate")
    label = F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.year(d).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when((F.col("o_orderkey") % 10 == 0) & (F.year(d) >= 2000), "undated").otherwise(label).alias("label"))
    return ordering.numbered_globally(rows.withColumn("k", text.period_key(F.col("label"))), ["k", "o_orderkey"], "place").drop("k")


@CATALOG.query("insert_rows", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100 + n_nationkey, NULL FROM nation")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.inserted(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").select((100 + F.col("n_nationkey")).cast("int").alias("r_regionkey")))
