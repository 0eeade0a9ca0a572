"""Ingestion queries: chunk accounting, budgets, manifests, merges, integrity, availability, unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.functions import text
from quarrylane.operators import chunking, merge, ordering, scans
from quarrylane.plans.views import CHUNKS_SQL, chunks
from quarrylane.session import table

CATALOG = Catalog()

#: Token accounting with a deterministic tokenizer: runs of word characters, and other characters that are no white space.
TOKENS_SQL = f"""{CHUNKS_SQL}, tok AS (
  SELECT doc_id, file_id, bank, page, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_ \\t\\n\\r\\f\\x0B]')) AS BIGINT) AS n_tokens FROM chunks),
acc AS (SELECT *, least(n_tokens, 800) AS embedding_tokens, greatest(0, n_tokens - 800) AS omitted_tokens,
  CASE WHEN n_tokens <= 200 THEN 'low' WHEN n_tokens <= 600 THEN 'medium' ELSE 'high' END AS tier FROM tok)"""


def accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir, n_tokens=chunking.token_count(F.col("text"))).select("doc_id", "file_id", "bank", "page", "n_tokens")
    return chunking.accounted(rows, limit=800, tiers=(200, 600))


@CATALOG.query("chunk_token_tiers", f"WITH {TOKENS_SQL} SELECT doc_id, n_tokens, embedding_tokens, omitted_tokens, tier FROM acc")
def chunk_token_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounted(spark, sf_dir).select("doc_id", "n_tokens", "embedding_tokens", "omitted_tokens", "tier")


@CATALOG.query(
    "token_summary",
    f"""WITH {TOKENS_SQL} SELECT file_id, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS total_tokens, max(n_tokens) AS max_tokens, CAST(sum(omitted_tokens) AS BIGINT) AS omitted_tokens,
      count(*) FILTER (tier = 'low') AS low, count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'high') AS high FROM acc GROUP BY file_id""",
)
def token_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.token_summary(accounted(spark, sf_dir), "file_id")


@CATALOG.query("layout_summary", f"WITH {TOKENS_SQL} SELECT tier, count(*) AS n FROM acc GROUP BY tier")
def layout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounted(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


_QA_SQL = f"""{TOKENS_SQL}, qa AS (
  SELECT file_id, doc_id, 'embedding_truncated' AS rule, 'low' AS severity FROM acc WHERE omitted_tokens > 0
  UNION ALL SELECT file_id, doc_id, 'empty_chunk', 'high' FROM acc WHERE n_tokens < 15
  UNION ALL SELECT file_id, doc_id, 'oversized_content', 'medium' FROM acc WHERE n_tokens > 1600)"""


@CATALOG.query("chunk_qa_findings", f"WITH {_QA_SQL} SELECT doc_id, rule, severity FROM qa")
def chunk_qa_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.qa_findings(accounted(spark, sf_dir)).select("doc_id", "rule", "severity")


@CATALOG.query(
    "qa_rollup",
    f"""WITH {_QA_SQL} SELECT a.file_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
      CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'failed' WHEN count(qa.file_id) > 0 THEN 'warning' ELSE 'passed' END AS status,
      CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'failed' ELSE 'passed' END AS stage_status
      FROM (SELECT DISTINCT file_id FROM acc) a LEFT JOIN qa USING (file_id) GROUP BY a.file_id""",
)
def qa_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accounted(spark, sf_dir)
    return chunking.qa_rollup(rows.select("file_id").distinct(), chunking.qa_findings(rows), "file_id")


@CATALOG.query(
    "greedy_batches",
    f"""WITH RECURSIVE {TOKENS_SQL}, o AS (SELECT file_id, page, n_tokens FROM acc),
    r AS (SELECT file_id, page, n_tokens, CAST(0 AS INTEGER) AS batch, n_tokens AS s FROM o WHERE page = 1
      UNION ALL SELECT o.file_id, o.page, o.n_tokens, CASE WHEN r.s > 0 AND r.s + o.n_tokens > 1500 THEN r.batch + 1 ELSE r.batch END,
        CASE WHEN r.s > 0 AND r.s + o.n_tokens > 1500 THEN o.n_tokens ELSE r.s + o.n_tokens END FROM r JOIN o ON o.file_id = r.file_id AND o.page = r.page + 1)
    SELECT file_id, page, n_tokens, batch FROM r""",
)
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.batched(accounted(spark, sf_dir).select("file_id", "page", "n_tokens"), "file_id", "page", "n_tokens", 1500)


@CATALOG.query(
    "prefix_budget",
    f"""WITH {TOKENS_SQL} SELECT doc_id, file_id, page FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY file_id ORDER BY page) AS s FROM acc) WHERE s <= 2000 OR page = 1""",
)
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.within_budget(accounted(spark, sf_dir).select("doc_id", "file_id", "page", "n_tokens"), ["file_id"], ["page"], "n_tokens", 2000).select("doc_id", "file_id", "page")


@CATALOG.query("embedding_plan", f"WITH {TOKENS_SQL} SELECT bank, count(*) FILTER (n_tokens > 0) AS n_texts, CAST(ceil(count(*) FILTER (n_tokens > 0) / 100.0) AS BIGINT) AS batches FROM acc GROUP BY bank")
def embedding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.embedding_plan(accounted(spark, sf_dir), "bank", "n_tokens", 100)


@CATALOG.query(
    "embedding_families",
    """WITH u AS (SELECT source AS bank, text, regexp_extract_all(lower(text), '[a-z]{9,}') AS words FROM documents),
    n AS (SELECT bank, unnest(['content', 'keyword', 'metric']) AS family, unnest([CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END, len(words), len([w FOR w IN words IF length(w) >= 12])]) AS n FROM u)
    SELECT bank, family, CAST(sum(n) AS BIGINT) AS n_texts, CAST(ceil(sum(n) / 100.0) AS BIGINT) AS batches FROM n GROUP BY bank, family""",
)
def embedding_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each family that a bank's chunks have to embed."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))
    families = {"content": F.array("text"), "keyword": words, "metric": F.filter(words, lambda w: F.length(w) >= 12)}
    return chunking.embedding_families(table(spark, sf_dir, "documents").withColumnRenamed("source", "bank"), ["bank"], families, 100)


@CATALOG.query(
    "section_references",
    """SELECT vec_id, member FROM (SELECT vec_id, unnest([vec_id // 4, vec_id // 4 + 1, vec_id * 3, vec_id // 4]) AS member FROM embeddings WHERE vec_id % 4 = 3)
    WHERE member NOT IN (SELECT doc_id FROM documents) GROUP BY vec_id, member""",
)
def section_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of sections that are no chunk."""
    unit = F.floor(F.col("vec_id") / 4)
    sections = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 3").select("vec_id", F.array(unit, unit + 1, F.col("vec_id") * 3, unit).alias("content_unit_ids"))
    return merge.list_orphans(sections, "vec_id", "content_unit_ids", table(spark, sf_dir, "documents"), "doc_id")


@CATALOG.query(
    "workbook_findings",
    """SELECT book, sheet, 'formula_cache_missing' AS code, 'medium' AS severity, count(*) AS n FROM (SELECT s_suppkey % 5 AS book, s_nationkey AS sheet, s_suppkey AS k FROM supplier) WHERE k % 2 = 0 AND k % 7 = 0 GROUP BY book, sheet
    UNION ALL SELECT DISTINCT s_suppkey % 5, s_nationkey, 'system_sheet_emitted', 'high', CAST(1 AS BIGINT) FROM supplier WHERE s_nationkey % 6 = 0""",
)
def workbook_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the sheets of workbooks: suppliers as cells, nations as sheets, some of them system sheets."""
    k = F.col("s_suppkey")
    cells = table(spark, sf_dir, "supplier").select((k % 5).alias("book"), F.col("s_nationkey").alias("sheet"), F.when(k % 2 == 0, "A1+1").alias("formula"), F.when(k % 7 != 0, F.col("s_name")).alias("value"))
    title = F.when(F.col("sheet") % 6 == 0, " Variables").otherwise(F.concat(F.lit("Sheet "), F.col("sheet").cast("string")))
    return chunking.workbook_findings(cells, cells.select("book", "sheet").distinct().withColumn("title", title), ["book", "sheet"], "title")


@CATALOG.query("fixed_chunks", f"WITH {CHUNKS_SQL} SELECT doc_id, file_id, CAST((page - 1) // 7 AS BIGINT) AS chunk FROM chunks")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.chunked(chunks(spark, sf_dir).select("doc_id", "file_id", "page"), ["file_id"], ["page"], 7).select("doc_id", "file_id", "chunk")


_INCOMING = "incoming AS (SELECT 'f' || doc_id AS file_id, md5(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS hash FROM documents WHERE doc_id % 5 <> 0)"
_MASTER = "master AS (SELECT 'f' || doc_id AS file_id, md5(text) AS hash, source FROM documents WHERE doc_id % 3 <> 0)"


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    fid = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id")
    incoming = d.where("doc_id % 5 <> 0").select(fid, F.md5(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))).alias("hash"))
    return incoming, d.where("doc_id % 3 <> 0").select(fid, F.md5("text").alias("hash"), "source")


_DIFF_SQL = f"""{_INCOMING}, {_MASTER}, old AS (SELECT * FROM master),
diff AS (SELECT coalesce(i.file_id, m.file_id) AS file_id, m.file_id IS NULL OR (i.file_id IS NOT NULL AND i.hash <> m.hash) AS process,
  CASE WHEN i.file_id IS NULL THEN 'removed' WHEN m.file_id IS NOT NULL AND i.hash <> m.hash THEN 'modified' END AS remove_reason
  FROM incoming i FULL OUTER JOIN old m ON i.file_id = m.file_id)"""


@CATALOG.query("manifest_diff", f"WITH {_DIFF_SQL} SELECT * FROM diff")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, master = _manifests(spark, sf_dir)
    return merge.manifest_diff(incoming, master, "file_id", "hash")


@CATALOG.query(
    "master_merge",
    f"""WITH {_DIFF_SQL} SELECT file_id, hash, 'old' AS origin FROM master WHERE file_id NOT IN (SELECT file_id FROM diff WHERE process OR remove_reason IS NOT NULL)
      UNION ALL SELECT file_id, hash, 'new' FROM incoming WHERE file_id IN (SELECT file_id FROM diff WHERE process)""",
)
def master_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, master = _manifests(spark, sf_dir)
    diff = merge.manifest_diff(incoming, master, "file_id", "hash")
    fresh = incoming.join(diff.where("process"), "file_id", "left_semi").withColumn("origin", F.lit("new"))
    old = master.select("file_id", "hash", F.lit("old").alias("origin"))
    return merge.master_merge(old, fresh, "file_id", diff.where("remove_reason is not null"))


@CATALOG.query("referential_integrity", "SELECT 'label' AS side, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) UNION ALL SELECT 'vector', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, emb = (table(spark, sf_dir, t) for t in ("documents", "labels", "embeddings"))
    a = merge.orphans(labels, docs.where("doc_id % 4 <> 0"), ["doc_id"]).select(F.lit("label").alias("side"), F.col("doc_id").alias("id"))
    b = merge.orphans(emb.withColumnRenamed("vec_id", "doc_id"), docs, ["doc_id"]).select(F.lit("vector").alias("side"), F.col("doc_id").alias("id"))
    return a.unionByName(b)


@CATALOG.query(
    "snapshot_validate",
    """SELECT event_id, array_to_string(list_sort([x FOR x IN [CASE WHEN NOT coalesce(value BETWEEN 0 AND 90, false) THEN 'value' END, CASE WHEN NOT coalesce(event_type IN ('click', 'view', 'signup', 'purchase'), false) THEN 'event_type' END,
      CASE WHEN NOT coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 10, false) THEN 'props_k' END] IF x IS NOT NULL]), ',') AS errors
      FROM events WHERE NOT (coalesce(value BETWEEN 0 AND 90, false) AND coalesce(event_type IN ('click', 'view', 'signup', 'purchase'), false) AND coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 10, false))""",
)
def snapshot_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {
        "value": F.col("value").between(0, 90),
        "event_type": F.col("event_type").isin("click", "view", "signup", "purchase"),
        "props_k": F.get_json_object("props", "$.k").try_cast("long") >= 10,
    }
    rows = table(spark, sf_dir, "events").withColumn("e", merge.validation_errors(checks))
    return rows.where(F.size("e") > 0).select("event_id", F.array_join("e", ",").alias("errors"))


_VERSION = "CASE l_linenumber % 7 WHEN 0 THEN 'raw' WHEN 1 THEN 'script' WHEN 2 THEN 'final' WHEN 3 THEN 'e1' WHEN 4 THEN 'draft' WHEN 5 THEN 'raw' ELSE 'corrected' END"


@CATALOG.query(
    "version_argmax",
    f"""SELECT l_orderkey, l_linenumber, version FROM (SELECT l_orderkey, l_linenumber, {_VERSION} AS version, row_number() OVER (PARTITION BY l_orderkey ORDER BY
      CASE {_VERSION} WHEN 'corrected' THEN 50 WHEN 'e1' THEN 45 WHEN 'final' THEN 40 WHEN 'script' THEN 30 WHEN 'raw' THEN 20 ELSE 0 END DESC, l_quantity DESC, l_shipdate DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1""",
)
def version_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the label's priority, then version (quantity), time (ship date) and name (line number)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", F.expr(_VERSION).alias("version"))
    return ordering.best_version(rows, ["l_orderkey"], "version", merge.VERSION_PRIORITY, "l_quantity", "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", "version")


@CATALOG.query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@CATALOG.query(
    "one_file_rule",
    """SELECT 2000 + l_linenumber AS year, 'Q' || (l_orderkey % 4 + 1) AS quarter, 'b' || l_orderkey AS bank, count(*) AS n,
      CASE WHEN count(*) > 1 THEN 'more than one file' ELSE 'wrong kind of file' END AS problem
      FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR count(*) FILTER (l_returnflag = 'A') = 0""",
)
def one_file_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for files: a bank for each order, a period for each line number, a kind for each return flag."""
    from quarrylane.sources import files

    kind = F.when(F.col("l_returnflag") == "A", ".PDF").otherwise(".xlsx")
    rows = table(spark, sf_dir, "lineitem").select(
        (2000 + F.col("l_linenumber")).alias("year"),
        F.concat(F.lit("Q"), (F.col("l_orderkey") % 4 + 1).cast("string")).alias("quarter"),
        F.concat(F.lit("b"), F.col("l_orderkey").cast("string")).alias("bank"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), kind).alias("filename"),
        F.lit(None).cast("string").alias("error"),
    )
    return files.one_file_per_bank(rows, "pdf")


@CATALOG.query("alias_projection", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), '') AS source_type FROM documents")
def alias_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("lang"))
    b = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_present(a, b, F.lit("")).alias("source_type"))


@CATALOG.query("latest_row", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@CATALOG.query("groupwise_max", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_quantity = m")
def groupwise_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.groupwise_max(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity")


_AVAIL = "avail AS (SELECT source AS bank, list_sort(list_distinct(list(lang))) AS names FROM documents GROUP BY source)"


@CATALOG.query("availability_rollup", f"WITH {_AVAIL} SELECT bank, array_to_string(names, ',') AS database_names FROM avail")
def availability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.availability(chunks(spark, sf_dir, pages=False), ["bank"], "source_type")
    return rows.select("bank", F.array_join("database_names", ",").alias("database_names"))


@CATALOG.query("availability_lookup", f"WITH {_AVAIL}, combos AS (SELECT 'src' || o_orderkey % 30 AS bank, CASE o_orderkey % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'fr' ELSE 'xx' END AS source_type, o_orderkey FROM orders) SELECT o_orderkey, coalesce(list_contains(names, source_type), false) AS available FROM combos LEFT JOIN avail USING (bank)")
def availability_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    combos = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("src"), (F.col("o_orderkey") % 30).cast("string")).alias("bank"), F.expr("case o_orderkey % 3 when 0 then 'es' when 1 then 'fr' else 'xx' end").alias("source_type")
    )
    return merge.availability_lookup(combos, merge.availability(chunks(spark, sf_dir, pages=False), ["bank"], "source_type"), ["bank"], "source_type").select("o_orderkey", "available")


_OFFERS = """nat AS (SELECT n_nationkey, n_name, r_name, upper(substr(n_name, 1, 3)) AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey),
off AS (
  SELECT year(o_orderdate) AS fiscal_year, 'Q' || quarter(o_orderdate) AS quarter, n_nationkey AS bank_id, n_name AS bank_name, symbol AS bank_symbol,
         [lower(CAST(n_nationkey AS VARCHAR)), lower(n_name), lower(symbol), lower(n_name) || ' bank', lower(r_name)] AS names, list_distinct(list(lower(trim(o_orderpriority)))) AS sources
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey GROUP BY ALL),
ask AS (
  SELECT o_orderkey, year(o_orderdate) AS fiscal_year, 'Q' || quarter(o_orderdate) AS quarter, lower(CASE WHEN o_orderkey % 7 = 0 THEN 'elsewhere' ELSE o_orderpriority END) AS source,
         CASE o_orderkey % 5 WHEN 0 THEN [CAST(n_nationkey AS VARCHAR)] WHEN 1 THEN [lower(symbol)] WHEN 2 THEN [lower(n_name) || ' bank'] WHEN 3 THEN [lower(r_name), lower(n_name)] ELSE [] END AS wanted
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey)"""


@CATALOG.query(
    "availability_by_overlap",
    f"""WITH {_OFFERS}, hit AS (
      SELECT o_orderkey, bank_id, bank_name, bank_symbol FROM ask JOIN off ON ask.fiscal_year = off.fiscal_year AND ask.quarter = off.quarter AND list_contains(sources, ask.source) AND list_has_any(names, wanted)
      QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY bank_id) = 1)
    SELECT o_orderkey, fiscal_year, quarter, bank_id, bank_name, bank_symbol, bank_id IS NOT NULL AS available FROM ask LEFT JOIN hit USING (o_orderkey)""",
)
def availability_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's bank, by id, symbol, alias, tag and name or by nothing, in the rows of banks, periods and what they offer."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    banks = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.upper(F.substring("n_name", 1, 3)).alias("symbol"))
    period = [F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter")]
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(banks, F.col("c_nationkey") == F.col("n_nationkey")).select("*", *period)
    offered = rows.groupBy("fiscal_year", "quarter", F.col("n_nationkey").alias("bank_id"), F.col("n_name").alias("bank_name"), F.col("symbol").alias("bank_symbol"), "r_name").agg(F.collect_set("o_orderpriority").alias("database_names"))
    k, none = F.col("o_orderkey") % 5, F.lit(None).cast("string")
    when = lambda n, c: F.when(k == n, c).otherwise(none)
    asked = rows.select(
        "o_orderkey", "fiscal_year", "quarter", F.when(F.col("o_orderkey") % 7 == 0, "elsewhere").otherwise(F.col("o_orderpriority")).alias("source"),
        when(0, F.col("n_nationkey").cast("string")).alias("id"), F.when(k == 1, F.col("symbol")).when(k == 3, F.col("r_name")).otherwise(none).alias("symbol"),
        F.when(k == 2, F.concat(F.initcap("n_name"), F.lit(" Bank"))).when(k == 3, F.col("n_name")).otherwise(F.lit(" ")).alias("name"),
    )
    aliases = F.array(F.concat(F.col("bank_name"), F.lit(" Bank")))
    return merge.availability_by_overlap(
        asked, offered, ["fiscal_year", "quarter"], merge.names_of(F.col("id"), F.col("symbol"), F.col("name")), merge.names_of(F.col("bank_id"), F.col("bank_name"), F.col("bank_symbol"), lists=(aliases, F.array("r_name"))),
        "source", "bank_id", ["bank_id", "bank_name", "bank_symbol"],
    ).select("o_orderkey", "fiscal_year", "quarter", "bank_id", "bank_name", "bank_symbol", "available")


@CATALOG.query(
    "upsert_union",
    """WITH a AS (SELECT source AS bank, list_sort(list_distinct(list(lang))) AS names, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source),
    b AS (SELECT source AS bank, list_sort(list_distinct(list(lang))) AS names, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY source)
    SELECT coalesce(b.bank, a.bank) AS bank, CASE WHEN b.bank IS NULL THEN a.n ELSE b.n END AS n, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.names, []), coalesce(b.names, [])))), ',') AS names FROM a FULL OUTER JOIN b ON a.bank = b.bank""",
)
def upsert_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir, pages=False)
    roll = lambda rows: rows.groupBy("bank").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source_type")).alias("names"))
    out = merge.upsert_union(roll(c.where("doc_id % 2 = 0")), roll(c.where("doc_id % 2 = 1")), ["bank"], "names")
    return out.withColumn("names", F.array_join("names", ","))


@CATALOG.query("update_or_insert", "SELECT c_custkey, 'new' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def update_or_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return merge.update_or_insert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])


@CATALOG.query("update_where", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT starts_with(c_name, 'Customer#00000001')")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.updated(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") + 1})
    return merge.deleted(rows, F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_acctbal")


_UNITS = "units AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{7,}') AS keywords, text FROM documents WHERE length(text) > 0)"


@CATALOG.query(
    "embedding_unpivot",
    f"""WITH {_UNITS} SELECT doc_id || '::content' AS embedding_id, doc_id, 'content' AS embedding_type, text AS term FROM units
    UNION ALL SELECT doc_id || '::keyword::' || lpad(CAST(u.i - 1 AS VARCHAR), greatest(3, length(CAST(u.i - 1 AS VARCHAR)))::INTEGER, '0') || '::' || substr(sha256(keywords[u.i]), 1, 12), doc_id, 'keyword', keywords[u.i] FROM units, unnest(range(1, len(keywords) + 1)) AS u(i)""",
)
def embedding_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))
    units = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", keywords.alias("keywords"))
    return chunking.unpivot(units, "doc_id", "text", {"keyword": "keywords"})


@CATALOG.query("section_rollup", f"WITH {TOKENS_SQL} SELECT file_id, section_id, n_units, section_tokens, members FROM (SELECT file_id, (page - 1) // 4 AS item, CAST(row_number() OVER (PARTITION BY file_id ORDER BY (page - 1) // 4) AS INTEGER) AS section_id, count(*) AS n_units, CAST(sum(n_tokens) AS BIGINT) AS section_tokens, string_agg(doc_id, ',' ORDER BY page) AS members FROM acc GROUP BY file_id, (page - 1) // 4)")
def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accounted(spark, sf_dir).withColumn("item", F.floor((F.col("page") - 1) / 4))
    return chunking.section_rollup(rows, "file_id", "item", "page", "doc_id", "n_tokens")


@CATALOG.query(
    "section_expand_knn",
    f"""WITH {CHUNKS_SQL}, s AS (SELECT file_id, (page - 1) // 4 AS item, min(doc_id) AS head, list(doc_id) AS members FROM chunks GROUP BY ALL),
    d AS (SELECT s.*, greatest(0, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))) AS dist FROM s JOIN embeddings ON head = vec_id),
    x AS (SELECT dist, unnest(members) AS doc_id FROM d)
    SELECT c.doc_id, c.file_id, round(dist, 6) AS distance FROM x JOIN chunks c USING (doc_id) ORDER BY dist, c.doc_id LIMIT 20""",
)
def section_expand_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit counts chunks, not sections: it comes after the sections are expanded."""
    from quarrylane.functions import vectors
    from quarrylane.plans.search import query_vector

    c = chunks(spark, sf_dir)
    sections = c.groupBy("file_id", F.floor((F.col("page") - 1) / 4).alias("item")).agg(F.min("doc_id").alias("head"), F.collect_list("doc_id").alias("members"))
    d = vectors.cosine_distance(F.col("embedding"), vectors.literal(query_vector(spark, sf_dir)))
    near = sections.join(table(spark, sf_dir, "embeddings"), F.col("head") == F.col("vec_id")).select(d.alias("d"), F.explode("members").alias("doc_id"))
    return near.join(c.select("doc_id", "file_id"), "doc_id").orderBy("d", "doc_id").limit(20).select("doc_id", "file_id", F.round("d", 6).alias("distance"))


@CATALOG.query("unit_section_lookup", f"WITH {CHUNKS_SQL}, s AS (SELECT file_id, min(page) AS page, 'section of ' || file_id AS title FROM chunks WHERE bank <> 'src1' GROUP BY file_id) SELECT c.doc_id, s.title FROM chunks c LEFT JOIN s ON c.file_id = s.file_id AND c.page = s.page")
def unit_section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    s = c.where("bank <> 'src1'").groupBy("file_id").agg(F.min("page").alias("page")).withColumn("title", F.concat(F.lit("section of "), "file_id"))
    return c.join(s, ["file_id", "page"], "left").select("doc_id", "title")


@CATALOG.query("document_order", f"WITH {CHUNKS_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY bank ORDER BY file_id, page) AS INTEGER) AS place FROM chunks")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir, n=F.lit(0)).select("doc_id", "bank", "file_id", "page")
    return scans.scan(rows, ["bank"], ["file_id", "page"], {"place": scans.row_count()}).select("doc_id", F.col("place").cast("int").alias("place"))


@CATALOG.query("call_period", r"SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(t, '(?i)\bQ([1-4])\s+(20\d{2})\s+Earnings\s+Call\b', 1), '') AS INTEGER) AS quarter, TRY_CAST(nullif(regexp_extract(t, '(?i)\bQ([1-4])\s+(20\d{2})\s+Earnings\s+Call\b', 2), '') AS INTEGER) AS year FROM (SELECT o_orderkey, 'Bank Q' || o_orderkey % 6 || ' 20' || 10 + o_orderkey % 20 || ' earnings call' AS t FROM orders)")
def call_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Bank Q"), (k % 6).cast("string"), F.lit(" 20"), (10 + k % 20).cast("string"), F.lit(" earnings call"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.call_period(title).alias("p")).select("o_orderkey", "p.quarter", "p.year")


@CATALOG.query("workbook_qa", "SELECT s_suppkey % 5 AS book, count(*) FILTER (s_suppkey % 2 = 0) AS formulas, count(*) FILTER (s_suppkey % 2 = 0 AND s_suppkey % 7 = 0) AS uncached, CASE WHEN count(*) FILTER (s_suppkey % 2 = 0 AND s_suppkey % 7 = 0) > 0 THEN 'medium' ELSE 'none' END AS severity FROM supplier GROUP BY 1")
def workbook_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cells = table(spark, sf_dir, "supplier").select((k % 5).alias("book"), F.when(k % 2 == 0, "A1+1").alias("formula"), F.when(k % 7 != 0, F.col("s_name")).alias("value"))
    return chunking.workbook_qa(cells, "book")


@CATALOG.query(
    "valid_findings",
    f"""WITH {CHUNKS_SQL} SELECT c.doc_id, trim(regexp_replace(c.text, '\\s+', ' ', 'g')) AS finding, k.page AS page, CAST(c.n_chars AS DOUBLE) AS metric_value
      FROM chunks c LEFT JOIN (SELECT DISTINCT file_id, page FROM chunks) k ON c.file_id = k.file_id AND c.page + 3 = k.page WHERE trim(c.text) <> ''""",
)
def valid_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylane.operators import evidence

    c = chunks(spark, sf_dir)
    found = c.select("doc_id", "file_id", F.col("text").alias("finding"), (F.col("page") + 3).alias("page"), F.concat(F.lit("$"), F.col("n_chars").cast("string")).alias("metric_value"))
    return evidence.valid_findings(found, c, ["file_id"]).select("doc_id", "finding", "page", "metric_value")
