"""Chunk accounting, QA rules, section rollup and the unpivot to long-form embedding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A deterministic stand-in for a provider's tokenizer; its counts are not those of any model.
TOKEN = r"[a-zA-Z0-9_]+|[^a-zA-Z0-9_ \t\n\r\f\x0B]"
EMBEDDING_LIMIT = 8_000
TIERS = (5_000, 10_000)


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")


def accounted(chunks: DataFrame, limit: int = EMBEDDING_LIMIT, tiers: tuple[int, int] = TIERS) -> DataFrame:
    """Chunks with what an embedding of at most ``limit`` tokens holds and leaves out, and the tier of their size."""
    n, zero = F.col("n_tokens"), F.lit(0).cast("long")
    tier = F.when(n <= tiers[0], "low").when(n <= tiers[1], "medium").otherwise("high")
    return chunks.select("*", F.least(n, F.lit(limit).cast("long")).alias("embedding_tokens"), F.greatest(zero, n - limit).alias("omitted_tokens"), tier.alias("tier"))


def token_summary(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.groupBy(by).agg(
        F.count("*").alias("n_chunks"),
        F.sum("n_tokens").alias("total_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.sum("omitted_tokens").alias("omitted_tokens"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in ("low", "medium", "high")],
    )


def qa_findings(chunks: DataFrame, smallest: int = 15, largest: int = 1_600) -> DataFrame:
    """One row per chunk and rule that it breaks."""
    rule = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
    rules = F.array_compact(
        F.array(
            rule(F.col("omitted_tokens") > 0, "embedding_truncated", "low"),
            rule(F.col("n_tokens") < smallest, "empty_chunk", "high"),
            rule(F.col("n_tokens") > largest, "oversized_content", "medium"),
        )
    )
    return chunks.select("file_id", "doc_id", F.explode(rules).alias("r")).select("file_id", "doc_id", "r.rule", "r.severity")


def qa_rollup(files: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """Findings by severity per file and both status vocabularies: failed, warning or passed, and failed or passed."""
    counts = findings.groupBy(by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])
    filled = files.join(counts, by, "left").na.fill(0, ["high", "medium", "low"])
    bad = F.col("high") > 0
    status = F.when(bad, "failed").when(F.col("medium") + F.col("low") > 0, "warning").otherwise("passed")
    return filled.withColumn("status", status).withColumn("stage_status", F.when(bad, "failed").otherwise("passed"))


def embedding_plan(chunks: DataFrame, by: str, size: str, batch: int) -> DataFrame:
    """Texts to embed and the batches they take, blank ones skipped."""
    return chunks.groupBy(by).agg(F.count_if(F.col(size) > 0).alias("n_texts")).withColumn("batches", F.ceil(F.col("n_texts") / batch).cast("long"))


def embedding_families(units: DataFrame, by: list[str], families: dict[str, Column], batch: int) -> DataFrame:
    """``by``, ``family``, ``n_texts``, ``batches``: texts to embed of each family, blank ones skipped, and the batches they take.

    ``families``: arrays of texts, one of a single text for a column. Every family has its row, with 0 where nothing is left.
    """
    real = lambda texts: F.size(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""))
    counted = units.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("family"), real(c).cast("long").alias("n")) for n, c in families.items()])).alias("f"))
    totals = counted.groupBy(*by, F.col("f.family").alias("family")).agg(F.sum("f.n").alias("n_texts"))
    return totals.withColumn("batches", F.ceil(F.col("n_texts") / batch).cast("long"))


def section_rollup(units: DataFrame, file: str, item: str, order: str, unit: str, size: str) -> DataFrame:
    """One section per item number of a file, numbered from 1, with its units in order."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(unit).cast("string").alias("u")))), lambda x: x["u"]), ",")
    rolled = units.groupBy(file, item).agg(F.count("*").alias("n_units"), F.sum(size).alias("section_tokens"), members.alias("members"))
    return rolled.withColumn("section_id", F.row_number().over(Window.partitionBy(file).orderBy(item))).drop(item)


def item_records(chunks: DataFrame, pages: DataFrame, sheets: DataFrame, by: str) -> DataFrame:
    """Each chunk's item with what was extracted for it, by number: pages for page items, sheets for all others.

    ``pages``: ``by``, ``page_number``, ``markdown_chars``; ``sheets``: ``by``,
    ``sheet_number``, ``row_count``, ``used_range``. Without an extraction,
    counts are 0 and the range blank; of the other kind of item they are null.
    """
    is_page = F.col("item_type") == "page"
    p = pages.select(F.col(by).alias("__pb"), "page_number", "markdown_chars")
    s = sheets.select(F.col(by).alias("__sb"), "sheet_number", "row_count", "used_range")
    joined = chunks.join(p, is_page & (F.col(by) == F.col("__pb")) & (F.col("item_number") == F.col("page_number")), "left")
    joined = joined.join(s, ~is_page & (F.col(by) == F.col("__sb")) & (F.col("item_number") == F.col("sheet_number")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        *[F.col(c) for c in chunks.columns],
        F.when(is_page, F.coalesce(F.col("markdown_chars").cast("long"), zero)).alias("markdown_chars"),
        F.when(~is_page, F.coalesce(F.col("row_count").cast("long"), zero)).alias("row_count"),
        F.when(~is_page, F.coalesce("used_range", F.lit(""))).alias("used_range"),
    )


def unpivot(units: DataFrame, unit: str, content: str, facets: dict[str, str], keep: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """Long-form rows of each unit: its content and each term of its facets, with ids that name them, beside the columns ``keep``.

    ``facets`` maps a kind to an array column. Terms are numbered from ``first``. One pass over the units.
    """
    uid = F.col(unit).cast("string")
    rows = F.array(F.struct(F.concat(uid, F.lit("::content")).alias("embedding_id"), F.lit("content").alias("embedding_type"), F.col(content).alias("term")))
    for kind, column in facets.items():
        rows = F.concat(rows, F.transform(F.coalesce(column, F.array().cast("array<string>")), _facet(uid, kind, first)))
    return units.select(unit, *keep, F.explode(rows).alias("r")).select("r.embedding_id", unit, "r.embedding_type", "r.term", *keep)


def _facet(uid: Column, kind: str, first: int):
    def row(term, i):
        i = i + first
        ident = F.concat(uid, F.lit(f"::{kind}::"), F.lpad(i.cast("string"), F.greatest(F.lit(3), F.length(i.cast("string"))), F.lit("0")), F.lit("::"), F.substring(F.sha2(term, 256), 1, 12))
        return F.struct(ident.alias("embedding_id"), F.lit(kind).alias("embedding_type"), term.alias("term"))

    return row


def workbook_qa(cells: DataFrame, by: str) -> DataFrame:
    """Formulas per workbook, those without a cached value, and the severity of that: medium if any, else none."""
    formula = F.col("formula").isNotNull()
    counts = cells.groupBy(by).agg(F.count_if(formula).alias("formulas"), F.count_if(formula & F.col("value").isNull()).alias("uncached"))
    return counts.withColumn("severity", F.when(F.col("uncached") > 0, "medium").otherwise("none"))


# Titles of sheets that hold no content, in lower case.
SYSTEM_SHEETS = ("variables",)


def workbook_findings(cells: DataFrame, sheets: DataFrame, on: list[str], title: str, system: tuple[str, ...] = SYSTEM_SHEETS) -> DataFrame:
    """``on``, ``code``, ``severity``, ``n`` of what is wrong with each sheet.

    A sheet with formulas without a cached value is a finding of medium
    severity with their number; a system sheet among the content is one of high
    severity. ``cells``: ``on``, ``formula``, ``value``; ``sheets``: ``on`` and the title.
    """
    uncached = cells.groupBy(*on).agg(F.count_if(F.col("formula").isNotNull() & F.col("value").isNull()).alias("n")).where("n > 0")
    missing = uncached.select(*on, F.lit("formula_cache_missing").alias("code"), F.lit("medium").alias("severity"), "n")
    named = sheets.where(F.lower(F.trim(title)).isin(*system))
    return missing.unionByName(named.select(*on, F.lit("system_sheet_emitted").alias("code"), F.lit("high").alias("severity"), F.lit(1).cast("long").alias("n")))


def index_rows(units: DataFrame, sections: DataFrame, documents: DataFrame, facets: dict[str, str]) -> DataFrame:
    """Long-form rows of all that is embedded: units by content and facet, sections and documents by their summaries.

    ``units``: ``document_id``, ``section_id``, ``unit_id``, ``content`` and the
    facets' arrays; ``sections``: ``document_id``, ``section_id``, ``summary``;
    ``documents``: ``document_id``, ``summary``. Returns ``embedding_id``,
    ``embedding_type``, ``embedding_scope``, ``document_id``, ``section_id``,
    ``unit_ids``, ``text``, ``text_hash``. A section or document lists its units in
    order; one with a blank summary has no row, nor has a unit's blank content.
    A document is a file, whose units are as few as its pages.
    """
    key = F.concat(F.col("document_id").cast("string"), F.lit("::"))
    none = F.lit(None).cast("string")
    named = units.withColumns({"__id": F.concat(key, F.col("unit_id").cast("string")), "section_id": F.col("section_id").cast("string"), "unit_ids": F.array("unit_id")})
    own = unpivot(named, "__id", "content", facets, ("document_id", "section_id", "unit_ids"), first=1)
    small = own.select("embedding_id", "embedding_type", F.lit("content_unit").alias("embedding_scope"), "document_id", "section_id", "unit_ids", F.col("term").alias("text"))
    listed = lambda by: units.groupBy(*by).agg(F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))
    empty = F.array().cast(units.select(F.array("unit_id").alias("a")).schema["a"].dataType)
    s = sections.join(listed(["document_id", "section_id"]), ["document_id", "section_id"], "left")
    of_section = s.select(
        F.concat(key, F.lit("section::"), F.col("section_id").cast("string"), F.lit("::summary")).alias("embedding_id"), F.lit("section_summary").alias("embedding_type"), F.lit("section").alias("embedding_scope"),
        "document_id", F.col("section_id").cast("string").alias("section_id"), F.coalesce("unit_ids", empty).alias("unit_ids"), F.col("summary").alias("text"),
    )
    of_document = documents.join(listed(["document_id"]), "document_id", "left").select(
        F.concat(key, F.lit("document_summary")).alias("embedding_id"), F.lit("document_summary").alias("embedding_type"), F.lit("document").alias("embedding_scope"),
        "document_id", none.alias("section_id"), F.coalesce("unit_ids", empty).alias("unit_ids"), F.col("summary").alias("text"),
    )
    return small.unionByName(of_section).unionByName(of_document).where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text_hash", F.sha2("text", 256))
