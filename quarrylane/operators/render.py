"""Text assembly: embedding texts, evidence blocks, labels, links, status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedding_text(title: Column, header: Column, body: Column) -> Column:
    """``Section: title. [header] body``; parts that are blank are left out."""
    part = lambda c, shown: F.when(F.coalesce(F.trim(c), F.lit("")) != "", shown)
    return F.concat_ws(" ", part(title, F.concat(F.lit("Section: "), title, F.lit("."))), part(header, F.concat(F.lit("["), header, F.lit("]"))), part(body, body))


def page_text(page: Column, title: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Title: "), title), F.concat(F.lit("Markdown: "), body))


def sheet_row_text(row: Column, cells: Column) -> Column:
    """``R3: A=1 | C=2`` from an array of (letter, value), blank cells left out."""
    shown = F.transform(F.filter(cells, lambda c: F.coalesce(c["value"], F.lit("")) != ""), lambda c: F.concat(c["letter"], F.lit("="), c["value"]))
    return F.concat(F.lit("R"), row.cast("string"), F.lit(": "), F.array_join(shown, " | "))


def truncated(c: Column, limit: int) -> Column:
    """Long evidence cut to the limit, the cut marked on its own line."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 15), F.lit("\n...[truncated]")))


def evidence_type(page: Column, sheet: Column, section: Column) -> Column:
    return F.when(F.coalesce(sheet, F.lit("")) != "", "sheet").when(page.isNotNull(), "page").when(F.coalesce(section, F.lit("")) != "", "section").otherwise("document")


def link(base: str, path: Column, page: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(path), F.when(page.isNotNull(), F.concat(F.lit("#page="), page.cast("string"))).otherwise(""))


def evidence_block(rows: DataFrame, by: list[str], order: str, ident: str, body: str, limit: int) -> DataFrame:
    """One markdown block per scope: its evidence in order. A scope holds at most the retrieval's cap of chunks."""
    line = F.concat(F.lit("### "), F.col(ident), F.lit("\n"), truncated(F.col(body), limit))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n\n")
    return rows.groupBy(*by).agg(joined.alias("block"), F.count("*").alias("n"))


def status_line(rows: DataFrame, by: list[str], kind: str, text: str, order: str) -> DataFrame:
    """One line per combo: a summary outranks other kinds, then the later row."""
    priority = F.struct((F.col(kind) == "summary").alias("s"), order)
    return rows.groupBy(*by).agg(F.max_by(text, priority).alias("line"))


def data_source(c: Column) -> Column:
    """A source's name in lower case, words joined by hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_]+", "-")


def source_title(bank: Column, period: Column, source: Column) -> Column:
    """``RY 2024 Q1 Investor Slides`` from a bank, a period such as ``2024_Q1`` and a source; blank without bank or period."""
    known = data_source(source)
    name = F.when(known == "investor-slides", "Investor Slides").when(known == "financial-supp", "Financial Supplement").otherwise(F.initcap(F.replace(known, F.lit("-"), F.lit(" "))))
    year, quarter = F.split_part(period, F.lit("_"), F.lit(1)), F.upper(F.regexp_replace(period, "^[^_]*_", ""))
    whole = F.trim(F.concat_ws(" ", F.upper(bank), year, quarter, name))
    return F.when((F.coalesce(bank, F.lit("")) != "") & F.coalesce(F.contains(period, F.lit("_")), F.lit(False)), whole).otherwise("")


# Structure types of documents.
STRUCTURE_TYPES = ("sheet_based", "slide_deck", "page_based", "chapters", "sections", "topic_based", "semantic")


def structure_type(filetype: Column, source: Column, proposed: Column) -> Column:
    """By file type and source first; else what was proposed, if it is a structure type."""
    by_file = F.when(filetype == "xlsx", "sheet_based").when(data_source(source) == "investor-slides", "slide_deck").when(filetype == "pdf", "page_based")
    return F.coalesce(by_file, F.when(proposed.isin(*STRUCTURE_TYPES), proposed), F.lit("semantic"))


def fallback_summary(title: Column, filename: Column, filetype: Column, items: Column) -> Column:
    """``<title> contains 3 pages prepared for retrieval.``"""
    label = F.when(filetype == "pdf", "page").when(filetype == "xlsx", "sheet").otherwise("item")
    named = F.coalesce(F.nullif(title, F.lit("")), filename)
    return F.concat(named, F.lit(" contains "), items.cast("string"), F.lit(" "), label, F.when(items == 1, "").otherwise("s"), F.lit(" prepared for retrieval."))


# Names of a transcript's sections.
SECTION_MD, SECTION_QA = "MANAGEMENT DISCUSSION SECTION", "Q&A"


def section_name(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    managed, asked = low.contains("management") & low.contains("discussion"), low.contains("question") | low.contains("q&a")
    return F.when(managed, SECTION_MD).when(asked, SECTION_QA).otherwise(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Transcript")))


def turn_role(hint: Column, participant_type: Column) -> Column:
    """Question, Answer or Speaker, by the turn's mark first and the participant's type else."""
    kind = F.lower(F.coalesce(participant_type, F.lit("")))
    return F.when(hint == "q", "Question").when(hint == "a", "Answer").when(kind == "analyst", "Question").when(kind.isin("executive", "moderator"), "Answer").otherwise("Speaker")


def companies(participants: DataFrame, by: str, order: str) -> DataFrame:
    """Companies of each transcript: affiliations of executives and moderators, of all where there are none, in order, each once whatever its case.

    ``participants``: ``by``, ``order``, ``participant_type``, ``affiliation``.
    One value per company and transcript is kept before the list is made.
    """
    kind = F.lower(F.coalesce(F.col("participant_type"), F.lit("")))
    name = F.trim(F.regexp_replace(F.coalesce("affiliation", F.lit("")), r"\s+", " "))
    rows = participants.select(by, order, kind.isin("executive", "moderator").alias("own"), name.alias("company"))
    sides = rows.groupBy(by).agg(F.bool_or("own").alias("any_own")).withColumnRenamed(by, "__by")
    wanted = rows.join(sides, F.col(by).eqNullSafe(F.col("__by"))).where("own or not any_own").where("company <> ''")
    first = wanted.groupBy(by, F.lower("company").alias("__low")).agg(F.min(F.struct(order, "company")).alias("f"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["company"]).alias("companies"))


def block_markdown(speaker: Column, section: Column, block: Column, body: Column) -> Column:
    """Markdown of one speaker block of a discussion."""
    lines = F.array(
        F.concat(F.lit("# Management Discussion: "), speaker), F.concat(F.lit("Section: "), section), F.concat(F.lit("Speaker: "), speaker), F.concat(F.lit("Speaker block ID: "), block.cast("string")), F.lit(""), body
    )
    return F.trim(F.array_join(lines, "\n\n"))


def speaker_role(kind: Column, title: Column) -> Column:
    """Role of a transcript's speaker from its turn and title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(t.contains("analyst"), "analyst").when(t.contains("operator"), "operator").when(kind == "q", "analyst").otherwise("executive")
