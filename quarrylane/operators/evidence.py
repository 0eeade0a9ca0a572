"""Findings: ordered dedupe, evidence ids, references, coverage and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators import ordering

# The parts of an evidence key.
EVIDENCE_KEY = ["source_id", "file_name", "page", "sheet", "section", "location"]


def dedupe_findings(findings: DataFrame, key: list[Column], order: str) -> DataFrame:
    return ordering.first_wins(findings, key, [order])


def evidence_ids(findings: DataFrame, order: str, key: list[str] | None = None) -> DataFrame:
    """Evidence keys with ids E1.. in the order of their first finding; parts that are null count as empty."""
    key = key or EVIDENCE_KEY
    filled = findings.select(order, *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in key])
    return ordering.ids_by_first(filled, key, order)


def cumulative(rounds: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """Findings of successive rounds as one list: the first of each key stays, and ids E1.. follow the order of rounds and of their rows."""
    tagged = [r.withColumn("__round", F.lit(i)) for i, r in enumerate(rounds)]
    all_ = tagged[0]
    for r in tagged[1:]:
        all_ = all_.unionByName(r)
    kept = ordering.first_wins(all_, [F.col(k) for k in key], ["__round", order])
    numbered = ordering.numbered_globally(kept, ["__round", order], "__id")
    return numbered.withColumn("id", F.concat(F.lit("E"), F.col("__id").cast("string"))).drop("__round", "__id")


def references(findings: DataFrame, refs: DataFrame, on: str) -> DataFrame:
    """Each finding with one reference of its ``on``: of equal page first, then one whose location holds the finding's
    or is held by it, else the first; null where there is none.
    """
    r = refs.select(F.col(on).alias("__on"), "ref_id", F.col("page").alias("__page"), F.lower("location").alias("__loc"))
    # One row per (file, page), per pair of distinct locations, and per file: no finding meets all references of its file.
    by_page = r.where("__page is not null").groupBy("__on", "__page").agg(F.min("ref_id").alias("page_ref"))
    by_file = r.groupBy("__on").agg(F.min("ref_id").alias("file_ref"))
    theirs = r.groupBy("__on", "__loc").agg(F.min("ref_id").alias("loc_ref"))
    ours = findings.select(F.col(on).alias("__f"), F.lower("location").alias("__floc")).distinct()
    near = F.contains("__floc", F.col("__loc")) | F.contains("__loc", F.col("__floc"))
    by_loc = ours.join(theirs, (F.col("__f") == F.col("__on")) & near).groupBy("__f", "__floc").agg(F.min("loc_ref").alias("loc_ref"))
    out = findings.select("finding_id", F.col(on).alias("__k"), F.col("page").alias("__p"), F.lower("location").alias("__l"))
    out = out.join(by_page, (F.col("__k") == F.col("__on")) & (F.col("__p") == F.col("__page")), "left").drop("__on", "__page")
    out = out.join(by_loc, (F.col("__k") == F.col("__f")) & (F.col("__l") == F.col("__floc")), "left").drop("__f", "__floc")
    out = out.join(by_file, F.col("__k") == F.col("__on"), "left")
    rank = F.when(F.col("page_ref").isNotNull(), 0).when(F.col("loc_ref").isNotNull(), 1).when(F.col("file_ref").isNotNull(), 2)
    return out.select("finding_id", F.coalesce("page_ref", "loc_ref", "file_ref").alias("ref_id"), rank.alias("match_rank"))


def catalog_matches(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(chunk, ref) that agree on chunk id and on file path or file name: a union of two equality joins instead of one with OR."""
    by_path = chunks.join(catalog.select("ref_id", "chunk_id", "file_path"), ["chunk_id", "file_path"])
    by_name = chunks.join(catalog.select("ref_id", "chunk_id", "file_name"), ["chunk_id", "file_name"])
    return by_path.select("chunk_key", "ref_id").union(by_name.select("chunk_key", "ref_id")).distinct()


def coverage(chunks: DataFrame, by: list[str], section: str, most: int = 8) -> DataFrame:
    """Chunks per scope and its first ``most`` section names in order."""
    names = F.slice(F.array_sort(F.collect_set(section)), 1, most)
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.array_join(names, ",").alias("sections"))


def status(has_findings: Column, has_gaps: Column) -> Column:
    return F.when(has_findings & has_gaps, "partial_success").when(has_findings, "success").otherwise("no_available_data")


def valid_findings(findings: DataFrame, pages: DataFrame, on: list[str]) -> DataFrame:
    """Findings with a text; a page that its file doesn't have becomes null, metric values become numbers.

    ``findings``: ``finding``, ``page``, ``metric_value`` and the keys ``on``; ``pages``: keys and ``page``.
    """
    from quarrylane.functions import text

    real = findings.where(F.coalesce(F.trim("finding"), F.lit("")) != "")
    known = pages.select(*on, F.col("page").alias("__p")).distinct()
    same = [F.col(f"f.{k}") == F.col(f"k.{k}") for k in on] + [F.col("f.page") == F.col("k.__p")]
    joined = real.alias("f").join(known.alias("k"), same, "left")
    return joined.select(*[F.col(f"f.{c}") for c in findings.columns if c not in ("finding", "page", "metric_value")], text.collapsed(F.col("f.finding")).alias("finding"), F.col("k.__p").alias("page"), text.parse_number(F.col("f.metric_value")).alias("metric_value"))
