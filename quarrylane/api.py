"""What a caller uses: search, research results, slot audit, availability, table set-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions.providers import Provider
from quarrylane.operators import evidence, facts, merge, ordering, research
from quarrylane.schemas import TABLES
from quarrylane.sources.files import create_tables


def hybrid_search(chunks: DataFrame, vectors: DataFrame, question: str, provider: Provider | None = None, scope: DataFrame | None = None, k: int = 20) -> DataFrame:
    """Top chunks for a question: see ``operators.research.hybrid_search``."""
    return research.hybrid_search(chunks, vectors, research.prepare(chunks.sparkSession, question), provider, scope, k=k)


def assembled(findings: DataFrame, order: str = "finding_id") -> tuple[DataFrame, DataFrame]:
    """(findings without repeats, evidence registry) of all sources together."""
    deduped = evidence.dedupe_findings(findings, [F.lower("finding"), F.col("page"), F.lower("location")], order)
    return deduped, evidence.evidence_ids(deduped, order)


def result_status(combos: DataFrame, findings: DataFrame, gaps: DataFrame, on: list[str]) -> DataFrame:
    """Status of each requested combo from its findings and gaps."""
    found, missing = findings.groupBy(*on).agg(F.count("*").alias("n_findings")), gaps.groupBy(*on).agg(F.count("*").alias("n_gaps"))
    joined = combos.join(found, on, "left").join(missing, on, "left").na.fill(0, ["n_findings", "n_gaps"])
    return joined.withColumn("status", evidence.status(F.col("n_findings") > 0, F.col("n_gaps") > 0))


def audit_slots(slots: DataFrame, known: DataFrame) -> DataFrame:
    """Slots with how much of what they ask for is missing, and the distinct bank and period to backfill."""
    missing = facts.missing_slots(slots, known)
    scope = missing.groupBy("slot_id").agg(F.count("*").alias("n_missing"), F.array_sort(F.collect_set(F.struct("bank", "period"))).alias("backfill"))
    return slots.select("slot_id").join(scope, "slot_id", "left").na.fill(0, ["n_missing"])


def available(combos: DataFrame, table: DataFrame, on: list[str], source: str) -> DataFrame:
    return merge.availability_lookup(combos, table, on, source)


def latest_prompts(prompts: DataFrame, highest_id: bool = True) -> DataFrame:
    """The latest prompt of each (model, layer, name): by update, then highest or lowest id."""
    ident = F.col("id") if highest_id else -F.col("id")
    return merge.latest(prompts.withColumn("__id", ident), ["model", "layer", "name"], "updated_at", "__id").drop("__id")


def composed_prompt(parts: dict[str, str | None]) -> str:
    """Global parts in their fixed order, blank ones left out."""
    return "\n\n".join(p for k in ("fiscal", "project", "database", "restrictions") if (p := (parts.get(k) or "").strip()))


def set_up(spark: SparkSession) -> list[str]:
    """Create the tables that are missing."""
    return create_tables(spark, TABLES)


def sessions(turns: DataFrame) -> DataFrame:
    return ordering.sessionise(turns, ["conv_id"], ["turn"], F.col("role") == "user")
