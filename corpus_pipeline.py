"""Corpus pipeline: quality rules, language ID, near-dedup, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylane.llm import bpe, langid, mixing, quality, similar
from quarrylane.llm.queries import MIX_WEIGHTS, byte_bpe
from quarrylane.llm.staging import staged
from quarrylane.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps. A null or wordless text is rejected."""
    return quality.filtered(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose letters are at least half in one learned language; without any labelled row all are rejected."""
    return langid.filtered(docs, langid.train(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Operator 10's deletion variants give the first candidates; see ``similar``
    for what they can't reach. Links are verified at a similarity of 0.8 on
    five-word shingles.
    """
    return similar.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by the target weights of their sources, shuffled; copies are repeated rows."""
    return mixing.mixed(docs, MIX_WEIGHTS, copy_col="__ql_copy", key_col="__ql_mix").select(*[f"`{c}`" for c in docs.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row."""
    return bpe.digests(docs, byte_bpe())


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL expresses neither the language model nor BPE merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each earlier stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
