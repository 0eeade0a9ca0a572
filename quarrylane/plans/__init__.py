"""Queries over the standard tables, grouped by the part of the engine they exercise."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from quarrylane.catalog import Query

MODULES = ("search", "etl", "dialogue", "analytics", "progress", "sources", "scoping", "records", "scoped", "fulltext", "tables", "model_records", "versioned", "planned")


def _catalogs():
    return [importlib.import_module(f"quarrylane.plans.{name}").CATALOG for name in MODULES]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for catalog in _catalogs():
        if clash := found.keys() & catalog.queries.keys():
            raise ValueError(f"queries registered twice: {sorted(clash)}")
        found |= catalog.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for catalog in _catalogs():
        found |= catalog.sql
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_topk_gap_fill"](spark, sf_dir)
