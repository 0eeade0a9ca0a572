"""Catalog and JDBC access, YAML tables, run locks."""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession


def jdbc(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """Rows of a query in another database; read in parallel where a numeric column and its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds:
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions).load()
    return reader.option("query", query).load()


def described(spark: SparkSession, table: str) -> list[str] | None:
    """Column names of a table in order, or None if it doesn't exist."""
    return [c.name for c in spark.catalog.listColumns(table)] if spark.catalog.tableExists(table) else None


def yaml_rows(text: str, required: tuple[str, ...] = ("model", "layer", "name")) -> list[dict]:
    """Mappings of a YAML file that have all required keys; a list, one mapping, or mappings by name."""
    import yaml

    body = yaml.safe_load(text)
    items = body if isinstance(body, list) else [body] if isinstance(body, dict) and set(required) <= body.keys() else list(body.values()) if isinstance(body, dict) else []
    return [x for x in items if isinstance(x, dict) and all(x.get(k) for k in required)]


def archived(folder: str) -> str | None:
    """Zip a driver folder beside itself under a name not yet taken, and empty it; None if there is nothing in it."""
    if not os.path.isdir(folder) or not os.listdir(folder):
        return None
    stem, n = f"{folder.rstrip('/')}_{time.strftime('%Y%m%dT%H%M%S')}", 0
    while os.path.exists(f"{stem}_{n}.zip"):
        n += 1
    made = shutil.make_archive(f"{stem}_{n}", "zip", folder)
    shutil.rmtree(folder)
    os.makedirs(folder)
    return made


class RunLock:
    """An exclusive lock file on the driver; one older than a day is taken over, and a failed run leaves its own behind."""

    def __init__(self, path: str, stale_seconds: float = 86_400) -> None:
        self.path, self.stale = path, stale_seconds

    def __enter__(self) -> RunLock:
        try:
            if time.time() - os.stat(self.path).st_mtime > self.stale:
                os.remove(self.path)
        except FileNotFoundError:
            pass
        os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            os.remove(self.path)
