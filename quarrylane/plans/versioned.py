"""Queries over versioned tables: changes with the rows they return, and batches of new files applied as commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.session import scratch, table
from quarrylane.sources import versions
from quarrylane.streaming import incremental

CATALOG = Catalog()


def _store(spark: SparkSession, df: DataFrame, name: str) -> str:
    root = f"{scratch(spark)}/{uuid.uuid4().hex}"
    versions.insert(spark, root, name, df)
    return root


@CATALOG.query(
    "update_returning",
    "SELECT c_custkey, c_mktsegment, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_acctbal < 0",
)
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _store(spark, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "customer")
    return versions.update(spark, root, "customer", F.col("c_acctbal") < 0, {"c_acctbal": F.col("c_acctbal") + 100}).changed


@CATALOG.query(
    "committed_changes",
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_totalprice >= 50000",
)
def committed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inserted, then updated, then deleted by price; the table as of the last version."""
    root = _store(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), "orders")
    versions.update(spark, root, "orders", F.col("o_orderstatus") == "P", {"o_orderpriority": F.lit("pending")})
    last = versions.delete(spark, root, "orders", F.col("o_totalprice") < 50000).version
    return versions.rows(spark, root, last, "orders").drop("o_totalprice")


@CATALOG.query(
    "incremental_master",
    """SELECT user_id AS file_key, event_type AS file_hash, ts, event_id FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def incremental_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, out of events applied as a stream of batches, each one commit.

    An event stands for a delivered file; its position is part of its hash, so that later ones replace.
    """
    root, at = f"{scratch(spark)}/{uuid.uuid4().hex}", f"{scratch(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    events.repartitionByRange(8, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(at)
    arrived = F.struct("ts", "event_id").alias("arrived")
    files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(at).select(
        F.col("user_id").alias("file_key"), F.concat_ws(" ", "event_id", "event_type").alias("file_hash"), arrived, "event_type", "ts", "event_id"
    )
    last = lambda f: {"last": f.select("file_key", "event_type", "ts", "event_id")}
    incremental.run_incremental(files, root, f"{at}-state", last).awaitTermination()
    return versions.rows(spark, root, versions.pin(spark, root), "last").select("file_key", F.col("event_type").alias("file_hash"), "ts", "event_id")
