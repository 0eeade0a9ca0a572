"""Intermediate tables in the folder that all executors share, and the connected components built on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.session import scratch


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: a lost executor costs the tasks it ran, and what a task
    chose (row ids, orders) stays as written however often it is read. With
    ``by`` there is a folder for each of that column's values.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._ql_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table written by ``staged`` that no later plan reads."""
    path = getattr(df, "_ql_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Rows of a key from which it is common, and common keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def hot_bound(rows: int, keys: int = HOT_KEYS) -> int:
    """Rows of a key beyond which it is common, so that of ``rows`` at most ``keys`` keys are."""
    return max(HOT_ROWS, -(-rows // max(1, keys)))


def met(rows: DataFrame, table: DataFrame, on: list[str], n: str, hot: int) -> DataFrame:
    """``rows`` with what ``table`` holds for their keys; keys it lacks go. ``table`` has a row a key, and ``n``, the number of rows with it.

    A key of more than ``hot`` rows is broadcast, so its rows stay where they
    are; their number is bounded by ``hot_bound``. Others meet in a shuffle.
    """
    common = F.broadcast(table.where(F.col(n) > hot))
    others = table.where(F.col(n) <= hot)
    return rows.join(common, on).unionByName(rows.join(common.select(*on), on, "left_anti").join(others, on))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; direction,
    repeats and self loops don't matter. Returns ``node``, ``root`` for each
    node that is not itself a root. Alternates large-star and small-star steps
    as aggregations and equality joins (so a hub's edges can be split), and
    writes each round to the shared folder.
    """
    current = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(current)
    if not before[0]:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        nxt = staged(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        after = mark(nxt)
        discard(current)
        current = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
