"""Integer vectors: what exact search and hard-negative mining share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A component counts as floor(SCALE * x).
SCALE = 256
#: Rows that meet a hot vector are dealt over so many keys.
SALTS = 16
#: Doubles hold whole numbers up to here; beyond, products are taken in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 63


def integer_rows(vectors: DataFrame, vector_col: str, **columns: Column) -> DataFrame:
    """``columns`` and ``v`` (array<long>) of the rows whose vector is not null and holds only finite components."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(*[c.alias(n) for n, c in columns.items()], F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))


def first_ids(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """``by``, ``ids`` (the first ``k`` ids of each group, null ids last) and ``first``; ``k`` rows a group and task are all that is shuffled."""
    order = F.col("vec_id").asc_nulls_last()
    near = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__n") <= k)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("__n", "vec_id"))), lambda s: s["vec_id"])
    return near.groupBy(*by).agg(ids.alias("ids")).withColumn("first", F.get("ids", F.lit(0)))


def exact_type(distinct: DataFrame) -> tuple[int, int, type]:
    """Number of rows, largest dimension, and the number type in which inner products are exact. Scores beyond a long are refused."""
    largest = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    found = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(largest).alias("top")).first()
    bound = (found.top or 0.0) ** 2 * (found.dim or 0)
    if bound >= EXACT_LONG:
        raise ValueError(f"components up to {found.top:g} over {found.dim} dimensions give scores beyond a 64-bit integer")
    return found.n, found.dim or 0, np.float64 if bound < EXACT_DOUBLE else np.int64


def padded(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are followed by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy()
    out = np.zeros((len(size), width), dtype=kind)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def inner(a: str, b: str) -> Column:
    """Inner product of two columns of integer vectors; a shorter one is followed by zeros."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("long")))
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def best(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group; each task sends on ``k`` rows of a group at most."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def without_own(items: Column, own_id: Column, k: int) -> Column:
    """The first ``k`` of ``items`` (structs with ``vec_id`` and ``own``) less one copy of the row's own entry."""
    mine = F.transform(items, lambda s: s["own"] & s["vec_id"].eqNullSafe(own_id))
    at = F.array_position(mine, True)
    return F.slice(F.filter(items, lambda s, i: i + 1 != at), 1, k)


def salted(rows: DataFrame, salt_by: Column) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))


def for_each_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
