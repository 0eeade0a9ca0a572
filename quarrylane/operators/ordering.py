"""Order-dependent operators: sessions, numbering, budgets, first-wins dedupe, ids by first occurrence."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.operators import scans
from quarrylane.session import scratch, written


def sessionise(turns: DataFrame, by: list[str], order: list[str], question: Column, name: str = "session") -> DataFrame:
    """A new session opens at each question but the first turn; sessions count from 1."""
    asks = F.coalesce(question, F.lit(False)).cast("int")
    found = scans.scan(turns, by, order, {"__asked": scans.running_sum(asks), "__first": scans.first_value(asks)})
    return found.withColumn(name, F.col("__asked") - F.col("__first.x") + 1).drop("__asked", "__first")


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "n") -> DataFrame:
    """Numbers from 1 in each group; a group may be of any size."""
    return scans.scan(rows, by, order, {name: scans.row_count()})


def last_messages(messages: DataFrame, by: list[str], order: str, n: int, role: str = "role", allowed: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last ``n`` messages of each conversation among those of allowed roles and not blank."""
    good = messages.where(F.col(role).isin(*allowed) & (F.trim("text") != ""))
    return good.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")


def greedy_batches(sizes: Column, budget: int) -> Column:
    """Batch number of each element of an ordered array: a new one opens where the sum would go over the budget.

    An element over the budget has a batch of its own. One left fold, linear in the array.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        opens = (a["sum"] > 0) & (a["sum"] + x > budget)
        batch = a["batch"] + opens.cast("int")
        return F.struct(batch.alias("batch"), F.when(opens, x).otherwise(a["sum"] + x).cast("long").alias("sum"), F.concat(a["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def batched(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """``by``, ``order``, ``size``, ``batch`` of rows in order, batched greedily by group; sizes are not negative, null counts as 0.

    Rows are range-partitioned. Groups that lie in one part take one sequential
    pass, part by part; those that are cut over parts go through ``_batched_long``,
    so that no task holds more than a part.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, batch, total = object(), 0, 0
        for b in batches:
            out = []
            for key, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != group:
                    group, batch, total = key, 0, 0
                opens = total > 0 and total + (n or 0) > budget
                batch, total = (batch + 1, n or 0) if opens else (batch, total + (n or 0))
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[by, order, size, "batch"])

    placed = scans.spread(rows.select(by, order, F.col(size).cast("long").alias(size)), [by], [order])
    split = written(scans.spanning(placed, [by]).withColumn("g__", F.monotonically_increasing_id()))
    short = placed.join(F.broadcast(split), scans.same([by], placed, split), "left_anti")
    ordered = short.repartition(scans.PART).sortWithinPartitions(scans.PLACE).select(by, order, size)
    found = ordered.mapInArrow(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, `{size}` long, batch int")
    if split.isEmpty():
        return found
    long = placed.join(F.broadcast(split), scans.same([by], placed, split)).select("g__", placed[by], order, size)
    return found.unionByName(_batched_long(long, order, size, budget).select(by, order, size, "batch"))


def _batched_long(rows: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """``rows`` with ``batch``, for groups ``g__`` of any size.

    A batch that opens at a row ends before the first row at which the sum goes
    over the budget; with sums up to each row, that row's number is a count of
    sums, taken for all rows at once by a scan over sums and targets merged in
    order. That gives each row's next opening. Those that are reached from a
    group's first row are found by doubling the jumps, in as many rounds as the
    longest group's number of batches has binary digits.
    """
    summed = written(scans.scan(rows, ["g__"], [order], {"i__": scans.row_count(), "s__": scans.running_sum(F.col(size))}))
    n = F.coalesce(F.col(size), F.lit(0))
    targets = F.array(
        F.struct(F.col("s__").alias("v"), F.lit(0).alias("kind")),
        F.struct((F.col("s__") - n + budget).alias("v"), F.lit(1).alias("kind")),
        F.when(n == 0, F.struct(F.col("s__").alias("v"), F.lit(2).alias("kind"))),
    )
    merged = summed.select("g__", "i__", F.explode(F.array_compact(targets)).alias("t")).select("g__", "i__", "t.v", "t.kind")
    counted = scans.scan(merged, ["g__"], ["v", "kind", "i__"], {"below__": scans.running_sum((F.col("kind") == 0).cast("long"))})
    # A sum of 0 opens nothing, so after rows of size 0 the batch takes one row whatever its size.
    opens = F.greatest(F.max(F.when(F.col("kind") == 1, F.col("below__") + 1)), F.max(F.when(F.col("kind") == 2, F.col("below__") + 2)), F.col("i__") + 1)
    jumps = written(counted.where("kind > 0").groupBy("g__", "i__").agg(opens.alias("to__")))
    last = summed.groupBy("g__").agg(F.max("i__").alias("last__"))
    jumps = written(jumps.join(F.broadcast(last), "g__").where("to__ <= last__").drop("last__"))
    reached = written(last.select("g__", F.lit(1).cast("long").alias("i__"), F.lit(0).cast("long").alias("b__")))
    step = 1
    while not jumps.isEmpty():
        reached = written(reached.union(reached.join(jumps, ["g__", "i__"]).select("g__", F.col("to__"), F.col("b__") + step)))
        further = jumps.select("g__", F.col("i__").alias("to__"), F.col("to__").alias("then__"))
        jumps = written(jumps.join(further, ["g__", "to__"]).select("g__", "i__", F.col("then__").alias("to__")))
        step *= 2
    starts = reached.select("g__", "i__", F.lit(1).alias("opens__"))
    marked = summed.join(starts, ["g__", "i__"], "left")
    return scans.scan(marked, ["g__"], ["i__"], {"n__": scans.running_sum(F.col("opens__"))}).withColumn("batch", (F.col("n__") - 1).cast("int"))


def within_budget(rows: DataFrame, by: list[str], order: list, size: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes sum to the budget; the first row always stays."""
    found = scans.scan(rows, by, order, {"__sum": scans.running_sum(F.col(size)), "__n": scans.row_count()})
    return found.where((F.col("__n") == 1) | (F.col("__sum") <= budget)).drop("__sum", "__n")


def first_wins(rows: DataFrame, key: list[Column], order: list) -> DataFrame:
    """The first row of each key. Sizes don't matter: Spark keeps one row per key and task before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def numbered_globally(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 1 over all rows in order, without bringing them into one task.

    Rows are range-partitioned, sorted and written with their place in their
    partition; a number is that place plus the sizes of the partitions before,
    of which there are few. ``order`` should tell rows apart.
    """
    spark = rows.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in placed.groupBy(part).count().collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += n
    if not sizes:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__m")
    return placed.withColumn(name, F.element_at(F.create_map(*offsets), part) + place + 1).drop("__m")


def ids_by_first(rows: DataFrame, key: list[str], order: str, prefix: str = "E") -> DataFrame:
    """``key``, ``id``: distinct keys numbered from 1 in the order of their first occurrence, ties by key."""
    first = rows.groupBy(*key).agg(F.min(order).alias("first_pos"))
    return numbered_globally(first, ["first_pos", *key], "__n").withColumn("id", F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")


def best_version(rows: DataFrame, by: list[str], label: str, priority: dict[str, int], *then: str) -> DataFrame:
    """The row of highest (label priority, then columns) of each group; labels not listed count 0."""
    table = F.map_from_arrays(F.array(*map(F.lit, priority)), F.array(*map(F.lit, priority.values())))
    rank = F.coalesce(F.try_element_at(table, F.lower(label)), F.lit(0))
    fields = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*fields), F.struct(rank.alias("p"), *then)).alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in fields])


def chunked(rows: DataFrame, by: list[str], order: list, n: int, name: str = "chunk") -> DataFrame:
    """Fixed-size chunks of each ordered group, numbered from 0."""
    found = scans.scan(rows, by, order, {"__n": scans.row_count()})
    return found.withColumn(name, F.floor((F.col("__n") - 1) / n).cast("long")).drop("__n")


def grouped_by_first(rows: DataFrame, by: list[str], key: list[str], order: str) -> DataFrame:
    """``rows`` with ``group_no`` and ``place``: keys of each ``by`` numbered from 1 in the order of their first row, and rows of each key likewise.

    ``order`` should tell a group's rows apart. Groups and keys may have any number of rows: both numbers come from scans.
    """
    head = {"first__": scans.first_value(F.col(order)), "place": scans.row_count()}
    placed = scans.scan(rows, [*by, *key], [order], head).withColumn("first__", F.col("first__.x"))
    opens = scans.running_sum((F.col("place") == 1).cast("long"))
    return scans.scan(placed, by, ["first__", order], {"group_no": opens}).drop("first__")
