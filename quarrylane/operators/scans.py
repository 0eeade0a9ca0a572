"""Scans over ordered groups of any size: running values whose groups are cut over tasks.

Rows are range-partitioned by (group, order), so a large group is spread over
many parts, and written once with the part and place of each row. A window
within (part, group) gives the value in the part; what comes from the parts before, the
carry, is one row for each part of a group that lies in several. Such groups
are the first or last of a part, so carries are at most two a part, and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarrylane.session import written

PART, PLACE = "part__", "place__"


@dataclass(frozen=True)
class Scan:
    """An associative running value: in a part, of a whole part, over the parts before, and both together (a null carry: no part before)."""

    local: Callable[[WindowSpec], Column]
    total: Column
    before: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def running_sum(x: Column) -> Scan:
    """Sum up to and with the row; null counts as 0."""
    x, zero = F.coalesce(x, F.lit(0)), F.lit(0)
    return Scan(lambda w: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(x), F.sum, lambda own, carry: own + F.coalesce(carry, zero))


def row_count() -> Scan:
    """Number of the row, from 1."""
    return running_sum(F.lit(1).cast("long"))


def previous(x: Column) -> Scan:
    """The row before's value in a struct ``x``; null for the first row."""
    held = F.struct(x.alias("x"))
    return Scan(lambda w: F.lag(held).over(w), F.max_by(held, PLACE), F.last, lambda own, carry: F.coalesce(own, carry))


def first_value(x: Column) -> Scan:
    """The group's first value in a struct ``x``."""
    held = F.struct(x.alias("x"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    return Scan(lambda w: F.first(held).over(up_to(w)), F.min_by(held, PLACE), F.first, lambda own, carry: F.coalesce(carry, own))


def spread(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The rows as a written table with ``part__`` and ``place__``; places ascend with (group, order) over all rows.

    ``order`` should tell a group's rows apart: equal ones share a part, and keep the order in which they are written.
    """
    return written(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(PLACE, F.monotonically_increasing_id())).withColumn(
        PART, F.shiftright(PLACE, 33)
    )


def spanning(placed: DataFrame, by: list[str]) -> DataFrame:
    """Groups that lie in more than one part; there are fewer of them than parts."""
    group = F.struct(*by)
    ends = placed.groupBy(PART).agg(F.min_by(group, PLACE).alias("a"), F.max_by(group, PLACE).alias("b"))
    return ends.select(PART, F.explode(F.array_distinct(F.array("a", "b"))).alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g.*")


def same(by: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Equality of groups, nulls included."""
    both = F.lit(True)
    for c in by:
        both &= left[c].eqNullSafe(right[c])
    return both


def scan(rows: DataFrame, by: list[str], order: list, outputs: dict[str, Scan]) -> DataFrame:
    """``rows`` with a running value per output, over each group of ``by`` in ``order``. Null is a group of its own; an empty table stays empty."""
    clash = {PART, PLACE, *outputs} & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    placed = spread(rows, by, order)
    names = list(outputs)
    split = F.broadcast(spanning(placed, by))
    totals = placed.join(split, same(by, placed, split), "left_semi").groupBy(*by, PART).agg(*[outputs[n].total.alias(f"{n}__s") for n in names])
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(*by, PART, *[outputs[n].before(F.col(f"{n}__s")).over(earlier).alias(f"{n}__c") for n in names])
    within = Window.partitionBy(PART, *by).orderBy(PLACE)
    local = placed.withColumns({f"{n}__l": outputs[n].local(within) for n in names})
    met = local.join(F.broadcast(carries), (local[PART] == carries[PART]) & same(by, local, carries), "left")
    return met.select(*[local[c] for c in rows.columns], *[outputs[n].both(local[f"{n}__l"], carries[f"{n}__c"]).alias(n) for n in names])
