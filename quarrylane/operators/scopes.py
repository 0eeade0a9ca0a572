"""Scope predicates: aliases, memberships, whitelists, completeness, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators import ordering


def low(c: Column) -> Column:
    """Trimmed lower-case elements of an array; nulls and blanks left out."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))


def bank_matches(wanted: Column, ident: Column, symbol: Column, name: Column, aliases: Column, tags: Column) -> Column:
    """Whether any of the wanted names is the bank's id, symbol, name, an alias or a tag, without regard to case."""
    return F.arrays_overlap(low(wanted), low(F.concat(F.array(ident.cast("string"), symbol, name), F.coalesce(aliases, F.array().cast("array<string>")), F.coalesce(tags, F.array().cast("array<string>")))))


def listed(c: Column) -> Column:
    """An array column from text such as ``{a,b}``."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "[{}\"]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_member(names: Column, one: Column) -> Column:
    return F.array_contains(low(names), F.lower(F.trim(one)))


def whitelisted(sources: Column, allowed: list[str]) -> Column:
    """Distinct allowed sources in the order asked for."""
    table = F.array(*map(F.lit, allowed))
    return F.array_distinct(F.filter(low(sources), lambda s: F.array_contains(table, s)))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in fields.items()]))


def metric_matches(a: Column, b: Column) -> Column:
    """Whether either name holds the other, without regard to case."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def catalog_filter(catalog: DataFrame, ids: list[str] | None, key: str = "database_id") -> DataFrame:
    """The entries asked for; all of them where none are. Ids that the catalog doesn't have are left out."""
    return catalog.where(F.col(key).isin(*ids)) if ids else catalog


def all_completed(items: DataFrame, by: str, done: str) -> DataFrame:
    """Groups all of whose items are done, and how many are."""
    return items.groupBy(by).agg(F.count_if(done).alias("completed"), F.count("*").alias("items"), F.bool_and(F.coalesce(done, F.lit(False))).alias("all_done"))


def consensus(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The group's one value, or ``mixed``."""
    least, most = F.min(value), F.max(value)
    return rows.groupBy(by).agg(F.when(least == most, least).otherwise("mixed").alias("consensus"))


def free_ids(rows: DataFrame, taken: DataFrame, order: str, prefix: str = "C") -> DataFrame:
    """Rows in order with the smallest ids ``C1``, ``C2``, ... that are not taken.

    The k-th free number is at most k plus the numbers taken, so free numbers
    are found by an anti-join and met by rank; both ranks come from range
    partitions, not from one task.
    """
    number = F.regexp_extract("id", rf"^{prefix}(\d+)$", 1).try_cast("long")
    used = taken.select(number.alias("n")).where("n > 0").distinct()
    top = rows.count() + used.count()
    free = rows.sparkSession.range(1, top + 1).toDF("n").join(used, "n", "left_anti")
    ranked = ordering.numbered_globally(free, ["n"], "__k")
    return ordering.numbered_globally(rows, [order], "__k").join(ranked, "__k").withColumn("id", F.concat(F.lit(prefix), F.col("n").cast("string"))).drop("__k", "n")


def zipped(categories: Column, values: Column) -> Column:
    """Pairs of a chart's categories and values, blanks where one list is shorter."""
    return F.transform(F.arrays_zip(categories.alias("c"), values.alias("v")), lambda x: F.struct(F.coalesce(x["c"], F.lit("")).alias("category"), F.coalesce(x["v"].cast("string"), F.lit("")).alias("value")))
