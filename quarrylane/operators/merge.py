"""Change capture, merges, integrity checks and copy-on-write updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priority of transcript versions.
VERSION_PRIORITY = {"corrected": 50, "e1": 45, "earnings": 45, "final": 40, "script": 30, "raw": 20}


def manifest_diff(incoming: DataFrame, master: DataFrame, key: str, digest: str, source: str | None = None) -> DataFrame:
    """``key``, ``process`` (boolean), ``remove_reason`` (null, modified or removed) for keys that changed, and unchanged ones with neither.

    Only master rows of ``source`` can be removed.
    """
    old = master.select(F.col(key).alias("__k"), F.col(digest).alias("__d"), *([F.col("source")] if source else []))
    if source:
        old = old.where(F.col("source") == source).drop("source")
    both = incoming.select(key, digest).join(old, F.col(key) == F.col("__k"), "full_outer")
    new, gone = F.col("__k").isNull(), F.col(key).isNull()
    changed = ~new & ~gone & ~F.col(digest).eqNullSafe(F.col("__d"))
    return both.select(
        F.coalesce(key, "__k").alias(key), (new | changed).alias("process"), F.when(gone, "removed").when(changed, "modified").alias("remove_reason")
    )


def master_merge(master: DataFrame, fresh: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """Master rows whose key is neither in ``fresh`` nor in ``removed``, then the fresh rows."""
    drop = fresh.select(key)
    if removed is not None:
        drop = drop.union(removed.select(key))
    return master.join(drop.distinct(), key, "left_anti").unionByName(fresh)


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Child rows without a parent; a null key has none."""
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def list_orphans(child: DataFrame, key: str, members: str, parent: DataFrame, on: str) -> DataFrame:
    """``key``, ``member`` for each distinct member of a child's list that no parent has; a null member has none."""
    each = child.select(key, F.explode(F.array_distinct(members)).alias("member"))
    return each.join(parent.select(F.col(on).alias("member")).distinct(), "member", "left_anti").select(key, "member")


def upsert_union(target: DataFrame, rows: DataFrame, key: list[str], union: str) -> DataFrame:
    """Update or insert by key: the array ``union`` becomes the sorted union of both sides, other columns are the new row's."""
    fields = [c for c in target.columns if c not in key and c != union]
    old = target.select(*[F.col(c).alias(f"__o_{c}") for c in target.columns])
    same = [F.col(k) == F.col(f"__o_{k}") for k in key]
    both = rows.withColumn("__new", F.lit(True)).join(old, same, "full_outer")
    empty = F.array().cast(target.schema[union].dataType)
    return both.select(
        *[F.coalesce(k, f"__o_{k}").alias(k) for k in key],
        *[F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__o_{c}")).alias(c) for c in fields],
        F.array_sort(F.array_union(F.coalesce(union, empty), F.coalesce(f"__o_{union}", empty))).alias(union),
    ).select(*target.columns)


def update_or_insert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of equal key; others stay."""
    return target.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def updated(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Copy-on-write UPDATE."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def deleted(target: DataFrame, where: Column) -> DataFrame:
    """Copy-on-write DELETE; rows for which the condition is null stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def latest(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The row of each group with the largest ``order`` columns: one aggregation with a partial step, no window."""
    fields = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in fields])


def groupwise_max(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """All rows that hold their group's largest value, ties kept."""
    return rows.withColumn("__m", F.max(value).over(Window.partitionBy(*by))).where(F.col(value) == F.col("__m")).drop("__m")


def inserted(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Copy-on-write INSERT: columns that the new rows lack are null."""
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def finite_vector(c: Column, size: int) -> Column:
    """Whether a vector has so many components, none null or infinite or not a number."""
    return (F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def timestamp_text(c: Column) -> Column:
    """Whether a text is a timestamp."""
    return c.try_cast("timestamp").isNotNull()


def validation_errors(checks: dict[str, Column]) -> Column:
    """Sorted names of the checks that fail; a null outcome fails."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])))


def availability(chunks: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Sources that have rows for each key, as a sorted array."""
    return chunks.select(*keys, source).distinct().groupBy(*keys).agg(F.array_sort(F.collect_set(source)).alias("database_names"))


def availability_lookup(combos: DataFrame, table: DataFrame, on: list[str], source: str, names: str = "database_names") -> DataFrame:
    """Combos with ``available``: whether a row of equal key lists the source; false without a row. Repeated rows of a key count as one."""
    listed = table.groupBy(*on).agg(F.array_distinct(F.flatten(F.collect_list(names))).alias(names))
    return combos.join(listed, on, "left").withColumn("available", F.coalesce(F.array_contains(names, F.col(source)), F.lit(False))).drop(names)


def names_of(*names: Column, lists: tuple[Column, ...] = ()) -> Column:
    """Distinct names in lower case out of single values and lists of them; nulls and blank names are left out."""
    none = F.array().cast("array<string>")
    every = F.concat(F.array(*[n.cast("string") for n in names]), *[F.coalesce(x.cast("array<string>"), none) for x in lists])
    return F.array_distinct(F.transform(F.filter(every, lambda n: n.isNotNull() & (F.trim(n) != "")), F.lower))


def availability_by_overlap(combos: DataFrame, table: DataFrame, on: list[str], wanted: Column, offered: Column, source: str, position: str, hydrate: list[str], names: str = "database_names") -> DataFrame:
    """Every combo with ``available``, and with the ``hydrate`` columns of the first row by ``position`` that answers it.

    A row answers if it is equal in ``on``, lists the combo's ``source`` (case
    and outer blanks apart) and shares a name with it: ``wanted`` and
    ``offered`` are arrays of names (see ``names_of``). Overlap of sets is an
    equality join on one name: the table becomes an index with the first row of
    each (``on``, source, name), and a combo takes the first of its names'
    rows. A null in the row found leaves the combo's own value, if it has the
    column; repeated combos stay rows of their own.
    """
    first = F.min(F.struct("__pos", *hydrate))
    rows = table.select(*on, F.col(position).alias("__pos"), *hydrate, F.explode(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))).alias("__source"), offered.alias("__names"))
    index = rows.select(*on, "__source", F.explode("__names").alias("__name"), "__pos", *hydrate).groupBy(*on, "__source", "__name").agg(first.alias("__row"))
    numbered = combos.withColumn("__id", F.monotonically_increasing_id())
    asked = numbered.select("*", F.lower(F.trim(F.col(source))).alias("__source"), F.explode_outer(wanted).alias("__name"))
    met = asked.join(index, [*on, "__source", "__name"], "left")
    found = met.groupBy("__id", *combos.columns).agg(F.min("__row").alias("__row"))
    kept = [c for c in combos.columns if c not in hydrate]
    own = {c: F.coalesce(F.col(f"__row.{c}"), F.col(c)) if c in combos.columns else F.col(f"__row.{c}") for c in hydrate}
    return found.select(*kept, *[c.alias(n) for n, c in own.items()], F.col("__row").isNotNull().alias("available"))
