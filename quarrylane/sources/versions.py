"""Versioned tables: immutable Parquet segments and a log of versions, committed for several tables at once.

A store is a folder that all executors share. ``log/<number>.json`` names, for
every table, its schema and its segments (folders under ``data``), so that a
version is one small file and whoever holds it reads the same rows for ever. A
change writes new segments first and is committed by creating the next file of
the log, which only one writer can; another looks at the new version and, if
one of its tables has changed, plans anew. What a writer leaves that dies before its
commit is named by no version, and ``discard`` takes it away later.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIT, SEGMENT = "hit__", "segment__"


class Conflict(RuntimeError):
    """Other writers were first too often."""


@dataclass(frozen=True)
class Version:
    """Number, tables (schema and segments by name) and last batch of each stream. Version 0 has none."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Edit:
    """Segments that a table loses and gains."""

    schema: T.StructType
    lost: tuple[str, ...] = ()
    gained: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outcome:
    """The version that holds a change, and the rows it changed: as they are now, or as they were for a deletion."""

    version: Version
    changed: DataFrame


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _path(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _renamed(spark: SparkSession, a: str, b: str) -> bool:
    """Rename that refuses a target that is there; atomic where the file system's rename is."""
    source, target = _path(spark, a)[0], _path(spark, b)[0]
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    none = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, none)
        return True
    except Exception as e:
        if _path(spark, b)[1].exists(target):
            return False
        raise e


def _create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file unless it is there: a link on file systems with local paths, whose rename overwrites, else a rename."""
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    _write_text(spark, staged, text)
    at, fs = _path(spark, path)
    if fs.getUri().getScheme() != "file":
        return _renamed(spark, staged, path)
    try:
        os.link(urlparse(staged).path, urlparse(path).path)
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(_path(spark, staged)[0], False)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    at, fs = _path(spark, f"{root}/log")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def pin(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The newest version, or that of a number; a number that was never committed, or is discarded, raises."""
    numbers = _numbers(spark, root)
    if number is None:
        number = numbers[-1] if numbers else 0
    if number == 0:
        return Version()
    if number not in numbers:
        raise ValueError(f"version {number} of {root} is not there")
    return Version(**json.loads(_read_text(spark, f"{root}/log/{number:020d}.json")))


def rows(spark: SparkSession, root: str, version: Version, table: str, segments: list[str] | None = None) -> DataFrame:
    """A table as of a version; an unknown table raises."""
    if table not in version.tables:
        raise ValueError(f"table {table} is not in version {version.number}")
    known = version.tables[table]
    schema = T.StructType.fromJson(known["schema"])
    return _segments(spark, root, schema, known["segments"] if segments is None else segments)


def _segments(spark: SparkSession, root: str, schema: T.StructType, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{n}" for n in names])


def _staged(df: DataFrame, root: str) -> tuple[str, ...]:
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{name}")
    return (name,)


def commit(spark: SparkSession, root: str, plan: Callable[[Version], dict[str, Edit]], reads: tuple[str, ...] = (), batch: tuple[str, int] | None = None, attempts: int = 20) -> Version:
    """Commit what ``plan`` makes of the newest version, as one version for all its tables.

    A plan without edits commits nothing, unless there is a batch to note. If
    another writer comes first, the edits are kept where neither their tables
    nor those in ``reads`` changed, else planned anew; after ``attempts`` it
    raises. ``batch`` is a stream and the number of its batch: one that a
    version holds already is not applied again.
    """
    base = pin(spark, root)
    edits = None
    for attempt in range(attempts):
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base
        if edits is None:
            edits = plan(base)
        if not edits and not batch:
            return base
        tables = dict(base.tables)
        for name, e in edits.items():
            kept = [s for s in tables.get(name, {}).get("segments", []) if s not in e.lost]
            tables[name] = {"schema": e.schema.jsonValue(), "segments": [*kept, *e.gained]}
        new = Version(base.number + 1, tables, base.batches | ({batch[0]: batch[1]} if batch else {}))
        if _create_once(spark, f"{root}/log/{new.number:020d}.json", json.dumps(new.__dict__)):
            return new
        time.sleep(min(0.02 * 2**attempt, 1.0))
        newer = pin(spark, root)
        if any(base.tables.get(t) != newer.tables.get(t) for t in (*edits, *reads)):
            edits = None
        base = newer
    raise Conflict(f"{root}: other writers were first {attempts} times")


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in order, nulls for those that lack; a column that the table lacks raises."""
    if extra := set(df.columns) - set(schema.names):
        raise ValueError(f"columns {sorted(extra)} are not in the table")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _schema(version: Version, table: str, default: T.StructType) -> T.StructType:
    return T.StructType.fromJson(version.tables[table]["schema"]) if table in version.tables else default


def insert(spark: SparkSession, root: str, table: str, new: DataFrame) -> Outcome:
    """Append rows; the first insertion makes the table. Nothing but the new rows is read or written."""
    staged: list[tuple[T.StructType, tuple[str, ...]]] = []

    def plan(v: Version) -> dict[str, Edit]:
        schema = _schema(v, table, new.schema)
        if not staged or staged[-1][0] != schema:
            staged.append((schema, _staged(_conform(new, schema), root)))
        return {table: Edit(schema, (), staged[-1][1])}

    version = commit(spark, root, plan)
    schema, names = staged[-1]
    return Outcome(version, _segments(spark, root, schema, list(names)))


def hit_segments(spark: SparkSession, root: str, version: Version, table: str, hits: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Segments of a table with a row that ``hits`` keeps: one scan of the columns that it needs, one row a segment."""
    names = version.tables[table]["segments"]
    if not names:
        return []
    under = F.regexp_extract(F.col("_metadata.file_path"), rf"/data/([0-9a-f]{{32}}(?:/{HIT}=(?:true|false))?)/[^/]+$", 1)
    found = {r[0] for r in hits(rows(spark, root, version, table).withColumn(SEGMENT, under)).select(SEGMENT).distinct().collect()}
    return [n for n in names if n in found]


def _rewritten(spark: SparkSession, root: str, table: str, where: Column, values: dict[str, Column], keep_hits: bool) -> Outcome:
    hit = F.coalesce(where, F.lit(False))
    made: dict[str, object] = {}

    def plan(v: Version) -> dict[str, Edit]:
        schema = T.StructType.fromJson(v.tables[table]["schema"]) if table in v.tables else rows(spark, root, v, table).schema
        made.update(schema=schema, changed=[])
        lost = hit_segments(spark, root, v, table, lambda t: t.where(hit))
        if not lost:
            return {}
        flagged = rows(spark, root, v, table, lost).withColumn(HIT, hit)
        new = flagged.select(*[(F.when(F.col(HIT), values[f.name]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if f.name in values else F.col(f"`{f.name}`")) for f in schema], HIT)
        name = uuid.uuid4().hex
        new.write.partitionBy(HIT).parquet(f"{root}/data/{name}")
        there = [f"{name}/{HIT}={x}" for x in ("true", "false") if _exists(spark, f"{root}/data/{name}/{HIT}={x}")]
        made["changed"] = [n for n in there if n.endswith("true")]
        return {table: Edit(schema, tuple(lost), tuple(n for n in there if keep_hits or n.endswith("false")))}

    version = commit(spark, root, plan)
    return Outcome(version, _segments(spark, root, made["schema"], made["changed"]))


def _exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def update(spark: SparkSession, root: str, table: str, where: Column, values: dict[str, Column]) -> Outcome:
    """UPDATE with RETURNING: rows for which ``where`` is true get the values, computed from the row as it was.

    Only segments with such a row are written anew, their changed and unchanged
    rows as segments of their own; if there are none, nothing is committed.
    """
    if unknown := set(values) - set(rows(spark, root, pin(spark, root), table).columns):
        raise ValueError(f"columns {sorted(unknown)} are not in the table")
    return _rewritten(spark, root, table, where, values, True)


def delete(spark: SparkSession, root: str, table: str, where: Column) -> Outcome:
    """DELETE with RETURNING; rows for which ``where`` is null stay."""
    return _rewritten(spark, root, table, where, {}, False)


def replace(spark: SparkSession, root: str, snapshots: dict[str, DataFrame], allow_empty: bool = False) -> Version:
    """Replace several tables by validated snapshots in one version; an empty one is refused unless allowed."""
    staged = {t: _staged(df, root) for t, df in snapshots.items()}
    if not allow_empty and (empty := [t for t, df in snapshots.items() if _segments(spark, root, df.schema, list(staged[t])).isEmpty()]):
        raise ValueError(f"empty snapshots: {empty}")
    return commit(spark, root, lambda v: {t: Edit(df.schema, tuple(v.tables.get(t, {}).get("segments", ())), staged[t]) for t, df in snapshots.items()})


def replaced_by_key(spark: SparkSession, root: str, version: Version, table: str, key: str, gone: DataFrame | None, fresh: DataFrame) -> Edit:
    """The edit that takes all rows of the keys in ``gone`` out of a table and adds ``fresh``; for a plan of ``commit``.

    ``gone`` has distinct keys. Segments without one of them stay as they are.
    """
    schema = _schema(version, table, fresh.schema)
    gained = _staged(_conform(fresh, schema), root)
    if gone is None or table not in version.tables:
        return Edit(schema, (), gained)
    lost = hit_segments(spark, root, version, table, lambda t: t.select(key, SEGMENT).join(gone, key, "left_semi"))
    if lost:
        gained += _staged(rows(spark, root, version, table, lost).join(gone, key, "left_anti").select(*schema.names), root)
    return Edit(schema, tuple(lost), gained)


def compact(spark: SparkSession, root: str, table: str) -> Version:
    """One segment in the place of all of a table's."""

    def plan(v: Version) -> dict[str, Edit]:
        all_rows, names = rows(spark, root, v, table), v.tables[table]["segments"]
        return {table: Edit(all_rows.schema, tuple(names), _staged(all_rows, root))} if len(names) > 1 else {}

    return commit(spark, root, plan)


def discard(spark: SparkSession, root: str, keep: int = 1, min_age_s: float = 86_400) -> list[str]:
    """Delete all but the newest ``keep`` versions and the segments that no kept one names; returns the latter.

    Folders younger than ``min_age_s`` stay, as their writer may be about to
    commit. Readers of a version that goes fail, so keep those in use.
    """
    numbers = _numbers(spark, root)
    held = {s for n in numbers[-keep:] for t in pin(spark, root, n).tables.values() for s in t["segments"]}
    for n in numbers[:-keep]:
        at, fs = _path(spark, f"{root}/log/{n:020d}.json")
        fs.delete(at, False)
    at, fs = _path(spark, f"{root}/data")
    before, gone = (time.time() - min_age_s) * 1000, []
    for s in fs.listStatus(at) if fs.exists(at) else []:
        name = s.getPath().getName()
        parts = [c.getPath() for c in fs.listStatus(s.getPath()) if c.getPath().getName().startswith(f"{HIT}=")]
        for p, label in [(p, f"{name}/{p.getName()}") for p in parts] or [(s.getPath(), name)]:
            if label not in held and s.getModificationTime() <= before:
                fs.delete(p, True)
                gone.append(label)
    return sorted(gone)
