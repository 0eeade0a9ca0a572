"""New and changed files as a stream into versioned tables: each batch is one commit, applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylane.session import written
from quarrylane.sources import versions
from quarrylane.sources.files import PATH_RULE

MANIFEST = "manifest"
Parser = Callable[[DataFrame], dict[str, DataFrame]]


def file_stream(spark: SparkSession, root: str, files_a_batch: int = 1000) -> DataFrame:
    """Files under ``<root>/<delivery>/<YYYY_QX>/<bank>/<file>`` as they arrive: ``file_key`` (the part after the delivery), ``file_hash``, ``arrived``, ``content``.

    A file stream takes a path once, so a changed file comes in a later delivery.
    Strays, and names that start with a dot or ``~$``, are ignored; so are empty files, which Spark's file sources don't list.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(root)
    part = lambda i: F.regexp_extract("path", PATH_RULE, i)
    key = F.concat(part(1), F.lit("_"), part(2), F.lit("/"), part(3), F.lit("/"), part(4))
    good = files.where((part(1) != "") & ~part(4).rlike(r"^(\.|~\$)"))
    return good.select(key.alias("file_key"), F.sha2("content", 256).alias("file_hash"), F.struct("modificationTime", "path").alias("arrived"), "content")


def apply_batch(files: DataFrame, batch_id: int, root: str, parse: Parser, stream: str = "files") -> versions.Version:
    """One batch of files (``file_key``, ``file_hash``, ``arrived``, more) as one version of the manifest and the parsed tables.

    The last arrival of a key counts, within a batch and over all of them: one
    that is no later than the manifest's is left out, so that batches may come in
    any order. A null key is left out. Of the others those with a new hash go to ``parse``,
    with all their columns; it returns tables with a ``file_key`` column, whose
    rows take the place of the file's earlier ones. The version notes the batch, so
    that a batch run again, after whatever failure, changes nothing. Removals can't be seen by a
    stream: find them with ``merge.manifest_diff`` and drop them with ``retire``.
    """
    spark = files.sparkSession
    fields = [c for c in files.columns if c not in ("file_key", "arrived")]
    newest = files.where("file_key is not null").groupBy("file_key").agg(F.max_by(F.struct(*fields, "arrived"), "arrived").alias("f"))
    last = newest.select("file_key", "f.*")

    def plan(v: versions.Version) -> dict[str, versions.Edit]:
        incoming = last.select("file_key", "file_hash", "arrived")
        master = versions.rows(spark, root, v, MANIFEST) if MANIFEST in v.tables else spark.createDataFrame([], incoming.schema)
        was = master.select("file_key", F.col("file_hash").alias("was_hash"), F.col("arrived").alias("was_arrived"))
        later = F.col("was_arrived").isNull() | (F.col("arrived") > F.col("was_arrived"))
        process = F.col("was_arrived").isNull() | ~F.col("file_hash").eqNullSafe(F.col("was_hash"))
        met = incoming.join(was, "file_key", "left").where(later)
        decided = written(met.select("file_key", "file_hash", "arrived", process.alias("process"), F.col("was_arrived").isNotNull().alias("seen")))
        counts = decided.agg(F.count("*"), F.count_if("seen"), F.count_if(F.col("seen") & F.col("process")), F.count_if("process")).head()
        n, seen, modified, changed = counts
        if not n:
            return {}
        gone = lambda where, any_: decided.where(where).select("file_key") if any_ else None
        edits = {MANIFEST: versions.replaced_by_key(spark, root, v, MANIFEST, "file_key", gone("seen", seen), decided.select("file_key", "file_hash", "arrived"))}
        if changed:
            new = last.join(decided.where("process").select("file_key"), "file_key", "left_semi")
            for t, df in parse(new).items():
                edits[t] = versions.replaced_by_key(spark, root, v, t, "file_key", gone("seen and process", modified), df)
        return edits

    return versions.commit(spark, root, plan, reads=(MANIFEST,), batch=(stream, batch_id))


def retire(spark: SparkSession, root: str, keys: DataFrame, tables: tuple[str, ...]) -> versions.Version:
    """Take the files with these distinct keys out of the manifest and the tables, in one version."""

    def plan(v: versions.Version) -> dict[str, versions.Edit]:
        there = [t for t in (MANIFEST, *tables) if t in v.tables]
        return {t: versions.replaced_by_key(spark, root, v, t, "file_key", keys, versions.rows(spark, root, v, t, [])) for t in there}

    return versions.commit(spark, root, plan)


def upsert_batch(rows: DataFrame, batch_id: int, root: str, table: str, key: str, stream: str) -> versions.Version:
    """One batch of a stream in update mode: its rows take the place of those of equal ``key``, in one version, once."""

    def plan(v: versions.Version) -> dict[str, versions.Edit]:
        fresh = written(rows)
        return {} if fresh.isEmpty() else {table: versions.replaced_by_key(rows.sparkSession, root, v, table, key, fresh.select(key), fresh)}

    return versions.commit(rows.sparkSession, root, plan, batch=(stream, batch_id))


def run_incremental(files: DataFrame, root: str, checkpoint: str, parse: Parser, stream: str = "files") -> StreamingQuery:
    """Apply what has arrived, batch by batch, and stop."""
    return files.writeStream.foreachBatch(lambda df, i: apply_batch(df, i, root, parse, stream) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
