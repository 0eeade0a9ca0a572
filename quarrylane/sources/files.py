"""File sources: folder scans, strict CSV, manifests, JSON lines, and sinks that replace a table as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATH_RULE = r"/(20\d{2})_(Q[1-4])/([^/]+)/([^/]+)$"


def scan_folder(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files under ``<root>/<YYYY_QX>/<bank>/<file>``: period, bank, name, size, mtime, SHA-256; ``error`` for strays.

    Names that start with a dot or ``~$`` are ignored. Without ``content`` the bytes are hashed and dropped in the scan's stage.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.regexp_extract("path", PATH_RULE, i)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(~name.rlike(r"^(\.|~\$)")).select(
        "path",
        F.nullif(part(1), F.lit("")).try_cast("int").alias("year"),
        F.nullif(part(2), F.lit("")).alias("quarter"),
        F.nullif(part(3), F.lit("")).alias("bank"),
        name.alias("filename"),
        F.col("length").alias("size"),
        F.date_format(F.col("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"),
        F.sha2("content", 256).alias("file_hash"),
        F.when(part(1) == "", F.lit("stray file")).alias("error"),
        *([F.col("content")] if content else []),
    )


def one_file_per_bank(files: DataFrame, extension: str) -> DataFrame:
    """Periods and banks that don't have exactly one file, or one of another kind, with what is wrong."""
    kind = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    counted = files.where("error is null").groupBy("year", "quarter", "bank").agg(F.count("*").alias("n"), F.count_if(kind == extension.lower()).alias("right"))
    problem = F.when(F.col("n") > 1, "more than one file").when(F.col("right") == 0, "wrong kind of file")
    return counted.withColumn("problem", problem).where("problem is not null").drop("right")


# Names of the master files.
MASTER_DATA, MASTER_MANIFEST = "master-data.csv", "master-manifest.json"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def master_files(spark: SparkSession, root: str) -> bool:
    """Whether both master files are there; one without the other is an error."""
    there = {name: _exists(spark, f"{root}/{name}") for name in (MASTER_DATA, MASTER_MANIFEST)}
    if any(there.values()) != all(there.values()):
        found, missing = sorted(there, key=there.get, reverse=True)
        raise ValueError(f"incomplete master: found only {found}, {missing} is missing")
    return all(there.values())


def previous_master(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the last master table; none where the file is missing or blank."""
    if not _exists(spark, path) or not spark.read.text(path).where("trim(value) <> ''").limit(1).count():
        return spark.createDataFrame([], schema)
    return strict_csv(spark, path, schema)[0]


def strict_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV files, each with exactly the schema's header; rows that don't parse are errors with their text.

    Every file's first line is compared, in one pass over the lines of the files' first blocks.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("line"))
    cells = F.transform(F.split(F.rtrim("line"), ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    if wrong := first.where(cells != F.array(*map(F.lit, schema.names))).select("path", cells.alias("found")).limit(1).collect():
        raise ValueError(f"header of {wrong[0].path} is {wrong[0].found}; expected {schema.names}")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"header": "true", "multiLine": "true", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "enforceSchema": "true"}
    rows = spark.read.options(**options).schema(wide).csv(path)
    # Spark refuses to read the corrupt column alone, so both sides look at a field too.
    field = F.coalesce(F.col(f"`{schema.names[0]}`").cast("string"), F.lit("")) >= ""
    bad = F.col("_corrupt").isNotNull()
    return rows.where(~bad & field).drop("_corrupt"), rows.where(bad & field).select(F.col("_corrupt").alias("record"))


MANIFEST = "file_id string, source string, file_hash string, filename string, modified_at string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Master manifest JSON: a list, or an object with ``files``; older field names are taken too; a repeated id is an error."""
    body = F.trim(F.col("value"))
    raw = spark.read.text(path, wholetext=True).select(body.alias("value")).where("value <> ''")
    record = "array<struct<file_id:string,source:string,source_type:string,data_source:string,file_hash:string,filename:string,source_filename:string,modified_at:string>>"
    as_list = F.when(F.col("value").startswith("["), F.from_json("value", record)).otherwise(F.from_json("value", f"struct<files:{record}>")["files"])
    present = lambda *names: F.coalesce(*[F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names])
    out = raw.select(F.explode(as_list).alias("r")).select(
        "r.file_id", present("source", "source_type", "data_source").alias("source"), "r.file_hash", present("filename", "source_filename").alias("filename"), "r.modified_at"
    )
    if repeated := out.groupBy("file_id").count().where("count > 1").limit(1).collect():
        raise ValueError(f"manifest repeats {repeated[0].file_id}")
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines; blank lines are skipped, and errors carry their text."""
    wide = f"{schema}, _corrupt string"
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"), "value")
    return lines.where("r._corrupt is null").select("r.*").drop("_corrupt"), lines.where("r._corrupt is not null").select(F.col("value").alias("record"))


def csv_cell(c: Column, kind: T.DataType) -> Column:
    """Cell text of a value: compact JSON for nested values and booleans, blank for null and empty arrays, no NUL."""
    if isinstance(kind, T.ArrayType):
        c = F.when(F.size(c) > 0, F.to_json(c)).otherwise("")
    elif isinstance(kind, (T.StructType, T.MapType)):
        c = F.to_json(c)
    else:
        c = c.cast("string")
    return F.coalesce(F.translate(c, "\0", ""), F.lit(""))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV parts with a header, replaced as a whole; Spark commits them only when all are written."""
    rows = df.orderBy(*order) if order else df
    rows.select(*[csv_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).write.mode("overwrite").option("header", "true").option("escape", '"').option("lineSep", "\n").csv(path)


def refresh_snapshot(df: DataFrame, table: str, allow_empty: bool = False, apply: bool = True) -> int:
    """Replace a table by a validated snapshot: staged first, counted, then swapped by renaming. Returns its rows.

    An empty snapshot is refused unless allowed; without ``apply`` nothing is replaced.
    """
    spark = df.sparkSession
    staging = f"{table}_staging_{uuid.uuid4().hex[:8]}"
    df.write.format("parquet").saveAsTable(staging)
    try:
        n = spark.table(staging).count()
        if not n and not allow_empty:
            raise ValueError(f"snapshot for {table} is empty")
        if apply:
            old = f"{table}_old_{uuid.uuid4().hex[:8]}"
            exists = spark.catalog.tableExists(table)
            if exists:
                spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
            spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
            if exists:
                spark.sql(f"DROP TABLE {old}")
        return n
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")


def manifest_counts(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest with the number of rows of each file, 0 for a file without any."""
    return files.join(rows.groupBy("file_id").agg(F.count("*").alias("row_count")), "file_id", "left").na.fill(0, ["row_count"])


def refresh_snapshots(snapshots: dict[str, DataFrame], allow_empty: bool = False) -> dict[str, int]:
    """Replace several tables together: all are staged and counted before any is swapped, and a swap that fails puts back those done.

    Each table is away for the moment between its two renames.
    """
    spark = next(iter(snapshots.values())).sparkSession
    mark = uuid.uuid4().hex[:8]
    staging, old = ({t: f"{t}_{what}_{mark}" for t in snapshots} for what in ("staging", "old"))
    rename = lambda a, b: spark.sql(f"ALTER TABLE {a} RENAME TO {b}")
    try:
        for t, df in snapshots.items():
            df.write.format("parquet").saveAsTable(staging[t])
        counts = {t: spark.table(staging[t]).count() for t in snapshots}
        if not allow_empty and (empty := [t for t, n in counts.items() if not n]):
            raise ValueError(f"empty snapshots: {empty}")
        done: list[tuple[str, bool]] = []
        try:
            for t in snapshots:
                there = spark.catalog.tableExists(t)
                if there:
                    rename(t, old[t])
                done.append((t, there))
                rename(staging[t], t)
        except Exception:
            for t, there in reversed(done):
                spark.sql(f"DROP TABLE IF EXISTS {t}")
                if there:
                    rename(old[t], t)
            raise
        for t, there in done:
            if there:
                spark.sql(f"DROP TABLE {old[t]}")
        return counts
    finally:
        for t in snapshots:
            spark.sql(f"DROP TABLE IF EXISTS {staging[t]}")


def create_tables(spark: SparkSession, schemas: dict[str, T.StructType], storage: str = "parquet") -> list[str]:
    """Create the tables that don't exist; returns their names. If one can't be made, those made before it go again."""
    made = [name for name in schemas if not spark.catalog.tableExists(name)]
    for i, name in enumerate(made):
        try:
            _create(spark, name, schemas[name], storage)
        except Exception:
            for earlier in made[:i]:
                spark.sql(f"DROP TABLE `{earlier}`")
            raise
    return made


def _create(spark: SparkSession, name: str, schema: T.StructType, storage: str) -> None:
    spark.sql(f"CREATE TABLE `{name}` ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}) USING {storage}")


def latest_by_position(rows: DataFrame, key: str) -> DataFrame:
    """Last row of each key in file order, for logs that append corrections."""
    w = Window.partitionBy(key).orderBy(F.desc("position"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
