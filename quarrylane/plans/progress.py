"""Queries over the event log: status fold in batch and stream, snapshots, changes, deltas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.session import scratch, table
from quarrylane.sources import versions
from quarrylane.streaming import incremental, progress

CATALOG = Catalog()

_STAGES = {"click": "source_queued", "view": "combo_complete", "signup": "partial_availability", "purchase": "source_complete", "error": "failed"}
_RESULT = "CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'partial_success' WHEN event_id % 3 = 1 THEN 'success' ELSE 'no_available_data' END"
_ASKED = "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'signup' THEN 'checking' WHEN 'error' THEN 'error' ELSE CASE event_id % 3 WHEN 0 THEN 'partial' WHEN 1 THEN 'complete' ELSE 'unavailable' END END"
FOLD_SQL = f"""e AS (SELECT user_id, ts, event_id, event_type, {_ASKED} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, arg_max(s, n) FILTER (event_type NOT IN ('view', 'signup')) AS hard, arg_max(s, n) AS last, count(*) AS n_events, max(ts) AS updated_at FROM e GROUP BY user_id),
status AS (SELECT user_id, CASE WHEN hard IN ('complete', 'partial', 'unavailable', 'error') THEN hard ELSE coalesce(last, 'pending') END AS status, n_events, updated_at FROM f)"""


def _staged(events: DataFrame) -> DataFrame:
    stage = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, _STAGES)), F.array(*map(F.lit, _STAGES.values()))), F.col("event_type"))
    return events.select("user_id", "ts", "event_id", stage.alias("stage"), F.expr(_RESULT).alias("status"))


@CATALOG.query("status_fold", f"WITH {FOLD_SQL} SELECT * FROM status")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.fold_status(_staged(table(spark, sf_dir, "events")), "user_id", ["ts", "event_id"])


@CATALOG.query("stream_status_fold", f"WITH {FOLD_SQL} SELECT user_id, status, n_events FROM status")
def stream_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold over the event log as a stream; its last state is written to the shared folder."""
    schema = table(spark, sf_dir, "events").schema
    out = f"{scratch(spark)}/{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if _is_file(spark, sf_dir) else "*.parquet").parquet(sf_dir if _is_file(spark, sf_dir) else f"{sf_dir}/events.parquet")
    folded = progress.fold_status(_staged(events), "user_id", ["ts", "event_id"])
    query = folded.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/table"))
    query.start().awaitTermination()
    return spark.read.parquet(f"{out}/table").select("user_id", "status", "n_events")


def _is_file(spark: SparkSession, sf_dir: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


@CATALOG.query("status_snapshot", f"WITH {FOLD_SQL} SELECT count(*) AS sources, count(*) FILTER (status IN ('complete', 'partial', 'unavailable', 'error')) AS completed, count(*) FILTER (status = 'error') AS errors, CAST(sum(n_events) AS BIGINT) AS events FROM status")
def status_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.snapshot(status_fold(spark, sf_dir))


@CATALOG.query("emit_on_change", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def emit_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return progress.changes(rows, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@CATALOG.query("stage_digest", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS stages, count(*) AS n FROM events GROUP BY user_id")
def stage_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("stages"), F.count("*").alias("n"))


_COMBOS = {"click": "research_started", "view": "combo_complete", "signup": "partial_availability", "purchase": "research_strategy", "error": "combo_incomplete"}
_SENTENCE = "CASE WHEN len({0}) > 0 THEN '{1} ' || array_to_string({0}, ', ') || '.' END"
_SENTENCES = ", ".join(_SENTENCE.format(name, start) for name, start in progress.DIGEST.items())
DIGEST_SQL = f"""e AS (SELECT user_id, 'combo ' || event_id % 13 AS label, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, label, bool_or(t = 'signup') AS u, bool_or(t = 'view') AS c, bool_or(t = 'error') AS i, coalesce(arg_max(t IN ('click', 'purchase'), n) FILTER (t <> 'signup'), false) AS a FROM e GROUP BY user_id, label),
l AS (SELECT user_id, coalesce(list_sort(list(label) FILTER (u)), []) AS unavailable, coalesce(list_sort(list(label) FILTER (a)), []) AS active,
  coalesce(list_sort(list(label) FILTER (c)), []) AS completed, coalesce(list_sort(list(label) FILTER (i)), []) AS incomplete FROM s GROUP BY user_id),
d AS (SELECT user_id, len(unavailable) AS n_unavailable, len(active) AS n_active, len(completed) AS n_completed, len(incomplete) AS n_incomplete, nullif(concat_ws(' ', {_SENTENCES}), '') AS digest FROM l)"""


def _combos(events: DataFrame) -> DataFrame:
    stage = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, _COMBOS)), F.array(*map(F.lit, _COMBOS.values()))), F.col("event_type"))
    label = F.concat(F.lit("combo "), (F.col("event_id") % 13).cast("string"))
    return events.select("user_id", label.alias("label"), "ts", "event_id", stage.alias("stage"), F.lit("running").alias("status"), F.col("props").alias("message"))


@CATALOG.query(
    "progress_digest",
    f"""WITH {DIGEST_SQL}, p AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events WHERE event_type = 'purchase' AND trim(props) <> ''),
    m AS (SELECT user_id, string_agg(props, ' ' ORDER BY b DESC) AS notes FROM p WHERE b <= 2 GROUP BY user_id) SELECT d.*, notes FROM d LEFT JOIN m ON d.user_id IS NOT DISTINCT FROM m.user_id""",
)
def progress_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _combos(table(spark, sf_dir, "events"))
    order = ["ts", "event_id"]
    told = progress.digest(progress.label_states(events, "user_id", "label", order), "user_id", "label")
    notes = progress.last_notes(events, "user_id", order, "research_strategy", "message").withColumnRenamed("user_id", "__k")
    return told.join(notes, F.col("user_id").eqNullSafe(F.col("__k")), "left").drop("__k")


@CATALOG.query("stream_progress_digest", f"WITH {DIGEST_SQL} SELECT * FROM d")
def stream_progress_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same digest over a stream of several batches: changed labels go to a versioned table, each batch as one commit."""
    root, at = (f"{scratch(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    table(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(at)
    events = _combos(spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 2).parquet(at))
    states = progress.label_states(events, "user_id", "label", ["ts", "event_id"])
    keyed = states.withColumn("key", F.to_json(F.struct("user_id", "label")))
    query = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{at}-state").trigger(availableNow=True)
    query.foreachBatch(lambda df, i: incremental.upsert_batch(df, i, root, "states", "key", "digest") and None).start().awaitTermination()
    return progress.digest(versions.rows(spark, root, versions.pin(spark, root), "states"), "user_id", "label")


@CATALOG.query("tool_call_deltas", "SELECT conv_id, role, string_agg(text, '' ORDER BY turn, text) AS text, count(*) AS pieces FROM conversations GROUP BY conv_id, role")
def tool_call_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.col("text").alias("piece"))
    return progress.joined_deltas(rows, ["conv_id", "role"], "turn", "piece")
