"""Progress events: status fold, snapshots, change detection and marker parsing, for batches and streams.

The fold is written as an aggregate, not as a loop over an ordered list: of a
key's events only the last one and the last overwriting one matter. So it
combines before the shuffle, holds two events per key, and runs unchanged on a
stream in update mode.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.operators import scans

# Status that a stage sets, and whether it does so whatever the status is.
OVERWRITES = {"source_queued": "pending", "availability_checked": "checking", "research_started": "in_progress", "research_strategy": "in_progress"}
YIELDS = {"partial_availability": "checking", "combo_complete": "in_progress", "combo_incomplete": "incomplete"}
COMPLETIONS = {"error": "error", "no_available_data": "unavailable", "partial_success": "partial", "success": "complete"}
TERMINAL = ("complete", "partial", "unavailable", "error")
# Stages that say that data is absent or that work on a label ends, statuses that start work, and the digest's sentences.
ABSENT, ENDS, STARTS = ("partial_availability", "no_available_data"), ("combo_complete", "combo_incomplete"), ("started", "running")
NOTE_LENGTH = 260
DIGEST = {
    "unavailable": "Unavailable data:",
    "active": "Research in progress for",
    "completed": "Completed research for",
    "incomplete": "Incomplete findings for",
}
MARKER_START, MARKER_END = "[[CHART_SLOT:", "]]"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))), key)


def event_status(stage: Column, result: Column) -> Column:
    """Status that an event asks for; null for stages that set none."""
    done = F.coalesce(_lookup(COMPLETIONS, result), F.lit("complete"))
    other = F.when(result == "error", "error")
    return F.when(stage == "source_complete", done).otherwise(F.coalesce(_lookup(OVERWRITES, stage), _lookup(YIELDS, stage), other))


def fold_status(events: DataFrame, key: str, order: list[str], stage: str = "stage", result: str = "status") -> DataFrame:
    """``key``, ``status``, ``n_events``, ``updated_at``: each key's status after its events in order.

    Events of ``YIELDS`` don't change a terminal status; all others overwrite.
    Without any event that sets a status it is pending.
    """
    asked, place = event_status(F.col(stage), F.col(result)), F.struct(*order)
    soft = F.col(stage).isin(*YIELDS)
    tagged = events.select(key, *order, asked.alias("__s"), soft.alias("__soft"), place.alias("__p"))
    hard = F.when(F.col("__s").isNotNull() & ~F.col("__soft"), F.col("__p"))
    soft_at = F.when(F.col("__s").isNotNull(), F.col("__p"))
    folded = tagged.groupBy(key).agg(
        F.max_by("__s", hard).alias("hard"), F.max_by("__s", soft_at).alias("last"), F.count("*").alias("n_events"), F.max(order[0]).alias("updated_at")
    )
    status = F.when(F.col("hard").isin(*TERMINAL), F.col("hard")).otherwise(F.coalesce("last", F.lit("pending")))
    return folded.select(key, status.alias("status"), "n_events", "updated_at")


def snapshot(statuses: DataFrame) -> DataFrame:
    """One row: sources, those done, and the counts by status that a headline needs."""
    done = F.col("status").isin(*TERMINAL)
    return statuses.agg(F.count("*").alias("sources"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("n_events").alias("events"))


def changes(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, the first row of each group included."""
    found = scans.scan(rows, by, order, {"__before": scans.previous(F.col(value))})
    changed = F.col("__before").isNull() | ~F.col(value).eqNullSafe(F.col("__before.x"))
    return found.where(changed).drop("__before")


def label_states(events: DataFrame, key: str, label: str, order: list[str], stage: str = "stage", status: str = "status") -> DataFrame:
    """``key``, ``label`` and what holds of each: ``unavailable``, ``completed``, ``incomplete``, ``active``.

    The first three hold once an event has said so. A label is active if the last
    of its events that start or end work starts it. Events without a label
    are left out. One aggregation of a row a label, in batch or on a stream in update mode.
    """
    what = F.coalesce(F.col(stage), F.lit(""))
    absent, ends = what.isin(*ABSENT), what.isin(*ENDS)
    starts = ~absent & ~ends & F.coalesce(F.col(status).isin(*STARTS), F.lit(False))
    tagged = events.where(F.col(label).isNotNull()).select(key, label, F.coalesce(absent, F.lit(False)).alias("__u"), what.alias("__w"), F.coalesce(starts, F.lit(False)).alias("__a"), F.struct(*order).alias("__p"))
    says = F.when(F.col("__a") | F.col("__w").isin(*ENDS), F.col("__p"))
    once = lambda name: F.coalesce(F.max(F.col("__w") == name), F.lit(False))
    return tagged.groupBy(key, label).agg(
        F.max("__u").alias("unavailable"),
        once(ENDS[0]).alias("completed"),
        once(ENDS[1]).alias("incomplete"),
        F.coalesce(F.max_by("__a", says), F.lit(False)).alias("active"),
    )


def digest(states: DataFrame, key: str, label: str) -> DataFrame:
    """``key``, a count of labels for each of ``DIGEST`` and ``digest``: a sentence for each that has labels, in order; null if none has."""
    lists = [F.array_sort(F.collect_set(F.when(F.col(name), F.col(label).cast("string")))).alias(name) for name in DIGEST]
    found = states.groupBy(key).agg(*lists)
    said = [F.when(F.size(name) > 0, F.concat(F.lit(f"{start} "), F.array_join(name, ", "), F.lit("."))) for name, start in DIGEST.items()]
    told = F.concat_ws(" ", *said)
    return found.select(key, *[F.size(name).cast("long").alias(f"n_{name}") for name in DIGEST], F.nullif(told, F.lit("")).alias("digest"))


def last_notes(events: DataFrame, key: str, order: list[str], stage: str, message: str, n: int = 2) -> DataFrame:
    """``key`` and ``notes``: the last ``n`` messages that aren't blank of a stage, in order. Spark keeps ``n`` rows a key and task before the shuffle."""
    said = events.where((F.col("stage") == stage) & (F.trim(message) != "")).select(key, F.struct(*order).alias("__p"), text.compact(F.col(message), NOTE_LENGTH).alias("__m"))
    last = said.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__p")))).where(F.col("__n") <= n)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda x: x["__m"])
    return last.groupBy(key).agg(F.array_join(pieces, " ").alias("notes"))


def joined_deltas(deltas: DataFrame, by: list[str], order: str, piece: str) -> DataFrame:
    """Text of each call from its pieces in order; a call is one message, so its pieces fit a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(piece).alias("x")))), lambda p: p["x"])
    return deltas.groupBy(*by).agg(F.array_join(ordered, "").alias("text"), F.count("*").alias("pieces"))


@dataclass
class MarkerParser:
    """Splits streamed text into plain text and markers; holds back what may be the start of a marker."""

    buffer: str = ""
    out: list[tuple[str, str]] = field(default_factory=list)

    def feed(self, text: str) -> list[tuple[str, str]]:
        """(kind, text) pairs that are settled after this piece; kinds are text and marker."""
        self.buffer += text
        found: list[tuple[str, str]] = []
        while (start := self.buffer.find(MARKER_START)) >= 0:
            end = self.buffer.find(MARKER_END, start + len(MARKER_START))
            if start:
                found.append(("text", self.buffer[:start]))
            if end < 0:
                self.buffer = self.buffer[start:]
                return found
            found.append(("marker", self.buffer[start + len(MARKER_START) : end]))
            self.buffer = self.buffer[end + len(MARKER_END) :]
        held = next((n for n in range(min(len(MARKER_START) - 1, len(self.buffer)), 0, -1) if MARKER_START.startswith(self.buffer[-n:])), 0)
        if len(self.buffer) > held:
            found.append(("text", self.buffer[: len(self.buffer) - held]))
            self.buffer = self.buffer[len(self.buffer) - held :]
        return found

    def finish(self) -> list[tuple[str, str]]:
        """What is still held back, as text."""
        rest, self.buffer = self.buffer, ""
        return [("text", rest)] if rest else []


#: Tags of the block that an answer may begin with; callers name their own.
SHELL_OPEN, SHELL_CLOSE = "<final_shell>", "</final_shell>"


@dataclass
class LeadingBlockParser:
    """Takes an optional block off the start of streamed text; what may still become it is held back."""

    buffer: str = ""
    done: bool = False
    opening: str = SHELL_OPEN
    closing: str = SHELL_CLOSE

    def feed(self, text: str) -> list[tuple[str, str]]:
        """(kind, text) pairs that are settled after this piece: a ``shell`` (blank without a block) comes first, then ``text``."""
        if self.done:
            return [("text", text)] if text else []
        self.buffer += text
        start = self.buffer.lstrip()
        if not start or self.opening.startswith(start):
            return []
        if not start.startswith(self.opening):
            return self.finish()
        head, closed, body = start[len(self.opening) :].partition(self.closing)
        if not closed:
            return []
        self.done, self.buffer = True, ""
        return [("shell", head.strip()), *([("text", body)] if body else [])]

    def finish(self) -> list[tuple[str, str]]:
        """What is held back, as text after a blank shell."""
        if self.done or not self.buffer:
            return []
        rest, self.buffer, self.done = self.buffer, "", True
        return [("shell", ""), ("text", rest)]


def leading_block(text: Column, opening: str = SHELL_OPEN, closing: str = SHELL_CLOSE) -> Column:
    """(shell, body) of a whole text by the same rule; the shell is null where there is no whole block."""
    start = F.regexp_replace(text, r"^\s+", "")
    close = F.locate(closing, start)
    whole = start.startswith(opening) & (close > 0)
    n = len(opening)
    shell = F.trim(F.substr(start, F.lit(n + 1), close - n - 1))
    return F.struct(F.when(whole, shell).alias("shell"), F.when(whole, F.substr(start, close + len(closing))).otherwise(text).alias("body"))


def append_events(events: DataFrame, path: str) -> None:
    """Add events to the log in ``path``; what is there never changes."""
    events.write.mode("append").parquet(path)


def watch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log as a stream: each trigger brings the events added since the last, which is how a reader learns of a change."""
    return spark.readStream.schema(schema).parquet(path)


def marker_stream(pieces: DataFrame, key: str, order: str, text: str, final: str, first: int = 0, timeout_s: int | None = None) -> DataFrame:
    """Settled parts of each message of a stream: ``key``, ``kind``, ``part``, whatever order its pieces come in.

    ``order`` counts a message's pieces from ``first``; ``final`` marks the last
    one. The state is the number of the next piece, the text held back, and the
    pieces that came ahead of it; of a finished message only that it is
    finished, so that pieces which come again are left out.

    ``timeout_s``: a message of which nothing came for so long is given up: the
    pieces ahead are taken in order, what is held back is text, and the state
    goes. Streams that run on need one to bound their state; a run over what is
    there (``availableNow``) must not have one, as Spark would wait for it.
    """
    wait = None if timeout_s is None else timeout_s * 1000
    step = lambda ident, frames, state: marker_step(ident, frames, state, (key, order, text, final), first, wait)
    kind = pieces.schema[key].dataType.simpleString()
    return pieces.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, kind string, part string", "next long, buffer string, ahead string", "append", "NoTimeout" if wait is None else "ProcessingTimeTimeout"
    )


def marker_step(ident: tuple, frames: Iterator[pd.DataFrame], state, names: tuple[str, str, str, str], first: int, wait_ms: int | None) -> Iterator[pd.DataFrame]:
    """One message's new pieces, or its time-out."""
    key, order, text, final = names
    nxt, buffer, packed = state.get if state.exists else (first, "", "{}")
    ahead = {int(i): tuple(x) for i, x in json.loads(packed).items()}
    parser, rows, done = MarkerParser(buffer), [], nxt < first
    if state.hasTimedOut:
        for i in sorted(ahead):
            rows += parser.feed(ahead[i][0])
        rows += parser.finish()
        state.remove()
    else:
        for frame in frames:
            for i, t, last in zip(frame[order], frame[text], frame[final], strict=True):
                if not done and i >= nxt:
                    ahead[int(i)] = (t or "", bool(last))
        while not done and nxt in ahead:
            t, done = ahead.pop(nxt)
            rows += parser.feed(t)
            nxt += 1
        if done:
            rows += parser.finish()
            nxt, ahead = first - 1, {}
        state.update((nxt, parser.buffer, json.dumps(ahead)))
        if wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
    yield pd.DataFrame({key: [ident[0]] * len(rows), "kind": [k for k, _ in rows], "part": [p for _, p in rows]})
