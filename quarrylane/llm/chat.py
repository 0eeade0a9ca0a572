"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; the mask marks the
characters to learn from, which are the assistant's words and the mark that ends its turn.

A conversation may hold any share of the table. Its turns are put in order by
one range sort of all turns, not by gathering it in one task, and a rendering
comes as numbered segments of at most ``SEGMENT_TURNS`` turns, whose texts in
order are the whole rendering.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.staging import staged

SEGMENT_TURNS = 64
SYSTEM = "system"
# The marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row among its partition's rows of the same conversation, which stand together."""
    part = TaskContext.get().partitionId()
    last, n = object(), 0
    for batch in batches:
        places = []
        for c in batch.column(0).to_pylist():
            n = n + 1 if c == last else 0
            last = c
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=["conv", "turn", "speaker", "text", "part", "place"])


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 0), ``speaker``, ``text``: each turn's place in its conversation by turn, speaker and text.

    Null turns come first; a null speaker is named 'unknown', a null text is empty.
    """
    clean = turns.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    keys = ["conv", "turn", "speaker", "text"]
    placed = staged(
        clean.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_numbered, "conv long, turn long, speaker string, text string, part int, place long"),
        "turns",
    )
    # Only a conversation that runs over a partition's end needs an offset: at most two per partition, a small table.
    of_conv = Window.partitionBy("conv")
    spans = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.count("*").over(of_conv).alias("parts"), before.alias("offset")).where("parts > 1 and offset > 0")
    joined = placed.join(F.broadcast(offsets), placed.conv.eqNullSafe(offsets.c) & (placed.part == offsets.p), "left")
    return joined.select("conv", (F.col("place") + F.coalesce("offset", F.lit(0).cast("long"))).alias("pos"), "speaker", "text")


def _piece(speaker: Column, text: Column, own: Column, head: bool = False) -> Column:
    """The rendered turn, or what of it comes before the text."""
    shown = F.when(own, F.lit("assistant")).when(speaker == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), speaker))
    begin = F.concat(F.lit(START), shown, F.lit("\n"))
    return begin if head else F.concat(begin, text, F.lit(END), F.lit("\n"))


def perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """One row per conversation, participant and segment: ``conv_id``, ``perspective``, ``segment`` (from 0), ``n_turns``, ``text``, ``mask``.

    ``mask`` lists (start, end) of what to learn from, in code points of the
    segment's text. Participants are the distinct speakers but ``system``; a
    conversation of system turns alone has one rendering with a null
    perspective and no mask. Marks of the format inside a text or a name are broken up
    by a space, and a name is cut at its line ends, so no text can open a turn.
    A null conversation id is a conversation of its own. Repeated turns stay.
    An empty table gives an empty result; other columns, whatever their names,
    are not looked at.
    """
    ordered = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    clean = ordered.select("conv", "pos", safe(F.translate("speaker", "\r\n", "  ")).alias("speaker"), safe(F.col("text")).alias("text"))
    # A perspective is repeated for each segment, so that turns meet it by conversation and segment: a long conversation is dealt over its segments.
    people = clean.groupBy("conv", "speaker").agg(F.max("pos").alias("last"))
    own = people.groupBy("conv").agg(F.max(F.when(F.col("speaker") != SYSTEM, 1)).alias("any"), F.max("last").alias("last"))
    ends = own.select(F.col("conv").alias("c"), F.col("last").alias("end"))
    cast = people.where(F.col("speaker") != SYSTEM).join(ends, F.col("conv").eqNullSafe(F.col("c"))).select("c", F.col("speaker").alias("perspective"), "end")
    cast = cast.unionByName(own.where("any is null").select(F.col("conv").alias("c"), F.lit(None).cast("string").alias("perspective"), F.col("last").alias("end")))
    cast = cast.select("c", "perspective", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / segment_turns).cast("long"))).alias("s"))
    turn = clean.withColumn("segment", F.floor(F.col("pos") / segment_turns).cast("long"))
    rotated = turn.join(cast, turn.conv.eqNullSafe(cast.c) & (turn.segment == cast.s))
    mine = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    pieces = rotated.select(
        "conv",
        "perspective",
        "segment",
        F.struct(
            "pos",
            _piece(F.col("speaker"), F.col("text"), mine).alias("piece"),
            F.when(mine, F.length(_piece(F.col("speaker"), F.col("text"), mine, head=True))).cast("long").alias("head"),
        ).alias("t"),
    )
    joined = pieces.groupBy("conv", "perspective", "segment").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a, t):
        size = F.length(t["piece"]).cast("long")
        span = F.array(F.struct((a["at"] + t["head"]).alias("start"), (a["at"] + size - 1).alias("end")))
        return F.struct((a["at"] + size).alias("at"), F.when(t["head"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], span)).alias("spans"))

    return joined.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        "segment",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("text"),
        F.aggregate("ts", start, step, lambda a: a["spans"]).alias("mask"),
    )
