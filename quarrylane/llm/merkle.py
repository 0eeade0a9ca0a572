"""Merkle manifest of a dataset: leaves, a root per source, one root of all, and proofs.

Digests of nodes are events. A partial parent gathers the digests of its
children by their places; its arity follows from its group's size, and the
child that completes it makes it an event in turn, so one pass over a partition
builds all ancestors whose children lie there. Children of parents that stay
open are the frontier: it is dealt anew by a higher ancestor, so that all nodes
below that meet, until nothing is open. Each parent keeps its children's
digests; these links are followed back from the root, and every node below
gets its siblings on the way up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.staging import discard, staged
from quarrylane.operators.ordering import numbered_globally

ARITY = 16
#: Levels that a deal of the frontier completes: at most ARITY**LEVELS leaves lie below what one group builds.
LEVELS = 5
#: Up to so many groups their sizes are broadcast; beyond, they are joined with salted keys.
BROADCAST_GROUPS, SALTS = 10_000, 32
HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "grp string, size long, level int, idx long, digest string, kids string, top boolean"


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value: no two lists of values read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """SHA-256, in lower-case hex, of the values' fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _width(size: int, level: int) -> int:
    """Nodes of a level."""
    return -(-size // ARITY**level)


class Partials:
    """Open parents with the digests of their children by place; in order of leaves at most 15 children a level are held."""

    def __init__(self) -> None:
        self.open: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = {}

    def add(self, grp: str, size: int, level: int, idx: int, node: str) -> Iterator[tuple]:
        """Take an event; the parents that it completes, each with its children's digests."""
        while _width(size, level) > 1:
            level, idx, place = level + 1, idx // ARITY, idx % ARITY
            key = (grp, level, idx)
            children = self.open.setdefault(key, (size, {}))[1]
            children[place] = node
            if len(children) < min(ARITY, _width(size, level - 1) - ARITY * idx):
                return
            del self.open[key]
            kids = "".join(children[i] for i in range(len(children)))
            node = hashlib.sha256(kids.encode()).hexdigest()
            yield grp, size, level, idx, node, kids, _width(size, level) == 1

    def frontier(self) -> Iterator[tuple]:
        """The children of the open parents; these are let go."""
        for (grp, level, idx), (size, children) in self.open.items():
            for place, node in children.items():
                yield grp, size, level - 1, idx * ARITY + place, node, None, False
        self.open.clear()


def combined(events: DataFrame) -> DataFrame:
    """The parents that the events of each partition complete, and the frontier (rows without ``kids``)."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    names = ["grp", "size", "level", "idx", "digest", "kids", "top"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partials = Partials()
        for b in batches:
            done = []
            for event in zip(*[c.to_pylist() for c in b.columns], strict=True):
                done += partials.add(*event)
            if done:
                yield batch(done)
        if rest := list(partials.frontier()):
            yield batch(rest)

    return events.select("grp", "size", "level", "idx", "digest").mapInArrow(run, NODES)


def tree(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, int]:
    """Parents (``NODES``), roots (``grp``, ``level``, ``digest``) of the groups, and the highest level.

    ``leaves``: ``grp``, ``size`` (leaves of the group), ``idx`` (from 0), ``digest``.
    """
    events = leaves.select("grp", "size", F.lit(0).alias("level"), "idx", "digest")
    rounds, below = [], levels
    while True:
        found = staged(combined(events), "nodes")
        rounds.append(found.where(F.col("kids").isNotNull()))
        frontier = found.where(F.col("kids").isNull())
        if frontier.isEmpty():
            break
        # All nodes below one ancestor meet: the one at level ``below``, or a node's parent if that is higher.
        up = F.greatest(F.lit(below), F.col("level") + 1)
        power = lambda n: F.pow(F.lit(float(ARITY)), n)
        ancestor = F.floor(F.col("idx") / power(up - F.col("level"))).cast("long")
        dealt = frontier.withColumns({"up": up, "ancestor": ancestor, "leaf": F.col("idx") * power(F.col("level"))}).repartition("grp", "up", "ancestor")
        events = dealt.sortWithinPartitions("grp", "leaf", F.desc("level"))
        below += levels
    nodes = rounds[0]
    for r in rounds[1:]:
        nodes = nodes.unionByName(r)
    alone = leaves.where("size = 1").select("grp", F.lit(0).alias("level"), "digest")
    roots = staged(nodes.where("top").select("grp", "level", "digest").unionByName(alone), "roots")
    return nodes, roots, roots.agg(F.max("level")).first()[0] or 0


PATH = "array<struct<left:string,right:string>>"


def _beside(kids: Column, place: Column) -> Column:
    """The siblings left and right of a child."""
    return F.struct(kids.substr(F.lit(1), place * HEX).alias("left"), kids.substr((place + 1) * HEX + 1, F.lit(ARITY * HEX)).alias("right"))


def runs(nodes: DataFrame, tops: DataFrame, highest: int) -> DataFrame:
    """``grp``, ``run``, ``kids``, ``path``, ``subroot`` of every run of leaves: its digests, and the siblings of its parent and all above, lowest first.

    ``tops``: ``grp``, ``level``, ``path``, ``subroot`` of the groups' roots. The
    run of a lone leaf has null ``kids``. Each level is one equality join with
    the level above.
    """
    at = lambda level: tops.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    paths = at(highest)
    for level in range(highest, 0, -1):
        here = nodes.where(F.col("level") == level).select("grp", "idx", "kids").join(paths, ["grp", "idx"])
        if level == 1:
            break
        place = F.explode(F.sequence(F.lit(0), (F.length("kids") / HEX).cast("int") - 1))
        below = here.withColumn("place", place)
        path = F.concat(F.array(_beside(F.col("kids"), F.col("place"))), F.col("path"))
        paths = below.select("grp", (F.col("idx") * ARITY + F.col("place")).alias("idx"), path.alias("path"), "subroot").unionByName(at(level - 1))
    lone = at(0).select("grp", "idx", F.lit(None).cast("string").alias("kids"), "path", "subroot")
    return (here.unionByName(lone) if highest else lone).withColumnRenamed("idx", "run")


def _with_sizes(rows: DataFrame, sizes: DataFrame, salt_by: str, broadcast_groups: int) -> DataFrame:
    if sizes.limit(broadcast_groups + 1).count() <= broadcast_groups:
        return rows.join(F.broadcast(sizes), "grp")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return dealt.join(sizes.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["grp", "salt"]).drop("salt")


def manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    text_col: str = "text",
    levels: int = LEVELS,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` for every row.

    A leaf is the digest of ``fields``; a null is a value of its own. Per
    source, leaves ascend by id (a null id first, equal ids by digest), and runs
    of 16 become their parent's digest until one is left. The sources' roots,
    a null source first and the others in order of their bytes, give ``root`` in
    the same way. ``proof_sha256`` is the digest of all siblings from leaf to
    root. Where ``tampered`` holds, A-Z of the text are lowered before the leaf
    is folded with its siblings to ``folded_root``; ``verified``: whether that
    is ``root``. Equal rows have equal leaves and neighbouring places. An empty
    table gives an empty result; other columns are not looked at.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    changed = [F.translate(c.cast("string"), _UPPER, _LOWER) if n == text_col else c for n, c in columns.items()]
    other = F.when(F.coalesce(tampered if tampered is not None else F.lit(False), F.lit(False)), digest(*changed))
    source = F.col(f"`{source_col}`").cast("string")
    leaves = staged(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), source.alias("source"), field(source).alias("grp"), digest(*columns.values()).alias("digest"), other.alias("other")), "leaves")
    placed = numbered_globally(leaves, ["source", "doc_id", "digest"], "n")
    sizes = staged(placed.groupBy("grp").agg(F.min("n").alias("at"), F.count("*").alias("size"), F.first("source").alias("source")), "sizes")
    placed = _with_sizes(placed.drop("source"), sizes.select("grp", "at", "size"), "n", broadcast_groups).withColumn("idx", F.col("n") - F.col("at"))
    nodes, roots, highest = tree(placed, levels)
    # The sources' roots are the leaves of one more tree.
    named = roots.join(sizes.select("grp", "source"), "grp")
    ranked = staged(numbered_globally(named.select("source", "grp", "level", "digest"), ["source", "grp"], "n"), "subroots")
    n_sources = ranked.count()
    upper = ranked.select(F.lit("").alias("grp"), F.lit(n_sources).cast("long").alias("size"), (F.col("n") - 1).alias("idx"), "digest", F.col("grp").alias("of"), F.col("level").alias("own_level"))
    upper_nodes, upper_roots, upper_highest = tree(upper, levels)
    top = upper_roots.first()
    root = F.lit(top.digest if top else None).cast("string")
    start = upper_roots.select("grp", "level", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    above = _pathed(upper, runs(upper_nodes, start, upper_highest))
    tops = staged(above.select(F.col("of").alias("grp"), F.col("own_level").alias("level"), "path", F.col("digest").alias("subroot")), "tops")
    out = _pathed(placed, runs(nodes, tops, highest))
    fold = F.aggregate("path", F.coalesce("other", "digest"), lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    discard(leaves)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def _pathed(leaves: DataFrame, of_run: DataFrame) -> DataFrame:
    """``leaves`` with ``path`` (siblings from the leaf up to the root) and ``subroot``; sixteen leaves share what is joined."""
    joined = leaves.withColumn("run", F.floor(F.col("idx") / ARITY).cast("long")).join(of_run, ["grp", "run"])
    place = (F.col("idx") % ARITY).cast("int")
    path = F.when(F.col("kids").isNull(), F.col("path")).otherwise(F.concat(F.array(_beside(F.col("kids"), place)), F.col("path")))
    return joined.withColumn("path", path)
