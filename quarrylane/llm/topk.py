"""Exact top-k search by three phases with a uniform threshold.

Dimensions are dealt to a few slices, and candidates to tiles; a slice of a
tile is a node that holds, for each query, a list of partial scores. A total is
the sum of a candidate's partial scores over the slices.

1. Every node gives the head of its lists. The candidates named there get their
   totals; the k-th of these is a score that the result cannot fall below.
2. A total of at least ``t`` needs a partial score of at least ``t`` / slices in
   some list: this cutoff goes with the query to all nodes, which give all
   entries that reach it. Their sums, with less than the cutoff for a list in
   which a candidate was not named, bound its total from above.
3. Only candidates whose bound reaches the best k-th total known by then stay;
   those that some list did not name are resolved by their vectors.

Equal vectors are searched once, with the first ids of each; equal queries too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.staging import discard, staged
from quarrylane.llm.vectors import best, exact_type, first_ids, for_each_salt, inner, integer_rows, padded, salted, without_own

#: Slices of the dimensions, and entries a query takes from the head of each list.
SLICES, HEAD = 2, 16
#: Bytes of a tile's vectors in a node, its rows at most, and queries of a block.
TILE_BYTES, TILE_ROWS, QUERY_ROWS = 1 << 22, 4096, 512
#: Below every score.
LOWEST = -(1 << 62)

RESULT = "query_id long, rank int, vec_id long, score long"


class Nodes:
    """Slices of tiles, each beside the same slices of a block of queries."""

    def __init__(self, distinct: DataFrame, asked: DataFrame, n: int, n_asked: int, dim: int, slices: int, tile_rows: int) -> None:
        self.tiles, self.blocks, self.slices = -(-n // tile_rows), -(-n_asked // QUERY_ROWS), slices
        self.ends = [round(i * dim / slices) for i in range(slices + 1)]
        self.width = max(b - a for a, b in zip(self.ends, self.ends[1:], strict=False))
        self.distinct, self.asked = distinct, asked

    def lists(self, cut: DataFrame | None, run, schema: str) -> DataFrame:
        """``run`` over every node and block of queries. ``cut`` has a cutoff for each query (``q``)."""
        parts = F.array(*[F.struct(F.lit(g).alias("slice"), F.slice("v", a + 1, b - a).alias("part")) for g, (a, b) in enumerate(zip(self.ends, self.ends[1:], strict=False))])
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        mine = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
        none = F.lit(LOWEST).cast("long")
        vectors = self.distinct.select("uid", F.lit(False).alias("asks"), none.alias("cut"), mine(self.tiles).alias("tile"), F.explode(parts).alias("p")).withColumn("block", every(self.blocks))
        asked = self.asked.select("uid", "v") if cut is None else self.asked.select("uid", "v").join(cut, F.col("uid") == F.col("q"), "left")
        limit = none if cut is None else F.coalesce("cut", none)
        queries = asked.select("uid", F.lit(True).alias("asks"), limit.alias("cut"), F.explode(parts).alias("p"), mine(self.blocks).alias("block")).withColumn("tile", every(self.tiles))
        fields = ["tile", "block", F.col("p.slice").alias("slice"), "asks", "uid", "cut", F.col("p.part").alias("part")]
        return vectors.select(*fields).unionByName(queries.select(*fields)).groupBy("tile", "block", "slice").applyInArrow(run, schema)


def _products(node: pa.Table, width: int, kind: type) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The queries of a node, the ids of its vectors, and the partial scores [queries, vectors]."""
    asks = node["asks"]
    queries, vectors = node.filter(asks), node.filter(pa.compute.invert(asks))
    if not queries.num_rows or not vectors.num_rows:
        return queries, vectors["uid"].to_numpy(), np.zeros((queries.num_rows, vectors.num_rows), dtype=kind)
    return queries, vectors["uid"].to_numpy(), padded(queries["part"], width, kind) @ padded(vectors["part"], width, kind).T


def _entries(q: np.ndarray, uid: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"q": pa.array(q, pa.int64()), "uid": pa.array(uid, pa.int64()), "partial": pa.array(score.astype(np.int64))})


def _kth(totals: DataFrame, k: int, name: str) -> DataFrame:
    """``q`` and its k-th highest total; no row where there are fewer."""
    top = best(totals.select("q", "uid", "score"), ["q"], k, F.desc("score"), F.col("uid"))
    return top.groupBy("q").agg(F.min("score").alias(name), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def _lists(distinct: DataFrame, asked: DataFrame, k: int, slices: int, head: int, tile_rows: int | None) -> DataFrame:
    """``h``, ``v`` and ``items``, the first ``k`` rows by score of all, for each distinct query."""
    n, dim, kind = exact_type(distinct)
    slices = max(1, min(slices, dim))
    rows = tile_rows or max(64, min(TILE_ROWS, TILE_BYTES * slices // (8 * max(1, dim))))
    nodes = Nodes(distinct, asked, n, asked.count(), dim, slices, rows)
    width = nodes.width

    def heads(node: pa.Table) -> pa.Table:
        queries, uid, score = _products(node, width, kind)
        m = min(head, len(uid))
        if not m or not queries.num_rows:
            return _slice_of(_entries(np.zeros(0), np.zeros(0), np.zeros(0)), node)
        at = np.argpartition(-score, m - 1, axis=1)[:, :m]
        return _slice_of(_entries(np.repeat(queries["uid"].to_numpy(), m), uid[at].ravel(), np.take_along_axis(score, at, 1).ravel()), node)

    def reaching(node: pa.Table) -> pa.Table:
        queries, uid, score = _products(node, width, kind)
        i, j = np.nonzero(score >= queries["cut"].to_numpy()[:, None])
        return _entries(queries["uid"].to_numpy()[i], uid[j], score[i, j])

    of_query = asked.select(F.col("uid").alias("q"), F.col("v").alias("qv"))
    # Phase 1: heads of the lists, and the totals of what they name.
    listed = best(nodes.lists(None, heads, "q long, uid long, partial long, slice int"), ["q", "slice"], head, F.desc("partial"), F.col("uid"))
    named = listed.select("q", "uid").distinct().join(distinct.select("uid", "v"), "uid").join(of_query, "q")
    named = staged(named.select("q", "uid", inner("v", "qv").alias("score")), "named")
    m = F.lit(slices)
    up = F.when(F.col("t") > 0, F.expr(f"(t + {slices - 1}) div {slices}")).otherwise(F.expr(f"t div {slices}"))
    cut = _kth(named, k, "t").select("q", up.alias("cut"))
    # Phase 2: every entry that reaches the cutoff.
    entries = nodes.lists(cut, reaching, "q long, uid long, partial long")
    seen = staged(entries.groupBy("q", "uid").agg(F.sum("partial").alias("score"), F.count("*").alias("lists")), "seen")
    known = seen.where(F.col("lists") == m).select("q", "uid", "score").union(named).distinct()
    bounds = asked.select(F.col("uid").alias("q")).join(cut, "q", "left").join(_kth(known, k, "least"), "q", "left")
    above = F.col("score") + (m - F.col("lists")) * (F.coalesce("cut", F.lit(0).cast("long")) - 1)
    left = seen.join(bounds, "q").where(F.col("least").isNull() | (above >= F.col("least"))).select("q", "uid", "score", "lists")
    # Phase 3: what some list did not name.
    left = left.join(distinct.select("uid", "v", "ids", "first"), "uid").join(of_query, "q")
    exact = left.select("q", "uid", "ids", "first", F.when(F.col("lists") == m, F.col("score")).otherwise(inner("v", "qv")).alias("score"))
    top = best(exact, ["q"], k, F.desc("score"), F.col("first").asc_nulls_last(), F.col("uid"))
    of_rows = top.select("q", "uid", "score", F.posexplode("ids").alias("copy", "vec_id"))
    order = (F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("uid"), F.col("copy"))
    of_rows = best(of_rows, ["q"], k, *order)
    item = F.struct((-F.col("score")).alias("back"), F.col("vec_id").isNull().alias("no_id"), "vec_id", "uid", "copy", "score", (F.col("uid") == F.col("q")).alias("own"))
    lists = of_rows.groupBy("q").agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = staged(asked.select("h", "v", F.col("uid").alias("q")).join(lists, "q").drop("q"), "lists")
    discard(named)
    discard(seen)
    return out


def _slice_of(entries: pa.Table, node: pa.Table) -> pa.Table:
    return entries.append_column("slice", pa.array(np.full(entries.num_rows, node["slice"][0].as_py() if node.num_rows else 0, dtype=np.int32)))


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    slices: int = SLICES,
    head: int = HEAD,
    tile_rows: int | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` other rows of highest score for every row where ``queries`` holds.

    A component x counts as floor(256 * x), a score is the integer inner
    product; ties go to the smaller id, a null id comes after all others. A row
    is never its own hit, but a repeated row is another row. Vectors that are
    null or hold null or non-finite components take no part, an empty one has
    score 0 with all, and a shorter one counts as followed by zeros. Scores
    beyond a 64-bit integer are refused. With fewer than ``k`` other rows all
    are given. An empty table gives an empty result; other columns are not
    looked at.
    """
    rows = integer_rows(vectors, vector_col, vec_id=F.col(f"`{id_col}`").cast("long"), asks=F.coalesce(queries, F.lit(False))).withColumn("h", F.xxhash64("v"))
    distinct = staged(first_ids(rows, ["h", "v"], k + 1).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asking = rows.where("asks").select("vec_id", "h", "v")
    asked = staged(distinct.join(asking.select("h", "v").distinct(), ["h", "v"], "left_semi"), "asked")
    if asked.isEmpty():
        return vectors.sparkSession.createDataFrame([], RESULT)
    lists = for_each_salt(_lists(distinct, asked, k + 1, slices, max(head, k + 1), tile_rows))
    discard(distinct)
    discard(asked)
    found = salted(asking, F.col("vec_id")).join(lists, ["h", "salt", "v"])
    hits = F.posexplode(without_own(F.col("items"), F.col("vec_id"), k)).alias("at", "hit")
    return found.select(F.col("vec_id").alias("query_id"), hits).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
