"""Hard negatives by one-dimensional distance keys.

A vector gets one more coordinate that brings all to the same norm; then the
larger an inner product with an anchor (whose own such coordinate is 0), the
smaller the distance. Each vector is stored under its nearest pivot and its
distance to it, sorted by (pivot, distance) in blocks of which a directory
holds the range of keys.

A search scans rings: by the triangle inequality, what lies within r of an
anchor has a key within r of the anchor's own distance to the pivot. The radius
grows from round to round, each round reads only the part of the key intervals
that the one before did not, and an anchor is done when its k-th hit is nearer
than the radius, or the radius covers all that may count. Pivots only decide
how much is scanned.

Equal vectors of a label are searched once, with the first ids of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.staging import discard, staged
from quarrylane.llm.vectors import best, exact_type, first_ids, for_each_salt, integer_rows, padded, salted, without_own
from quarrylane.operators.ordering import numbered_globally

POSITIVES, NEGATIVES = 5, 10
#: Hundredths of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
#: Pivots are fitted on at most so many vectors.
PIVOTS, PIVOT_ROWS = 16, 4096
#: Key ranges are looked up by bands of 1 / BANDS of the largest distance.
BANDS = 64
#: Bytes of the vectors of a block, its rows at most, and anchors that meet it in one task.
BLOCK_BYTES, BLOCK_ROWS, CHUNK_ROWS = 1 << 22, 4096, 512
#: The first radius and the least step, as shares of the largest distance.
FIRST, STEP = 0.25, 0.0625
#: Bounds of scores that leave nothing out.
ALL = 1 << 62

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Space:
    """Pivots in the space with one more coordinate, in which all vectors have the norm ``reach``."""

    pivots: np.ndarray
    reach: float

    @classmethod
    def fit(cls, sample: np.ndarray, reach: float, pivots: int = PIVOTS, rounds: int = 5) -> Space:
        """Means of groups, each begun at the vector farthest from those before it."""
        space = cls(np.zeros((0, sample.shape[1] + 1)), reach)
        x = space.lifted(sample)
        chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(pivots, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
        space.pivots = x[chosen]
        for _ in range(rounds):
            near = space.distances(x).argmin(axis=1)
            space.pivots = np.array([x[near == p].mean(axis=0) if (near == p).any() else space.pivots[p] for p in range(len(space.pivots))])
        return space

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.reach**2 - np.einsum("ij,ij->i", vectors, vectors)
        return np.column_stack([vectors, np.sqrt(np.maximum(0, rest))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """[vectors, pivots]."""
        square = np.einsum("ij,ij->i", lifted, lifted)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    @property
    def slack(self) -> float:
        """Rounding that distances may hold."""
        return 1e-6 * max(1.0, self.reach)


def _mapped(frame: DataFrame, run, schema: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield run(b)

    return frame.mapInArrow(over, schema)


class Index:
    """Vectors sorted by (pivot, distance) in blocks, and the directory of the blocks' ranges."""

    def __init__(self, distinct: DataFrame, block_rows: int | None = None) -> None:
        n, self.dim, self.kind = exact_type(distinct)
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        reach = float(np.sqrt(distinct.agg(F.max(square)).first()[0] or 0.0))
        sample = distinct.orderBy("h", "uid").limit(PIVOT_ROWS).select("v").toArrow()["v"]
        self.space = Space.fit(padded(sample, self.dim, np.float64), reach)
        self.spark = distinct.sparkSession
        self.shared = self.spark.sparkContext.broadcast(self.space)
        shared, dim = self.shared, self.dim
        rows = block_rows or max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))

        def place(b: pa.RecordBatch) -> pa.RecordBatch:
            d = shared.value.distances(shared.value.lifted(padded(b.column("v"), dim, np.float64)))
            pivot = d.argmin(axis=1)
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])], names=[*b.schema.names, "pivot", "dist"])

        kept = distinct.select("uid", "first", "label", "v")
        keyed = numbered_globally(_mapped(kept, place, "uid long, first long, label long, v array<long>, pivot int, dist double"), ["pivot", "dist", "uid"], "n")
        #: A run of keys of one pivot; a run that ends in the next pivot's is two blocks.
        self.rows = keyed.withColumn("block", (F.col("pivot").cast("long") * (1 << 40)) + F.floor((F.col("n") - 1) / rows))
        ranges = self.rows.groupBy("block", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"))
        self.band = max(2 * reach / BANDS, 1e-9)
        self.directory = staged(ranges.withColumn("band", F.explode(F.sequence(self.band_of("low"), self.band_of("high")))), "directory")

    def band_of(self, distance: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(BANDS), F.floor(F.col(distance) / F.lit(self.band)))).cast("int")

    def search(self, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
        """``q``, ``window``, ``uid``, ``first``, ``score``: the first ``k`` vectors by score of each window.

        ``anchors``: ``uid``, ``label``, ``v``, ``windows`` (array of structs
        ``low``, ``high``: bounds of scores that count). With ``same_label``
        only vectors of the anchor's label count, else only those of others.
        """
        shared, dim = self.shared, self.dim

        def measure(b: pa.RecordBatch) -> pa.RecordBatch:
            v = padded(b.column("v"), dim, np.float64)
            d = shared.value.distances(np.column_stack([v, np.zeros(len(v))]))
            norm = np.einsum("ij,ij->i", v, v)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            return pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(norm)], names=[*b.schema.names, "to_pivots", "square"])

        schema = "uid long, label long, v array<long>, windows array<struct<low:long,high:long>>, to_pivots array<double>, square double"
        base = staged(_mapped(anchors.select("uid", "label", "v", "windows"), measure, schema), "anchors")
        chunks = max(1, -(-base.count() // CHUNK_ROWS))
        reach, slack = F.lit(self.space.reach), F.lit(self.space.slack)
        whole = F.sqrt("square") + reach + slack
        away = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("square") + reach * reach - 2.0 * score.cast("double")))
        highest = F.array_max(F.transform("windows", lambda w: w["high"]))
        start = F.when(highest < ALL, away(highest) + F.lit(STEP) * whole).otherwise(F.lit(FIRST) * whole)
        state = staged(base.select("uid", F.lit(-1.0).alias("r0"), F.least(start, whole).alias("r1")), "radius")
        found: DataFrame | None = None
        while not state.isEmpty():
            active = base.join(state, "uid")
            hits = self.ring(active, chunks, k, same_label)
            merged = hits if found is None else hits.unionByName(found)
            before, found = found, staged(best(merged, ["q", "window"], k, F.desc("score"), F.col("first").asc_nulls_last(), F.col("uid")), "found")
            discard(before)
            counts = found.groupBy(F.col("q").alias("uid"), "window").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
            each = active.select("uid", "square", "r1", F.posexplode("windows").alias("window", "w")).join(counts, ["uid", "window"], "left")
            need = F.when(F.col("n") >= k, away(F.col("worst"))).when(F.col("w.low") > -ALL, away(F.col("w.low"))).otherwise(whole) + slack
            by_anchor = each.groupBy("uid").agg(F.max(F.least(need, whole)).alias("need"), F.max("r1").alias("r0"), F.max(whole).alias("whole"))
            further = F.least("need", F.greatest(F.col("r0") * 2, F.col("r0") + F.lit(STEP) * F.col("whole")))
            after = staged(by_anchor.where(F.col("need") > F.col("r0")).select("uid", "r0", further.alias("r1")), "radius")
            discard(state)
            state = after
        discard(state)
        return found if found is not None else self.spark.createDataFrame([], "q long, window int, uid long, first long, score long")

    def ring(self, active: DataFrame, chunks: int, k: int, same_label: bool) -> DataFrame:
        """Hits among the keys between ``r0`` and ``r1`` of each anchor: at most ``k`` for each window and block."""
        slack = self.space.slack
        low, high = F.col("d") - F.col("r1") - slack, F.col("d") + F.col("r1") + slack
        ways = active.select("uid", "r0", "r1", F.posexplode("to_pivots").alias("pivot", "d")).withColumns({"from": low, "to": high})
        ways = ways.withColumn("band", F.explode(F.sequence(self.band_of("from"), self.band_of("to"))))
        inside = (F.col("low") >= F.col("d") - F.col("r0") + slack) & (F.col("high") <= F.col("d") + F.col("r0") - slack)
        near = (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from")) & ~((F.col("r0") > 0) & inside)
        visits = ways.join(self.directory, ["pivot", "band"]).where(near).select("uid", "block", "d").distinct()
        visits = visits.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
        payload = visits.join(active.select("uid", "label", "v", "windows", "r0", "r1"), "uid")
        wanted = self.rows.join(visits.select("block", "chunk").distinct(), "block")
        none = F.lit(None)
        asks = payload.select("block", "chunk", F.lit(True).alias("asks"), "uid", F.lit(0).cast("long").alias("first"), "label", "v", F.col("d").alias("dist"), "windows", "r0", "r1")
        rows = wanted.select("block", "chunk", F.lit(False).alias("asks"), "uid", "first", "label", "v", "dist", none.cast("array<struct<low:long,high:long>>").alias("windows"), F.lit(0.0).alias("r0"), F.lit(0.0).alias("r1"))
        dim, kind = self.dim, self.kind

        def scan(block: pa.Table) -> pa.Table:
            return _scan(block, dim, kind, k, same_label, slack)

        return asks.unionByName(rows).groupBy("block", "chunk").applyInArrow(scan, "q long, window int, uid long, first long, score long")


def _scan(block: pa.Table, dim: int, kind: type, k: int, same_label: bool, slack: float) -> pa.Table:
    asks = block["asks"]
    q, rows = block.filter(asks), block.filter(pa.compute.invert(asks))
    score = padded(q["v"], dim, kind) @ padded(rows["v"], dim, kind).T
    gap = np.abs(q["dist"].to_numpy()[:, None] - rows["dist"].to_numpy())
    # Keys up to r0 were read by an earlier round; both rounds take the rounding at the edge, and equal hits are one.
    ring = (gap <= q["r1"].to_numpy()[:, None] + slack) & (gap > q["r0"].to_numpy()[:, None] + slack)
    ring &= (q["label"].to_numpy()[:, None] == rows["label"].to_numpy()) == same_label
    uid = rows["uid"].to_numpy()
    first = rows["first"].to_pandas().fillna(np.iinfo(np.int64).max).to_numpy(dtype=np.int64)
    out: list[tuple[int, int, np.ndarray]] = []
    for i, windows in enumerate(q["windows"].to_pylist()):
        near = np.flatnonzero(ring[i])
        s = score[i, near]
        for w, bounds in enumerate(windows):
            ok = (s >= bounds["low"]) & (s <= bounds["high"])
            at, mine = near[ok], s[ok]
            if len(at) > k:
                keep = mine >= np.partition(mine, len(mine) - k)[len(mine) - k]
                at, mine = at[keep], mine[keep]
                order = np.lexsort((uid[at], first[at], -mine))[:k]
                at = at[order]
            if len(at):
                out.append((i, w, at))
    number = lambda f, kind: np.concatenate([np.full(len(at), f(i, w)) for i, w, at in out]).astype(kind) if out else np.zeros(0, kind)
    anchor, window = number(lambda i, w: i, np.int64), number(lambda i, w: w, np.int32)
    at = np.concatenate([at for _, _, at in out]) if out else np.zeros(0, np.int64)
    return pa.table({"q": pa.array(q["uid"].to_numpy()[anchor], pa.int64()), "window": pa.array(window), "uid": pa.array(uid[at], pa.int64()), "first": rows["first"].combine_chunks().take(pa.array(at)), "score": pa.array(score[anchor, at].astype(np.int64))})


def _rows_of(found: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """``q``, ``window``, ``items``: the first ``k`` rows of what was found, best first."""
    with_ids = found.join(distinct.select("uid", "ids"), "uid").select("q", "window", "uid", "score", F.posexplode("ids").alias("copy", "vec_id"))
    top = best(with_ids, ["q", "window"], k, F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("uid"), F.col("copy"))
    item = F.struct((-F.col("score")).alias("back"), F.col("vec_id").isNull().alias("no_id"), "vec_id", "uid", "copy", "score", (F.col("uid") == F.col("q")).alias("own"))
    return top.groupBy("q", "window").agg(F.sort_array(F.collect_list(item)).alias("items"))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int | None = None,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    For every row where ``anchors`` holds: its ``positives`` other rows of the
    same label with the highest scores, and for each of these the
    ``negatives`` rows of other labels with the highest scores among those
    from ``low`` to ``high`` hundredths of the positive's. Scores are integer
    inner products of floor(256 * x); ties go to the smaller id, a null id
    comes last. Where fewer rows answer, all are given; a positive of negative
    score has no negatives. Rows with a null label or vector, or with null or
    non-finite components, take no part; an empty vector has score 0 with all,
    a shorter one counts as followed by zeros. A repeated row is another row:
    it may be a positive of its twin. An empty table gives an empty result;
    other columns are not looked at.
    """
    label = F.col(f"`{label_col}`").cast("long")
    rows = integer_rows(vectors.where(label.isNotNull()), vector_col, vec_id=F.col(f"`{id_col}`").cast("long"), label=label, asks=F.coalesce(anchors, F.lit(False)))
    rows = rows.withColumn("h", F.xxhash64("label", "v"))
    key = ["h", "label", "v"]
    distinct = staged(first_ids(rows, key, max(positives + 1, negatives)).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asking = rows.where("asks").select("vec_id", *key)
    asked = staged(distinct.join(asking.select(*key).distinct(), key, "left_semi").select("uid", *key), "asked")
    if asked.isEmpty():
        return vectors.sparkSession.createDataFrame([], RESULT)
    index = Index(distinct, block_rows)
    everything = F.array(F.struct(F.lit(-ALL).cast("long").alias("low"), F.lit(ALL).cast("long").alias("high")))
    first = index.search(asked.withColumn("windows", everything), positives + 1, True)
    positive = staged(_rows_of(first, distinct, positives + 1).select(F.col("q").alias("uid"), F.col("items").alias("positives")), "positives")
    scores = F.array_sort(F.array_distinct(F.filter(F.transform("positives", lambda p: p["score"]), lambda s: s >= 0)))
    window = lambda s: F.struct(F.floor((s * low + 99) / 100).cast("long").alias("low"), F.floor(s * high / 100).cast("long").alias("high"))
    windowed = asked.join(positive, "uid").withColumn("scores", scores).where(F.size("scores") > 0)
    windowed = staged(windowed.withColumn("windows", F.transform("scores", window)), "windows")
    second = index.search(windowed, negatives, False)
    negative = _rows_of(second, distinct, negatives).select(F.col("q").alias("uid"), "window", F.transform("items", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("negatives"))
    by_score = windowed.select("uid", F.posexplode("scores").alias("window", "score")).join(negative, ["uid", "window"])
    packed = by_score.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("score", "negatives"))).alias("negatives"))
    lists = staged(windowed.select("uid", *key, "positives").join(packed, "uid").drop("uid"), "lists")
    mine = salted(asking, F.col("vec_id")).join(for_each_salt(lists), ["salt", *key])
    each = mine.select(F.col("vec_id").alias("anchor_id"), "negatives", F.explode(without_own(F.col("positives"), F.col("vec_id"), positives)).alias("p"))
    each = each.select("anchor_id", "p", F.posexplode(F.try_element_at("negatives", F.col("p.score"))).alias("at", "n"))
    return each.select(
        "anchor_id",
        F.col("p.vec_id").alias("positive_id"),
        (F.col("at") + 1).alias("rank"),
        F.col("n.vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("n.score").alias("negative_score"),
    )
