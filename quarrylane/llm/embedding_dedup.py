"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned into the basis of their principal components, most
variance first. Rows are put in order along a curve through cells of the
leading coordinates and cut into tiles, of which the ranges of coordinates and
the largest suffix norm are kept; only pairs of tiles whose bound reaches the
threshold are compared. In a pair of tiles the leading coordinates' products
come first, the rest is bounded by the product of the suffix norms, and a pair
of rows is dropped as soon as its cosine cannot reach the threshold. What is
left is verified on the vectors as given.

So the work follows the pairs of tiles that lie near each other: on vectors in
groups far less than all pairs, on vectors spread evenly over many dimensions
all of them.

Equal vectors are compared once. A tile pair returns one row per vector that
has a link in it, with the number of links and a representative of its local
component, so its output is linear in the tile whatever the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.staging import components, hot_bound, met, staged
from quarrylane.operators.ordering import numbered_globally

THRESHOLD = 0.9
#: Rows of a tile at most, and bytes of its vectors as doubles: a task holds two tiles, each twice, and what Arrow brings.
TILE_ROWS, TILE_BYTES = 8192, 1 << 24
#: Rows of a tile multiplied at a time.
STRIPE = 512
#: The basis is fitted on at most so many vectors; it orders coordinates and never decides a link.
PCA_ROWS = 4096
#: Leading coordinates that order the rows, cells of each as bits, and coordinates of which a tile's range is kept.
ORDER_BY, CELL_BITS, BOX = 12, 2, 32
#: Tiles whose ranges are compared with as many others in one task.
PAGE_TILES = 512
#: Up to so many ends of tile pairs are broadcast.
BROADCAST_PAIRS = 100_000
#: Bytes of vectors with many copies that are broadcast at most.
HOT_BYTES = 1 << 25
#: Shares of the coordinates after which a pair's bound is taken.
CUTS = (0.25, 0.5, 0.75)
#: Rounding allowed for before a pair is verified as given.
SLACK = 1e-9


def principal_basis(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns, most second moment of the unit vectors first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    _, basis = np.linalg.eigh(unit.T @ unit)
    return np.ascontiguousarray(basis[:, ::-1])


@dataclass
class Curve:
    """The basis and, for each leading coordinate, the bounds of its cells."""

    basis: np.ndarray
    edges: np.ndarray

    @classmethod
    def fit(cls, vectors: np.ndarray) -> Curve:
        basis = principal_basis(vectors)
        lead = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ basis[:, :ORDER_BY]
        return cls(basis, np.quantile(lead, np.arange(1, 1 << CELL_BITS) / (1 << CELL_BITS), axis=0).T)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place on the curve, first BOX coordinates, norm of the rest) of each vector; the curve takes the cells' bits in turn, highest first."""
        turned = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.basis
        cells = [np.searchsorted(e, turned[:, i]) for i, e in enumerate(self.edges)]
        code = np.zeros(len(vectors), dtype=np.int64)
        for bit in range(CELL_BITS - 1, -1, -1):
            for c in cells:
                code = code << 1 | (c >> bit & 1)
        return code, turned[:, :BOX], np.linalg.norm(turned[:, BOX:], axis=1)


def near_boxes(low_a, high_a, rest_a, low_b, high_b, rest_b, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether two unit vectors in the ranges of each pair of tiles can reach the threshold: [tiles of a, tiles of b].

    Their product is at most that of the nearest ends of each range plus the
    product of the suffix norms, and 1 less half the squared gap between the ranges.
    """
    product, gap = np.outer(rest_a, rest_b), np.zeros((len(low_a), len(low_b)))
    for la, ha, lb, hb in zip(low_a.T, high_a.T, low_b.T, high_b.T, strict=True):
        product += np.maximum(np.maximum(np.outer(la, lb), np.outer(ha, hb)), np.maximum(np.outer(la, hb), np.outer(ha, lb)))
        gap += np.maximum(0, np.maximum(la[:, None] - hb, lb - ha[:, None])) ** 2
    return np.minimum(product, 1 - gap / 2) >= threshold - SLACK


class Tile:
    """Vectors as given, and their unit vectors in the basis with the norms of what follows each cut."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray) -> None:
        self.given = vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.turned = (vectors / self.norm[:, None]) @ basis
        dim = basis.shape[1]
        self.cuts = sorted({max(1, round(dim * c)) for c in CUTS} | {dim})
        self.suffix = [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", self.turned[:, c:], self.turned[:, c:]))) for c in self.cuts]


def linked(a: Tile, b: Tile, rows: slice, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into ``a`` and ``b``) of the pairs of ``a[rows]`` and ``b`` whose cosine reaches the threshold."""
    cut = a.cuts[0]
    bound = a.turned[rows, :cut] @ b.turned[:, :cut].T
    i, j = np.nonzero(bound + np.outer(a.suffix[0][rows], b.suffix[0]) >= threshold - SLACK)
    so_far = bound[i, j]
    i = i + rows.start
    for k in range(1, len(a.cuts)):
        lo, hi = a.cuts[k - 1], a.cuts[k]
        so_far = so_far + _products(a.turned, b.turned, i, j, lo, hi)
        near = so_far + a.suffix[k][i] * b.suffix[k][j] >= threshold - SLACK
        i, j, so_far = i[near], j[near], so_far[near]
    cosine = _products(a.given, b.given, i, j, 0, a.given.shape[1]) / (a.norm[i] * b.norm[j])
    return i[cosine >= threshold], j[cosine >= threshold]


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", a[i[s], lo:hi], b[j[s], lo:hi])
    return out


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of the linked nodes ``i`` and ``j``; ``label`` maps each node to its smallest one."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j = i[open_], j[open_]
        low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        pairs = np.unique(high * len(label) + low)
        np.minimum.at(label, pairs // len(label), pairs % len(label))
        while (label != label[label]).any():
            label[:] = label[label]


def compare_tiles(uid: np.ndarray, copies: np.ndarray, size: np.ndarray, tile: np.ndarray, vectors: np.ndarray, basis: np.ndarray, threshold: float = THRESHOLD):
    """(uid, links, representative uid) of each vector that a pair of tiles, or one tile with itself, links to another."""
    order = np.lexsort((uid, tile))
    uid, copies, size, tile, vectors = (x[order] for x in (uid, copies, size, tile, vectors))
    split = int(np.searchsorted(tile, tile[-1]))
    alone = split == 0
    b = Tile(vectors[split:], basis)
    a = b if alone else Tile(vectors[:split], basis)
    links, label = np.zeros(len(uid), dtype=np.int64), np.arange(len(uid))
    for at in range(0, len(a.given), STRIPE):
        i, j = linked(a, b, slice(at, min(at + STRIPE, len(a.given))), threshold)
        j = j + split
        keep = size[i] == size[j]
        if alone:
            keep &= i < j
        i, j = i[keep], j[keep]
        links += np.bincount(i, weights=copies[j], minlength=len(uid)).astype(np.int64)
        links += np.bincount(j, weights=copies[i], minlength=len(uid)).astype(np.int64)
        merge_labels(label, i, j)
    hit = np.flatnonzero(links)
    return uid[hit], links[hit], uid[label[hit]]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two that brings their largest component below 1: cosines stay as they are to the bit, and squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


def _padded(column, size: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of a list column as scaled rows, with zeros after the shorter ones."""
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy()
    return scaled(out)


def tiled(distinct: DataFrame, curve, dim: int, tile_rows: int) -> DataFrame:
    """``distinct`` with ``tile``, ``y`` (leading coordinates) and ``rest`` (suffix norm): rows in order of the curve, ``tile_rows`` to a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, y, rest = curve.value.place(_padded(batch.column(3), batch.column(2).to_numpy(), dim))
            y = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), y, pa.array(rest)], names=["uid", "copies", "size", "v", "code", "y", "rest"])

    rows = distinct.select("uid", "copies", F.size("v").alias("size"), "v")
    coded = rows.mapInArrow(run, "uid long, copies long, size int, v array<double>, code long, y array<double>, rest double")
    return numbered_globally(coded, ["code", "uid"], "n").withColumn("tile", F.floor((F.col("n") - 1) / tile_rows).cast("long"))


def tile_pairs(placed: DataFrame, tiles: int, box: int, threshold: float) -> DataFrame:
    """``a``, ``b`` (a <= b): the pairs of tiles whose bound reaches the threshold. Ranges are compared page by page of tiles."""
    ends = [f(F.get("y", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(box)]
    boxes = staged(placed.groupBy("tile").agg(F.max("rest").alias("rest"), *ends), "boxes")
    pages = -(-tiles // PAGE_TILES)
    page = F.floor(F.col("tile") / PAGE_TILES).cast("long")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")), lambda o: F.least(o, page) * pages + F.greatest(o, page))

    def run(group: pa.Table) -> pa.Table:
        tile = group["tile"].to_numpy()
        first = tile // PAGE_TILES == (tile // PAGE_TILES).min()
        low, high = (np.stack([group[f"{n}{i}"].to_numpy() for i in range(box)], axis=1) for n in ("low", "high"))
        rest = group["rest"].to_numpy()
        other = ~first if not first.all() else first
        i, j = np.nonzero(near_boxes(low[first], high[first], rest[first], low[other], high[other], rest[other], threshold))
        a, b = tile[first][i], tile[other][j]
        keep = a <= b
        return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})

    dealt = boxes.withColumn("pages", F.explode(others))
    return staged(dealt.groupBy("pages").applyInArrow(run, "a long, b long"), "tile_pairs")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int | None = None
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    ``n_links``: other rows whose cosine, in double precision, is at least
    ``threshold``. ``component_id``: smallest id reachable by links, the row's
    own included. Vectors that are null, zero or empty, or hold null or
    non-finite components link with nothing, nor do vectors of different sizes.
    A null id counts as larger than all others. Equal rows are copies of each
    other and link. An empty table gives an empty result; other columns,
    whatever their names, are not looked at.
    """
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("h", F.when(F.col("ok"), F.xxhash64("v")))
    grouped = rows.where("ok").groupBy("h", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    distinct = staged(grouped.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    stats = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.sum("copies").alias("rows")).first()
    if not stats.n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = stats.dim
    tile_rows = tile_rows or max(1, min(TILE_ROWS, TILE_BYTES // (8 * dim)))
    tiles = -(-stats.n // tile_rows)
    sample = distinct.select("h", "v").orderBy("h", "v").limit(PCA_ROWS).toArrow()["v"].to_pylist()
    curve = distinct.sparkSession.sparkContext.broadcast(Curve.fit(scaled(np.array([x + [0.0] * (dim - len(x)) for x in sample]))))
    placed = tiled(distinct, curve, dim, tile_rows)
    pairs = tile_pairs(placed, tiles, min(BOX, dim), threshold)
    ends = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"), (F.col("a") * tiles + F.col("b")).alias("pair"))
    if ends.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        ends = F.broadcast(ends)

    def run(group: pa.Table) -> pa.Table:
        size = group["size"].to_numpy()
        given = _padded(group["v"], size, dim)
        u, n, r = compare_tiles(group["uid"].to_numpy(), group["copies"].to_numpy(), size, group["tile"].to_numpy(), given, curve.value.basis, threshold)
        return pa.table({"uid": pa.array(u, pa.int64()), "links": pa.array(n, pa.int64()), "root": pa.array(r, pa.int64())})

    dealt = placed.select("uid", "copies", "size", "v", "tile").join(ends, "tile")
    edges = staged(dealt.groupBy("pair").applyInArrow(run, "uid long, links long, root long"), "links")
    roots = components(edges.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    degrees = edges.groupBy("uid").agg(F.sum("links").alias("links"))
    narrow = distinct.select("uid", "copies", "first_id").join(degrees, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    narrow = narrow.select("uid", "copies", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), "first_id", F.coalesce("root", "uid").alias("root"))
    smallest = narrow.groupBy("root").agg(F.min("first_id").alias("component"), F.count("*").alias("members"))
    rooted = met(narrow, smallest, ["root"], "members", hot_bound(stats.n))
    found = distinct.select("uid", "h", "v").join(staged(rooted.select("uid", "copies", "n_links", "component"), "found"), "uid")
    # Vectors with many copies come to them; how many these can be is bounded by their bytes.
    of_copy = met(rows.where("ok"), found, ["h", "v"], "copies", hot_bound(stats.rows, HOT_BYTES // (8 * dim)))
    none = F.lit(None).cast("long")
    out = of_copy.select("vec_id", "ok", "n_links", "component").unionByName(rows.where(~F.col("ok")).select("vec_id", "ok", none.alias("n_links"), none.alias("component")))
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
