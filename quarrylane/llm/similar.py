"""SimHash near-dedup (operator 10) carried on to a Jaccard similarity of word shingles.

Two texts are linked when their sets of five-word shingles have a Jaccard
similarity of at least 0.8. The first candidates are what operator 10's
deletion variants link: fingerprints over five-word shingles that differ in at
most ``MAX_BITS`` bits. A pair at 0.8 differs in ten of 64 bits, which no index
of segments with one wildcard reaches, so the other candidates share one of
``BANDS`` hashes of ``BAND_ROWS`` minhashes each: a pair at exactly 0.8 shares
none with a chance of (1 - 0.8 ** 5) ** 32, 3 in a million, and a closer pair
with less. Every link is verified on the shingle sets.

Equal sets count once. Of a bucket's members each is first compared with one
that follows it, which joins groups of near copies at little cost. Buckets that
still hold several components are then searched whole, with their sets; those
over ``BLOCK_ROWS`` members by pairs of blocks in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.simhash import MAX_BITS, keep_rows, links, majority, shingle_hashes
from quarrylane.llm.staging import components, discard, staged

SEED = 42
SHINGLE_WORDS = 5
#: Numerator and denominator of the similarity from which texts are linked.
SIMILARITY = (4, 5)
BANDS, BAND_ROWS = 32, 5
BLOCK_ROWS = 2048
#: Rows handed on at a time.
ROWS = 1024
_CHUNK = 1 << 12
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed long per band; none for an empty set."""
    if not shingles.size:
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(least, (shingles[at : at + _CHUNK, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return [_long(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _set_id(shingles: np.ndarray) -> int:
    return _long(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``h`` (hash of the text) and ``t`` of every row."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h``, ``sid`` (names the shingle set), ``fp`` (the text's fingerprint) and ``keys`` (the set's bands) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            sids, prints, keys = [], [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), SHINGLE_WORDS)
                shingles = np.unique(hashes)
                sids.append(_set_id(shingles))
                prints.append(_long(majority(hashes)))
                keys.append(band_keys(shingles))
            columns = [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "sid", "fp", "keys"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "id long, h long, sid long, fp long, keys array<long>")


def simhash_candidates(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a``, ``b`` of shingle sets whose texts' fingerprints are equal or linked by deletion variants, one pair for each such link."""
    sets = rows.where(F.size("keys") > 0).groupBy("fp", "sid").agg(F.lit(1)).select("fp", "sid")
    firsts = sets.groupBy("fp").agg(F.min("sid").alias("first"))
    equal = sets.join(firsts, "fp").where("sid <> first").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    found = links(firsts.select("fp"), max_bits)
    side = lambda name: firsts.select(F.col("fp").alias(name), F.col("first").alias(f"first_{name}"))
    linked = found.join(side("a"), "a").join(side("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return equal.union(linked).where("a <> b").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """``sid`` and ``shingles`` of every row's ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            found = [shingle_set(t.as_py()) for t in batch.column(0)]
            columns = [pa.array(map(_set_id, found), pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "shingles"])

    return texts.select("t").mapInArrow(run, "sid long, shingles array<long>")


def spanning_links(sids: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """(member, root) links that span the link graph of the given sets."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    marked = np.zeros(int(codes.max()) + 1, dtype=bool)
    left = np.arange(len(sets))
    left_codes, members, roots = codes, [], []
    while left.size > 1:
        root, left, left_codes = left[0], left[1:], left_codes[sizes[left[0]] :]
        queue = [root]
        while queue and left.size:
            i = queue.pop()
            own = codes[ends[i] - sizes[i] : ends[i]]
            marked[own] = True
            of = sizes[left]
            common = np.add.reduceat(marked[left_codes], np.cumsum(of) - of, dtype=np.int64)
            marked[own] = False
            near = SIMILARITY[1] * common >= SIMILARITY[0] * (of + sizes[i] - common)
            if near.any():
                found = left[near]
                members += sids[found].tolist()
                roots += [int(sids[root])] * len(found)
                left_codes, left = left_codes[np.repeat(~near, of)], left[~near]
                queue.extend(found)
    return members, roots


def _link_bucket(bucket: pa.Table) -> pa.Table:
    lists = bucket.column("shingles").combine_chunks()
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    sets = [values[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]
    a, b = spanning_links(bucket.column("sid").to_numpy(), sets)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _similar(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b)).cast("long")
    return SIMILARITY[1] * common >= SIMILARITY[0] * (F.size(a) + F.size(b) - common)


def groups(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``sid``, ``root`` of every shingle set linked to another, itself not the root; ``rows`` is a staged table of ``signatures``."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("first")
    distinct = rows.where(F.size("keys") > 0).groupBy("sid").agg(first, F.first("keys").alias("keys"))
    by_key = Window.partitionBy("key").orderBy("sid")
    exploded = distinct.select("sid", F.explode("keys").alias("key")).select("key", "sid", F.lag("sid").over(by_key).alias("before"), F.lead("sid").over(by_key).alias("after"))
    members = staged(exploded.where("before is not null or after is not null").drop("before"), "members")
    close = staged(simhash_candidates(rows), "close")
    wanted = members.select("sid").union(close.select("a")).union(close.select("b")).distinct()
    needed = rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(first).select("first.id", "first.h").withColumnsRenamed({"id": "__id", "h": "__h"})
    texts = _keyed(docs, id_col, text_col).join(needed, F.col("id").eqNullSafe(F.col("__id")) & F.col("h").eqNullSafe(F.col("__h")), "left_semi")
    sets = staged(_sets(texts).dropDuplicates(["sid"]), "sets")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("sid").alias(name), F.col("shingles").alias(f"set_{name}"))

    pairs = members.where("after is not null").groupBy(F.col("sid").alias("a")).agg(F.min("after").alias("b")).union(close)
    near = staged(pairs.join(side("a"), "a").join(side("b"), "b").where(_similar(F.col("set_a"), F.col("set_b"))).select("a", "b"), "near")
    roots = components(near)
    rooted = members.join(roots, members.sid == roots.node, "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
    mixed = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", F.ceil(F.col("n") / block_rows).cast("long").alias("g"))
    # A member goes to each pair of blocks that its own block is in.
    own = F.pmod(F.xxhash64("sid"), F.col("g"))
    block_pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.least(o, F.col("own")) * F.col("g") + F.greatest(o, F.col("own")))
    spread = members.join(mixed, "key").withColumn("own", own).select("key", "sid", F.explode(block_pairs).alias("pair"))
    more = spread.join(sets, "sid").groupBy("key", "pair").applyInArrow(_link_bucket, "a long, b long")
    links = staged(near.union(more).distinct(), "links")
    for table in (members, close, sets, near):
        discard(table)
    return components(links).select(F.col("node").alias("sid"), "root")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    Rows are told apart by their texts, not by their ids. The row with the smallest id stays, of equal ids the one with the smallest
    text hash; a null id comes after all others. Texts without words are one
    group.
    """
    rows = staged(signatures(docs, id_col, text_col), "signatures")
    roots = groups(rows, docs, id_col, text_col, block_rows)
    sets = rows.groupBy("sid").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("first"))
    firsts = sets.join(roots, "sid", "left").groupBy(F.coalesce("root", "sid")).agg(F.min("first").alias("first")).select("first")
    return keep_rows(docs, firsts, id_col, text_col)
