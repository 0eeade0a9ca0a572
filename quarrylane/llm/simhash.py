"""SimHash near-dedup by deletion-variant signatures.

A fingerprint is the bitwise majority over the XXH64 values of a text's word
shingles. Two fingerprints of 64 bits that differ in at most ``max_bits`` bits,
cut into ``max_bits // 2 + 1`` segments, have a segment that differs in at most
one bit. So each fingerprint is indexed under every segment with every one of
its bits taken out ("one wildcard"), 64 keys in all, and an equality join on
the keys finds every pair that may link; each is verified on all 64 bits.

Equal fingerprints are joined before that, so groups of exact copies cost one
row. In a bucket only a spanning forest of the verified links is emitted, so
output stays linear in the bucket; buckets over ``block_rows`` rows are cut into
blocks and compared block pair by block pair in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from operator import getitem

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.staging import components, discard, staged

SEED = 42
MAX_BITS = 4
SHINGLE_WORDS = 4
BLOCK_ROWS = 8192
#: Groups up to this size are compared by shifting the sorted rows, larger ones by a search.
SMALL_GROUP = 16
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), _CHUNK):
        first, last = starts[at : at + _CHUNK].tolist(), ends[k - 1 + at : k - 1 + at + _CHUNK].tolist()
        spans = map(getitem, repeat(joined), map(slice, first, last))
        out[at : at + _CHUNK] = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), dtype=np.uint64, count=len(first))
    return out


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        for low in range(0, len(bits), 255):
            counts += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 for null and for a text without words."""
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``id``, ``h`` (a hash of the text) and ``fp`` (the fingerprint as a signed long) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["id", "h", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t")).mapInArrow(run, "id long, h long, fp long")


def segment_bounds(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment: as few as leave one with at most one differing bit."""
    parts = max_bits // 2 + 1
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def variant_keys(fp: Column, max_bits: int = MAX_BITS) -> Column:
    """Array of 64 long keys: number of the bit taken out in the top bits, then what is left of its segment."""
    keys = []
    for low, width in segment_bounds(max_bits):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            keys.append(rest.bitwiseOR(F.lit((low + bit) << 56)))
    return F.array(*keys)


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links that span the link graph of the distinct fingerprints ``fps``.

    Walks each component outwards: what a member reaches leaves the rest at
    once, so a dense group costs little more than its size.
    """
    left, members, roots = fps, [], []
    while left.size > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and left.size:
            near = np.bitwise_count(left ^ queue.pop()) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                members.append(found)
                roots.append(np.full(found.size, root))
                queue.extend(found)
    if not members:
        return np.empty(0, fps.dtype), np.empty(0, fps.dtype)
    return np.concatenate(members), np.concatenate(roots)


def _link_groups(max_bits: int):
    """Links within runs of equal keys; batches come sorted by key, and a run may go on in the next one."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        found_a, found_b = [], []
        size_of = np.repeat(sizes, sizes)
        small = np.flatnonzero((size_of > 1) & (size_of <= SMALL_GROUP))
        k, f = keys[small], fps[small]
        for d in range(1, SMALL_GROUP):
            if len(k) <= d:
                break
            hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= max_bits))
            found_a.append(f[hit + d])
            found_b.append(f[hit])
        for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
            a, b = spanning_links(np.unique(fps[start : start + size]), max_bits)
            found_a.append(a)
            found_b.append(b)
        if found_a and (a := np.concatenate(found_a)).size:
            pairs = np.unique(np.stack([a, np.concatenate(found_b)], axis=1), axis=0)
            columns = [pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k: list[np.ndarray] = []
        rest_f: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            last = int(np.searchsorted(k, k[-1])) if k[0] != k[-1] else 0
            if last or (rest_k and rest_k[-1][-1] != k[0]):
                yield from links(np.concatenate([*rest_k, k[:last]]), np.concatenate([*rest_f, f[:last]]))
                rest_k, rest_f = [], []
            rest_k.append(k[last:])
            rest_f.append(f[last:])
        if rest_k:
            yield from links(np.concatenate(rest_k), np.concatenate(rest_f))

    return run


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly what pairs at most ``max_bits`` bits apart connect.

    ``distinct_fps``: one column ``fp``, each value once.
    """
    variants = distinct_fps.select("fp", F.explode(variant_keys(F.col("fp"), max_bits)).alias("key"))
    large = staged(variants.groupBy("key").count().where(F.col("count") > block_rows), "large_buckets")
    n_large = large.count()
    keyed = variants.select("key", "fp")
    if n_large:
        # A row of a large bucket goes to each pair of blocks that its own block is in.
        blocks = large.select("key", F.ceil(F.col("count") / block_rows).cast("long").alias("g"))
        if n_large <= 100_000:
            blocks = F.broadcast(blocks)
        own = F.pmod(F.xxhash64("fp"), F.col("g"))
        tagged = keyed.join(blocks, "key", "left").withColumn("own", own)
        pairs = F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.least(o, F.col("own")) * F.col("g") + F.greatest(o, F.col("own")) + 1)
        )
        keyed = tagged.select(F.explode(pairs).alias("pair"), "key", "fp").select(
            F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), "fp"
        )
    found = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_groups(max_bits), "a long, b long")
    out = staged(found.distinct(), "links")
    discard(large)
    return out


def _rooted(prints: DataFrame, max_bits: int, block_rows: int) -> DataFrame:
    """``fp``, ``root`` (the component's fingerprint) and ``first`` (its first row: smallest id, then text hash; a null id comes last) of every fingerprint."""
    own = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("own_first")
    distinct = staged(prints.groupBy("fp").agg(own), "distinct")
    roots = components(links(distinct.select("fp"), max_bits, block_rows))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "own_first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("own_first").alias("first"))
    return rooted.join(firsts, "root").select("fp", "root", "first")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
    shingle_words: int = SHINGLE_WORDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own
    included. A null or wordless text has fingerprint zero and links like any
    other. A row with a null id keeps its row; its id counts as larger than all
    others, and a component of such rows alone has a null ``component_id``.
    Repeated ids stay repeated rows. Other columns are not looked at, and an
    empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    of_print = _rooted(prints, max_bits, block_rows).select("fp", F.col("first.id").alias("component_id"))
    return prints.join(of_print, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``first.id`` and ``first.h``, with all columns; of rows equal in both, one."""
    kept = firsts.select(F.col("first.id").alias("__ql_id"), F.col("first.h").alias("__ql_h"))
    keyed = docs.withColumns({"__ql_row_id": F.col(id_col).cast("long"), "__ql_row_h": F.xxhash64(F.col(text_col).cast("string"))})
    same = F.col("__ql_row_id").eqNullSafe(F.col("__ql_id")) & (F.col("__ql_row_h") == F.col("__ql_h"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__ql_row_id", "__ql_row_h"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    Rows are told apart by their fingerprints, not by their ids: each group
    keeps its row with the smallest id, of equal ids the one with the smallest
    text hash; a null id comes after all others.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    return keep_rows(docs, _rooted(prints, max_bits, block_rows).select("first").distinct(), id_col, text_col)
