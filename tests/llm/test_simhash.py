import numpy as np
import xxhash

from quarrylane.llm import simhash
from tests.llm.fixtures import DOC_SCHEMA, awkward, docs

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, f) in enumerate(prints):
        for j, g in prints[:n]:
            if (f ^ g).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_matches_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    want_print = [(r.doc_id, plain_fingerprint(r.text)) for r in table.select("doc_id", "text").collect()]
    want = plain_components(want_print)
    got = simhash.near_duplicates(table).collect()
    assert len(got) == table.count()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in want_print}
    assert {r.doc_id: r.component_id for r in got} == want


def test_segments_leave_one_with_at_most_one_bit():
    bounds = simhash.segment_bounds()
    assert sum(w for _, w in bounds) == 64 and len(bounds) == 3


def test_spanning_links_connect_what_pairs_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 40, 5).astype(np.uint64)) for _ in range(60)] + [base]))
    a, b = simhash.spanning_links(fps)
    assert (np.bitwise_count(a ^ b) <= 64).all()
    want = plain_components([(int(f), int(f)) for f in fps])
    root = {int(f): int(f) for f in fps} | dict(zip(map(int, a), map(int, b), strict=True))
    assert len({want[f] for f in want}) == len({root[f] for f in root})


def test_large_buckets_are_compared_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for i, j, k in rng.integers(0, 60, (200, 3))})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    one = {tuple(r) for r in _roots(simhash.links(table))}
    many = {tuple(r) for r in _roots(simhash.links(table, block_rows=20))}
    assert one == many


def _roots(links):
    from quarrylane.llm.staging import components

    return components(links).collect()


def test_awkward_rows(spark):
    table = awkward(spark)
    got = simhash.near_duplicates(table).collect()
    assert len(got) == table.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == "0" * 16 and by_id[2].component_id == 1 and by_id[6].component_id == 1
    assert by_id[None].component_id is None
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "None"]


def test_keep_first_tells_rows_apart_by_text(spark):
    """Unrelated texts without an id, or under one id, stay; copies go."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 60)) for _ in range(22)]
    rows = [(None if i < 20 else 5, t, "en", "src0", 1) for i, t in enumerate(texts)]
    kept = simhash.keep_first(spark.createDataFrame([*rows, *rows], DOC_SCHEMA)).collect()
    assert sorted(r.text for r in kept) == sorted(texts)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_copies_stay_together(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 500, 400)]
    near = list(words)
    near[200] = "changed"
    table = docs(spark, [" ".join(words), " ".join(near), " ".join(words[::-1])])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
    assert got[2] == 2 and got[0] == 0
