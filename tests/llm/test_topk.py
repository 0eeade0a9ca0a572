import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import topk

SCHEMA = "vec_id long, embedding array<double>, h int, uid string, salt int"
INF, NAN = float("inf"), float("nan")


def integers(vector):
    if vector is None or any(x is None or not np.isfinite(x) for x in vector):
        return None
    return [int(np.floor(256 * x)) for x in vector]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute(rows, asks, k):
    """Sorted (query, rank, id, score): every row against every other; shorter vectors count as followed by zeros."""
    good = [(i, v) for i, v in ((i, integers(v)) for i, v in rows) if v is not None]
    out = []
    for at, (q, qv) in enumerate(good):
        if q is None or not asks(q):
            continue
        hits = sorted(((-dot(qv, v), i is None, i if i is not None else 0) for j, (i, v) in enumerate(good) if j != at))[:k]
        out += [(q, r, None if null else i, -s) for r, (s, null, i) in enumerate(hits, 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("slices,head,tile_rows", [(2, 16, None), (3, 1, 40), (1, 4, 100)])
def test_matches_brute_force(spark, slices, head, tile_rows):
    rng = np.random.default_rng(4)
    rows = [(i, [round(float(x), 2) for x in rng.normal(size=7)]) for i in range(180)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)]  # many copies of three vectors, queries among them
    got = found(topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 4, slices=slices, head=head, tile_rows=tile_rows))
    assert got == brute(rows, lambda i: i % 20 == 0, 4)


def test_ties_and_wide_queries(spark):
    """A zero query scores 0 with all, so all candidates tie."""
    rows = [(0, [0.0, 0.0])] + [(i, [float(i % 5), 1.0]) for i in range(1, 60)]
    assert found(topk.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, 5, tile_rows=16)) == brute(rows, lambda i: i % 10 == 0, 5)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-1.0, 0.004]), (None, [1.0, 2.0]), (1, None), (2, [NAN, 1.0]), (3, [INF, 1.0]), (4, [None, 1.0]), (100, []), (6, [3.0]), (7, [1.0, 2.0, 9.0]), (150, None)]
    for k in (1, 3, 20):
        assert found(topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k)) == brute(rows, lambda i: i % 50 == 0, k)
    empty = topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.top_k(frame(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(frame(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []


def test_large_components(spark):
    """Products beyond 2**53 stay exact; beyond a 64-bit integer they are refused."""
    rows = [(i, [1.0e6 + i / 256, 3.0]) for i in range(0, 200, 2)]
    assert found(topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, 5)) == brute(rows, lambda i: i % 50 == 0, 5)
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_k(frame(spark, [(0, [1e200]), (1, [1.0])]), F.col("vec_id") % 50 == 0)
