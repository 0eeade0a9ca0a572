import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import hard_negatives as H
from tests.llm.test_topk import INF, NAN, dot, integers

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, block int"


def brute(rows, asks, positives=5, negatives=10):
    good = [(i, v, label) for i, v, label in ((i, integers(v), label) for i, v, label in rows) if v is not None and label is not None]
    key = lambda h: (-h[0], h[1] is None, h[1] or 0)
    out = []
    for at, (a, av, label) in enumerate(good):
        if a is None or not asks(a):
            continue
        scored = sorted(((dot(av, v), i, other) for j, (i, v, other) in enumerate(good) if j != at), key=key)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps][:negatives]
            out += [(a, p, r, n, ps, ns) for r, (ns, n, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("spread,block_rows", [(0.1, 25), (1.0, None), (3.0, 60)])
def test_matches_brute_force(spark, spread, block_rows):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [round(float(x), 2) for x in centres[i % 6] + spread * rng.normal(size=5)], int(rng.integers(0, 3))) for i in range(240)]
    rows += [(1000 + i, rows[i % 2][1], i % 3) for i in range(45)]  # copies under all labels, anchors among them
    got = found(H.hard_negatives(frame(spark, rows), F.col("vec_id") % 25 == 0, block_rows=block_rows))
    assert got == brute(rows, lambda i: i % 25 == 0) and got


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.6], 1), (None, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (None, [0.5, 0.4], 3), (4, None, 1), (5, [NAN, 0.0], 1)]
    rows += [(6, [INF, 0.0], 2), (7, [None, 0.0], 2), (8, [0.6, 0.2], None), (9, [], 2), (100, [], 1), (200, [-1.0, -1.0], 1), (300, [0.4], 2), (10, [0.3, 0.3, 4.0], 3)]
    asks = F.col("vec_id") % 100 == 0
    assert found(H.hard_negatives(frame(spark, rows), asks)) == brute(rows, lambda i: i % 100 == 0)
    for few in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]):
        assert found(H.hard_negatives(frame(spark, few), asks)) == brute(few, lambda i: i % 100 == 0)


def test_bounds():
    """What lies within r of an anchor has a key within r of the anchor's distance to the pivot, and distances follow scores."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(300, 6)))
    space = H.Space.fit(v, float(np.linalg.norm(v, axis=1).max()), pivots=4)
    lifted, q = space.lifted(v), np.column_stack([v[:20], np.zeros(20)])
    apart = np.linalg.norm(q[:, None] - lifted, axis=2)
    assert np.allclose(apart**2, (q**2).sum(1)[:, None] + space.reach**2 - 2 * q[:, :-1] @ v.T, atol=1e-3)
    gaps = np.abs(space.distances(q)[:, None, :] - space.distances(lifted)[None])
    assert (gaps <= apart[:, :, None] + space.slack).all()
