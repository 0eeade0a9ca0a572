"""Scans with groups cut over parts: the same as a loop, whatever the parts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import ordering, scans
from quarrylane.streaming import progress


@pytest.fixture
def many_parts(spark):
    """Parts of a few rows, so that groups are cut."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def made(seed, hot=60):
    """A hot group, small ones and one of nulls: (group, order, kind, size)."""
    r = random.Random(seed)
    groups = ["hot"] * hot + ["a"] * 5 + ["b"] + [None] * 7
    return [(g, i, r.choice(["q", "x", None]), r.choice([0, 0, 1, 3, 4, 9, 14, None])) for i, g in enumerate(groups)]


def frame(spark, rows):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, i int, k string, n long")


def by_group(rows):
    return {g: list(own) for g, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0])}


def test_groups_are_cut(many_parts):
    placed = scans.spread(frame(many_parts, made(0)), ["g"], ["i"])
    assert [r.g for r in scans.spanning(placed, ["g"]).collect()] == ["hot"]
    sizes = [r["count"] for r in placed.groupBy(scans.PART).count().collect()]
    assert len(sizes) > 3 and max(sizes) <= 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("seed", [1, 2])
def test_running_values(many_parts, seed):
    rows = made(seed)
    want = []
    for g, own in by_group(rows).items():
        total, session, before = 0, 1, None
        for at, (_, i, k, n) in enumerate(own):
            total += n or 0
            session += at > 0 and k == "q"
            want.append((g, i, at + 1, total, session, at > 0, before))
            before = k
    df = frame(many_parts, rows)
    found = scans.scan(df, ["g"], ["i"], {"at": scans.row_count(), "total": scans.running_sum(F.col("n")), "p": scans.previous(F.col("k"))})
    sessions = {(r.g, r.i): r.session for r in ordering.sessionise(df, ["g"], ["i"], F.col("k") == "q").collect()}
    key = lambda r: (r[0] or "", r[1])
    got = [(r.g, r.i, r["at"], r.total, sessions[r.g, r.i], r.p is not None, r.p and r.p.x) for r in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    changed = {(g, i) for g, own in by_group(rows).items() for at, (_, i, k, _) in enumerate(own) if at == 0 or k != own[at - 1][2]}
    assert {(r.g, r.i) for r in progress.changes(df, ["g"], ["i"], "k").collect()} == changed


@pytest.mark.parametrize("seed, budget", [(3, 10), (4, 1), (5, 40)])
def test_batches(many_parts, seed, budget):
    rows = made(seed)
    want = {}
    for g, own in by_group(rows).items():
        batch, total = 0, 0
        for _, i, _, n in own:
            if total > 0 and total + (n or 0) > budget:
                batch, total = batch + 1, 0
            total += n or 0
            want[g, i] = (n, batch)
    assert {(r.g, r.i): (r.n, r.batch) for r in ordering.batched(frame(many_parts, rows), "g", "i", "n", budget).collect()} == want


def test_no_rows_and_clashes(spark):
    empty = spark.createDataFrame([], "g string, i int, k string, n long")
    assert ordering.numbered(empty, ["g"], ["i"], "at").columns == ["g", "i", "k", "n", "at"]
    assert ordering.numbered(empty, ["g"], ["i"], "at").count() == ordering.batched(empty, "g", "i", "n", 5).count() == 0
    with pytest.raises(ValueError, match="there already"):
        ordering.numbered(empty, ["g"], ["i"], "k")
