"""Versioned tables: concurrent writers, crashes between staging and commit, pinned readers, streams of files."""

import threading

import pytest
from pyspark.sql import functions as F

from quarrylane.sources import versions
from quarrylane.streaming import incremental


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def pairs(spark, root, table="t", version=None):
    v = versions.pin(spark, root, version)
    return sorted((r.k, r.n) for r in versions.rows(spark, root, v, table).collect())


def test_change_and_returning(spark, root):
    versions.insert(spark, root, "t", spark.range(6).selectExpr("id AS k", "id * 10 AS n"))
    versions.insert(spark, root, "t", spark.createDataFrame([(7,)], "k long"))
    before = versions.pin(spark, root)
    out = versions.update(spark, root, "t", F.col("n") >= 30, {"n": F.col("n") + F.col("k")})
    assert sorted((r.k, r.n) for r in out.changed.collect()) == [(3, 33), (4, 44), (5, 55)]
    untouched = [s for s in before.tables["t"]["segments"] if s in out.version.tables["t"]["segments"]]
    assert len(untouched) == 1
    gone = versions.delete(spark, root, "t", F.col("n") < 20)
    assert sorted(r.k for r in gone.changed.collect()) == [0, 1]
    assert sorted(r.k for r in versions.rows(spark, root, gone.version, "t").collect()) == [2, 3, 4, 5, 7]
    assert versions.update(spark, root, "t", F.col("k") > 99, {"n": F.lit(0)}).changed.count() == 0
    assert versions.pin(spark, root).number == gone.version.number
    assert pairs(spark, root, version=1) == [(i, i * 10) for i in range(6)]
    old = versions.rows(spark, root, before, "t")
    versions.compact(spark, root, "t")
    assert old.count() == 7
    assert sorted(r.k for r in versions.rows(spark, root, versions.pin(spark, root), "t").collect()) == [2, 3, 4, 5, 7]
    assert versions.discard(spark, root) == []
    assert versions.discard(spark, root, min_age_s=-60)
    assert versions.rows(spark, root, versions.pin(spark, root), "t").count() == 5


def test_refusals(spark, root):
    with pytest.raises(ValueError, match="not in version"):
        versions.update(spark, root, "t", F.lit(True), {"n": F.lit(1)})
    versions.insert(spark, root, "t", spark.createDataFrame([], "k long, n long"))
    assert pairs(spark, root) == []
    with pytest.raises(ValueError, match="not in the table"):
        versions.insert(spark, root, "t", spark.createDataFrame([(1, 2)], "k long, x long"))
    with pytest.raises(ValueError, match="not in the table"):
        versions.update(spark, root, "t", F.lit(True), {"x": F.lit(1)})
    with pytest.raises(ValueError, match="empty snapshots"):
        versions.replace(spark, root, {"t": spark.createDataFrame([], "k long, n long")})
    with pytest.raises(ValueError, match="not there"):
        versions.pin(spark, root, 99)


def test_two_writers_and_a_reader(spark, root):
    versions.insert(spark, root, "t", spark.createDataFrame([(0, 0)], "k long, n long"))
    pinned = versions.rows(spark, root, versions.pin(spark, root), "t")
    failed = []

    def add(i):
        try:
            for _ in range(3):
                versions.update(spark, root, "t", F.col("k") == 0, {"n": F.col("n") + 1})
                versions.insert(spark, root, "t", spark.createDataFrame([(i, 1)], "k long, n long"))
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=add, args=(i,)) for i in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert pairs(spark, root) == [(0, 6), (1, 1), (1, 1), (1, 1), (2, 1), (2, 1), (2, 1)]
    assert versions.pin(spark, root).number == 13
    assert [tuple(r) for r in pinned.collect()] == [(0, 0)]


def test_crash_before_commit(spark, root, monkeypatch):
    one = spark.createDataFrame([(0, 0)], "k long, n long")
    versions.replace(spark, root, {"t": one, "u": one})
    with monkeypatch.context() as m:
        m.setattr(versions, "_create_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versions.replace(spark, root, {"t": spark.createDataFrame([(1, 1)], "k long, n long"), "u": one})
    assert pairs(spark, root) == pairs(spark, root, "u") == [(0, 0)]
    versions.replace(spark, root, {"t": spark.createDataFrame([(2, 2)], "k long, n long"), "u": one})
    assert (pairs(spark, root), pairs(spark, root, "u")) == ([(2, 2)], [(0, 0)])


def test_rename_refuses_a_target(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    assert not versions._renamed(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert versions._renamed(spark, str(tmp_path / "a"), str(tmp_path / "c"))
    assert (tmp_path / "c").read_text() == "a"


def parse(files):
    lines = files.select("file_key", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "line"))
    return {"lines": lines, "sizes": files.select("file_key", F.length("content").alias("size")), "words": lines.select("file_key", F.explode(F.split("line", " ")).alias("word"))}


def deliver(folder, delivery, **files):
    for bank, text in files.items():
        at = folder / delivery / "2025_Q1" / bank
        at.mkdir(parents=True, exist_ok=True)
        (at / "call.txt").write_text(text)


def state(spark, root):
    v = versions.pin(spark, root)
    return {t: sorted(map(tuple, versions.rows(spark, root, v, t).drop("arrived").collect())) for t in v.tables}


def test_batches_in_any_order(spark, root):
    batch = lambda *files: spark.createDataFrame(list(files), "file_key string, file_hash string, arrived int, text string")
    texts = lambda f: {"texts": f.select("file_key", "text")}
    apply = lambda i, *files: incremental.apply_batch(batch(*files), i, root, texts)
    apply(0, ("a", "h5", 5, "five"), ("b", "h1", 1, "one"), (None, "h9", 9, "nobody"))
    apply(1, ("a", "h4", 4, "four"), ("b", "h2", 2, "old two"), ("b", "h3", 3, "two"))
    assert state(spark, root)["texts"] == [("a", "five"), ("b", "two")]
    apply(1, ("a", "h9", 9, "applied twice"))
    assert state(spark, root)["texts"] == [("a", "five"), ("b", "two")]
    apply(2, ("a", "h5", 8, "five"))
    last = apply(3, ("a", "h7", 7, "late"))
    assert state(spark, root)["texts"] == [("a", "five"), ("b", "two")]
    assert last.batches == {"files": 3}


def test_stream_of_files(spark, tmp_path, root, monkeypatch):
    folder, at = tmp_path / "in", str(tmp_path / "checkpoint")
    run = lambda: incremental.run_incremental(incremental.file_stream(spark, str(folder)), root, at, parse).awaitTermination()
    deliver(folder, "d1", a="one two\nthree", b="four", c="five")
    (folder / "stray.txt").write_text("stray")
    run()
    first = versions.pin(spark, root)
    deliver(folder, "d2", a="one two\nthree", b="six\nseven", d="eight", e="")

    real = incremental.versions.commit
    with monkeypatch.context() as m:
        def then_die(*args, **kwargs):
            real(*args, **kwargs)
            raise OSError("lost after the commit")

        m.setattr(incremental.versions, "commit", then_die)
        with pytest.raises(Exception, match="lost after the commit"):
            run()
    committed = versions.pin(spark, root)
    run()
    assert versions.pin(spark, root).number == committed.number == first.number + 1
    a, b, c, d = (f"2025_Q1/{x}/call.txt" for x in "abcd")
    assert state(spark, root)["lines"] == [(a, 0, "one two"), (a, 1, "three"), (b, 0, "six"), (b, 1, "seven"), (c, 0, "five"), (d, 0, "eight")]
    assert {k for k, _ in state(spark, root)["manifest"]} == {a, b, c, d}

    other = str(tmp_path / "other")
    for x, text in {"a": "one two\nthree", "b": "six\nseven", "c": "five", "d": "eight"}.items():
        deliver(tmp_path / "whole", "d", **{x: text})
    incremental.run_incremental(incremental.file_stream(spark, str(tmp_path / "whole")), other, str(tmp_path / "cp2"), parse).awaitTermination()
    assert state(spark, other) == state(spark, root)

    incremental.retire(spark, root, spark.createDataFrame([(a,)], "file_key string"), ("lines", "sizes", "words"))
    assert {r[0] for t in state(spark, root).values() for r in t} == {b, c, d}
