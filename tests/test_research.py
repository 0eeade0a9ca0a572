import os
import time
from collections import namedtuple

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylane.functions import providers
from quarrylane.operators import render, research, scopes
from quarrylane.sources import stores

Row = namedtuple("Row", "key score")


def test_provider_halves_and_retries():
    calls = []

    def odd(texts):
        calls.append(len(texts))
        return [t.upper() for t in texts] if len(texts) < 3 else ["too few"]

    assert providers.call(odd, list("abcde")) == list("ABCDE")
    failures = iter([True, False])

    def flaky(texts):
        if next(failures):
            raise OSError
        return list(texts)

    assert providers.call(flaky, ["x"], wait=0) == ["x"]
    with pytest.raises(ValueError):
        providers.call(lambda t: [], ["x"])


def test_embedder_hashes_a_word_once(monkeypatch):
    words, sha256 = [], providers.hashlib.sha256
    monkeypatch.setattr(providers.hashlib, "sha256", lambda b: words.append(b) or sha256(b))
    first, *more = providers.hashing_embedder(8)(["loan bank Loan", "bank loan loan", "bank"])
    assert sorted(words) == [b"bank", b"loan"] and more[0] == first and sum(map(abs, more[1])) == 1.0


def test_providers_see_few_texts_at_a_time(spark):
    batches = [pa.RecordBatch.from_pydict({"i": list(range(n))}) for n in (7, 0, 3)]
    assert [b.num_rows for b in providers.sliced(iter(batches), 3)] == [3, 3, 1, 3]
    rows = spark.range(250).selectExpr("id", "IF(id % 7 = 0, ' ', concat(id, '. x')) AS t").coalesce(1)
    sizes = {r.id: r.n for r in providers.apply(rows, "id", "t", lambda texts: [len(texts)] * len(texts), "int", batch=100, name="n").collect()}
    assert all(sizes[i] is None for i in range(0, 250, 7)) and max(n or 0 for n in sizes.values()) < 100 and len(sizes) == 250


def test_provider_over_rows(spark):
    rows = spark.createDataFrame([(1, "One. Two."), (2, " "), (3, None)], "id int, t string")
    got = {r.id: r.result for r in providers.apply(rows, "id", "t", providers.first_sentence, "string").collect()}
    assert got == {1: "One.", 2: None, 3: None}
    vectors = {r.id: r.v for r in providers.apply(rows, "id", "t", providers.hashing_embedder(8), "array<double>", name="v").collect()}
    assert abs(sum(x * x for x in vectors[1]) - 1) < 1e-9 and vectors[2] is None


def test_search_finds_the_chunk(spark):
    chunks = spark.createDataFrame([(1, "net interest margin rose with rates", "RY"), (2, "weather and sports", "RY"), (3, "net interest margin fell", "TD")], "key int, text string, bank string")
    vectors = providers.apply(chunks, "key", "text", providers.hashing_embedder(), "array<double>", name="embedding")
    p = research.prepare(spark, "Why did the net interest margin rise with 25 bps higher rates?")
    assert p.metrics[0] == "net interest margin" and "25" not in p.hyde
    got = research.hybrid_search(chunks, vectors, p).collect()
    assert got[0].key == 1
    scope = spark.createDataFrame([("TD",)], "bank string")
    assert {r.key for r in research.hybrid_search(chunks, vectors, p, scope=scope, on=["bank"]).collect()} == {3}


def test_research_stops(spark):
    first = spark.createDataFrame([Row(1, 0.5)])
    more = {"q1": [Row(1, 0.4), Row(2, 0.3), Row(2, 0.1)], "q2": [Row(3, 0.2)]}
    search = lambda q: spark.createDataFrame(more[q])
    assert [r.key for r in research.research(first, lambda rows: (0.1, ["q1"]), search)] == [1, 2]
    assert [r.key for r in research.research(first, lambda rows: (0.1, [f"q{len(rows)}"]), search)] == [1, 2, 3]
    assert [r.key for r in research.research(first, lambda rows: (0.9, ["q1"]), search)] == [1]


def test_rendering(spark):
    lit = F.lit
    cells = F.array(F.struct(lit("A").alias("letter"), lit("v").alias("value")), F.struct(lit("B").alias("letter"), lit("").alias("value")))
    r = spark.range(1).select(
        render.embedding_text(lit("T"), lit(""), lit("body")).alias("a"),
        render.sheet_row_text(lit(3), cells).alias("b"),
        render.truncated(lit("x" * 50), 30).alias("c"),
        render.evidence_type(lit(None).cast("int"), lit(""), lit("s")).alias("d"),
        render.speaker_role(lit("q"), lit(None).cast("string")).alias("e"),
        render.page_text(lit(2), lit("t"), lit("m")).alias("f"),
        scopes.missing_fields({"q": lit(" "), "y": lit(3), "z": lit(None).cast("string")}).alias("g"),
    ).first()
    assert list(r) == ["Section: T. body", "R3: A=v", "x" * 15 + "\n...[truncated]", "section", "analyst", "Page: 2\nTitle: t\nMarkdown: m", ["q", "z"]]


def test_stores(spark, tmp_path):
    assert stores.described(spark, "no_such_table") is None
    assert stores.yaml_rows("- {model: a, layer: b, name: c}\n- {model: a}\n") == [{"model": "a", "layer": "b", "name": "c"}]
    assert len(stores.yaml_rows("x: {model: a, layer: b, name: c}\ny: 3\n")) == 1
    folder = tmp_path / "progress"
    assert stores.archived(str(folder)) is None
    folder.mkdir()
    (folder / "a.json").write_text("{}")
    assert os.path.exists(stores.archived(str(folder))) and not os.listdir(folder)
    path = str(tmp_path / "lock")
    with stores.RunLock(path):
        with pytest.raises(FileExistsError), stores.RunLock(path):
            pass
    assert not os.path.exists(path)
    with pytest.raises(KeyError), stores.RunLock(path):
        raise KeyError
    assert os.path.exists(path)
    os.utime(path, (time.time() - 90_000,) * 2)
    with stores.RunLock(path):
        pass


def test_keyed_provider_halves_on_an_id_mismatch():
    calls = []

    def forgetful(texts):
        calls.append(len(texts))
        return {k: t.upper() for k, t in texts.items() if len(texts) < 3 or k != max(texts)}

    assert providers.call_keyed(forgetful, {i: c for i, c in enumerate("abcde")}) == {i: c for i, c in enumerate("ABCDE")}
    assert calls[0] == 5 and max(calls[1:]) < 5
    with pytest.raises(ValueError):
        providers.call_keyed(lambda t: {"other": 1}, {1: "x"})


def test_a_failing_source_takes_no_other_with_it(spark):
    rows = spark.createDataFrame([(1,), (2,)], "key long")
    broken = rows.select(F.raise_error(F.lit("gone  wrong")).cast("long").alias("key"))
    found, status = research.dispatch({"good": lambda: rows, "bad": lambda: broken, "worse": lambda: 1 / 0})
    assert [(s, t) for s, t, _ in status] == [("good", "success"), ("bad", "error"), ("worse", "error")]
    assert "gone wrong" in status[1][2] and "\n" not in status[1][2]
    assert sorted((r.key, r.source) for r in found.collect()) == [(1, "good"), (2, "good")]
    none, status = research.dispatch({"worse": lambda: 1 / 0})
    assert none is None and status[0][1] == "error"


def test_nine_strategies_look_at_their_own_targets(spark):
    chunks = spark.createDataFrame(
        [(1, "Margin", "net interest margin", ["margin"], ["net interest margin"], "it rose"), (2, "Weather", "", ["rain"], [], "net interest margin of rain"), (3, "Loans", "", [], ["loans"], "nothing")],
        "key long, name string, summary string, keywords array<string>, metrics array<string>, chunk_content string",
    )
    texts = [(1, "content", "net interest margin rose", None), (2, "content", "rain", None), (3, "keyword", "margin", None), (3, "metric", "net interest margin", None), (9, "section_summary", "net interest margin", [1, 3, 7])]
    rows = spark.createDataFrame([(i, k, kind, t, units) for i, (k, kind, t, units) in enumerate(texts)], "i int, key long, embedding_type string, t string, content_unit_ids array<long>")
    vectors = rows.join(providers.apply(rows, "i", "t", providers.hashing_embedder(), "array<double>", name="embedding"), "i").drop("i", "t")
    p = research.Prepared("net interest margin", ("rain today",), ("margin",), ("net interest margin",), "the net interest margin rose")
    names = [s.strategy for s in research.searches(p)]
    assert sorted(set(names)) == ["content_vector", "hyde_vector", "keyword_vector", "metric_vector", "section_summary", "subquery_vector"]
    got = {r.key: r.sources.split(",") for r in research.hybrid_search(chunks, vectors, p).collect()}
    assert set(got) == {1, 2, 3}
    assert got[3] == ["keyword_vector", "metric_vector", "section_summary"]
    assert {"bm25", "keyword_array", "metric_array", "section_summary", "content_vector"} <= set(got[1])
    assert "section_summary" not in got[2] and "bm25" in got[2]
