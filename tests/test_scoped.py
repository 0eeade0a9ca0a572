"""Many questions over many scopes against each searched by itself."""

import numpy as np

from quarrylane.operators import research, retrieval, scoped

ON = ["bank", "quarter"]
CHUNKS = "key long, bank string, quarter string, name string, summary string, keywords array<string>, metrics array<string>, chunk_content string"


def tables(spark):
    rng = np.random.default_rng(3)
    words = ["loan", "growth", "risk", "capital", "ratio", "margin"]
    text = lambda: " ".join(rng.choice(words, 6))
    chunks = [(i, f"b{i % 3}", f"Q{i % 2}", text(), None, [str(rng.choice(words))], None, text()) for i in range(60)]
    kinds = ["content", "keyword", "metric"]
    vectors = [(i, kinds[i % 3], [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(1, "content", None), (2, "content", [0.0] * 4), (3, "content", [1.0, 2.0]), (999, "content", [1.0] * 4)]
    return spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(vectors, "key long, embedding_type string, embedding array<float>")


def questions():
    near = lambda *v: [float(x) for x in v]
    search = retrieval.VectorSearch
    return [
        scoped.Question("one", [search("content_vector", "content", near(1, 0, 0, 0)), search("keyword_vector", "keyword", near(0, 1, 0, 0))], "loan OR growth", ["risk"], []),
        scoped.Question("two", [search("content_vector", "content", near(0, 0, 1, 1)), search("subquery_vector", None, near(1, 1, 0, 0), 1, 0.5)], "capital", [], []),
        scoped.Question("none", [], "", [], []),
    ]


def test_each_scope_and_question_is_a_search_of_its_own(spark):
    chunks, vectors = tables(spark)
    limits = {("b0", "Q0"): 3, ("b1", "Q1"): 5, ("b2", "Q0"): 2, ("nobody", "Q0"): 4}
    scopes = spark.createDataFrame([(b, q, k) for (b, q), k in limits.items()], "bank string, quarter string, k int")
    got = {}
    for r in scoped.search(chunks, vectors, questions(), scopes, ON).orderBy("rank").collect():
        got.setdefault((r.bank, r.quarter, r.question), []).append((r.key, round(r.score, 9), r.sources))
    want = {}
    for (bank, quarter), k in limits.items():
        mine = chunks.where(f"bank = '{bank}' and quarter = '{quarter}'")
        own = vectors.join(mine.select("key"), "key", "left_semi").where("embedding is not null and size(embedding) = 4")
        for q in questions():
            hits = [retrieval.vector_hits(own, list(q.searches), k)] if q.searches else []
            hits += [retrieval.text_hits(mine, q.query, q.keywords, q.metrics, k)] if q.query else []
            if hits:
                both = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
                if rows := retrieval.top(retrieval.fuse(both), k).collect():
                    want[bank, quarter, q.name] = [(r.key, round(r.score, 9), r.sources) for r in rows]
    assert got == want and len(want) == 6


def test_no_scope_and_no_question(spark):
    chunks, vectors = tables(spark)
    scopes = spark.createDataFrame([("b0", "Q0", 3)], "bank string, quarter string, k int")
    assert scoped.search(chunks, vectors, questions(), scopes.where("false"), ON).collect() == []
    assert scoped.search(chunks, vectors, questions()[2:], scopes, ON).collect() == []


def test_prepared_question(spark):
    q = scoped.Question.prepared("p", research.Prepared("what drove loan growth", (), ("loan", "growth"), ("net interest margin",), "loan growth"))
    assert {s.strategy for s in q.searches} == {"content_vector", "section_summary", "hyde_vector", "keyword_vector", "metric_vector"}
    assert "loan" in q.query and q.metrics == ("net interest margin",)


def test_fillers_stay_in_their_scope(spark):
    found = spark.createDataFrame([("b", "Q", "one", k, 1.0, "x", r) for r, k in enumerate((1, 4, 9))], "bank string, quarter string, question string, key long, score double, sources string, rank int")
    pages = spark.createDataFrame([(k, "b", "R" if k == 3 else "Q", "f", k) for k in range(1, 12)], "key long, bank string, quarter string, file_id string, page long")
    rows = scoped.expanded(found, pages, ON).orderBy("slot").collect()
    assert [(r.key, r.anchor, r.slot) for r in rows] == [(1, True, 1), (4, True, 2), (9, True, 3), (2, False, 4)]
