"""Rules of the operators on literal rows, nulls and ties included."""

import pytest
from pyspark.sql import functions as F

from quarrylane.functions import fulltext, text, vectors
from quarrylane.operators import evidence, facts, merge, ordering, retrieval


def values(spark, *exprs):
    return spark.range(1).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()


def test_number_parsing(spark):
    got = values(spark, *[text.parse_number(F.lit(s)) for s in ("$1,234.5", "(12.5)", "n/a", "Q1 2026", None)])
    assert list(got) == [1234.5, -12.5, None, 1.0, None]
    assert values(spark, text.all_numbers(F.lit("Q1 2026: $3,000 and -4.5%")))[0] == [3000.0, -4.5]


def test_slugs_and_keys(spark):
    got = values(spark, text.slug(F.lit("Financial Supp.")), text.metric_key(F.lit("Net Income (adj.)")), text.first_present(F.lit(""), F.lit("x")), text.normalised_year(F.lit("fy2024")), text.period_key(F.lit("Q2 2024")), text.period_key(F.lit("?")))
    assert list(got) == ["Financial-Supp", "net_income_adj", "x", "2024", 2024 * 4 + 2, -1]


def test_natural_order(spark):
    ids = ["page_10.1", "page_2.10", "page_2.1", "page_1.1"]
    rows = spark.createDataFrame([(i,) for i in ids], "c string").orderBy(text.natural_key(F.col("c"))).collect()
    assert [r.c for r in rows] == ["page_1.1", "page_2.1", "page_2.10", "page_10.1"]


def test_terms(spark):
    q = F.lit("How did the net interest margin and CET1 ratio of loans change versus peers?")
    m = text.metric_terms(q)
    assert values(spark, m)[0] == ["cet1", "net interest margin"]
    assert values(spark, text.key_terms(q, m))[0] == ["ratio", "loans", "change", "versus", "peers"]
    assert values(spark, text.merged_terms(F.array(F.lit(" A  b"), F.lit("c")), F.array(F.lit("a B"), F.lit(""))))[0] == ["A b", "c"]


def test_vectors(spark):
    d = values(spark, vectors.cosine_distance(vectors.literal([1, 0]), vectors.literal([1, 0])), vectors.cosine_distance(vectors.literal([1, 0]), vectors.literal([0, 0])), vectors.cosine_distance(vectors.literal([1, 0]), vectors.literal([-2, 0])))
    assert list(d) == [0.0, None, 2.0]


HITS = "strategy string, batch int, scale double, invert boolean, key string, raw double"


def fused(spark, rows, **options):
    return {r.key: round(r.score, 9) for r in retrieval.fuse(spark.createDataFrame(rows, HITS), **options).collect()}


def test_fusion_rules(spark):
    assert fused(spark, [("content_vector", 0, 1.0, True, "a", 0.4)]) == {"a": 0.0}
    assert fused(spark, [("content_vector", 0, 1.0, True, k, 0.0) for k in "ab"]) == {"a": 0.22, "b": 0.22}
    rows = [("keyword_vector", 0, 1.0, True, "a", 0.2), ("keyword_vector", 0, 1.0, True, "a", 0.5), ("keyword_vector", 0, 1.0, True, "b", 0.8)]
    assert fused(spark, rows) == {"a": 0.15, "b": 0.0}
    assert fused(spark, rows, dedupe_hits=True)["a"] == 0.075
    assert abs(sum(retrieval.WEIGHTS.values()) - 1) < 1e-12


def test_gap_fill(spark):
    anchors = spark.createDataFrame([("f", 1), ("f", 4), ("f", 8), ("g", 3)], "file string, page int")
    assert sorted(tuple(r) for r in retrieval.gap_fill(anchors, "file", "page").collect()) == [("f", 2), ("f", 3)]


def test_cap_and_floor(spark):
    rows = spark.createDataFrame([(i, i < 4) for i in range(7)], "page int, anchor boolean")
    got = retrieval.capped(rows, 5, "anchor", "page").orderBy("slot").collect()
    assert [r.page for r in got] == [0, 1, 2, 3, 4]
    pool = spark.createDataFrame([(i, 1.0 - i / 20) for i in range(12)], "key int, score double")
    kept = retrieval.rerank(pool, F.col("key") % 2 == 0, "score", "key").collect()
    assert retrieval.rerank(pool, F.col("key") % 2 == 0, "score", "key", gate=12).count() == 12
    assert len(kept) == 10 and {0, 2, 4, 6} <= {r.key for r in kept} and 8 not in {r.key for r in kept}


def test_sessions(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate("aqaqqa")], "c int, t int, k string")
    got = ordering.sessionise(rows, ["c"], ["t"], F.col("k") == "q").orderBy("t").collect()
    assert [r.session for r in got] == [1, 2, 2, 3, 4, 4]


@pytest.mark.parametrize("sizes, want", [([4, 4, 4, 20, 1], [0, 0, 1, 2, 3]), ([], []), ([30], [0]), ([0, 10, 1], [0, 0, 1])])
def test_greedy_batches(spark, sizes, want):
    rows = spark.createDataFrame([("f", i, s) for i, s in enumerate(sizes)], "f string, i int, n long")
    got = ordering.batched(rows, "f", "i", "n", 10).orderBy("i").collect()
    assert [r.batch for r in got] == want


def test_versions(spark):
    rows = spark.createDataFrame([("p", "raw", 9), ("p", "final", 2), ("p", "corrected", 1), ("q", "??", 1)], "p string, kind string, v int")
    assert {r.p: r.kind for r in ordering.best_version(rows, ["p"], "kind", merge.VERSION_PRIORITY, "v").collect()} == {"p": "corrected", "q": "??"}


def test_manifest_diff_partitions_keys(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_id string, hash string")
    old = spark.createDataFrame([("b", "x", "s"), ("c", "3", "s"), ("d", "4", "s"), ("e", "5", "other")], "file_id string, hash string, source string")
    got = {r.file_id: (r.process, r.remove_reason) for r in merge.manifest_diff(new, old, "file_id", "hash", "s").collect()}
    assert got == {"a": (True, None), "b": (True, "modified"), "c": (False, None), "d": (False, "removed")}


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 1, ["x"]), ("b", 2, None)], "k string, v int, names array<string>")
    new = spark.createDataFrame([("b", 9, ["y"]), ("c", 3, ["z", "z"])], "k string, v int, names array<string>")
    got = {r.k: (r.v, r.names) for r in merge.upsert_union(old, new, ["k"], "names").collect()}
    assert got == {"a": (1, ["x"]), "b": (9, ["y"]), "c": (3, ["z"])}
    assert {r.k for r in merge.deleted(old, F.col("names").isNull()).collect()} == {"a"}


def test_tolerance(spark):
    points = spark.createDataFrame([(1, 7, 1000.0), (2, 8, 1000.0), (3, 9, 1.0)], "point_id int, evidence_id int, value double")
    numbers = spark.createDataFrame([(7, 1000.9), (8, 1001.2), (7, 5.0)], "evidence_id int, number double")
    assert {r.point_id: r.grounded for r in facts.grounded(points, numbers).collect()} == {1: True, 2: False, 3: False}


def test_composition_and_delta(spark):
    parts = spark.createDataFrame([("g", "a", 60.0), ("g", "b", 39.0), ("g2", "a", 101.0)], "x string, y string, v double")
    assert all(r.is_percent for r in facts.composition(parts, ["x"], "v").collect())
    d = facts.delta(spark.createDataFrame([("b", 1, 10.0), ("b", 2, 13.0)], "bank string, p int, v double"), ["bank"], "p", "v").first()
    assert (d.delta, d.start_value, d.end_value) == (3.0, 10.0, 13.0)


def test_status_rule(spark):
    got = values(spark, *[evidence.status(F.lit(f), F.lit(g)) for f, g in ((True, True), (True, False), (False, True))])
    assert list(got) == ["partial_success", "success", "no_available_data"]


def test_phrase_needs_consecutive_words(spark):
    docs = spark.createDataFrame([(1, "Net interest margin rose"), (2, "net of interest margin"), (3, None), (4, "of the of the")], "id int, t string")
    postings = fulltext.weighted_postings(docs, "id", {"t": "C"})
    assert [tuple(r) for r in fulltext.phrase_matches(postings, "id", "net interest").collect()] == [(1, 0)]
    assert sorted(tuple(r) for r in fulltext.phrase_matches(postings, "id", "of the").collect()) == [(4, 0), (4, 2)]
    assert fulltext.bm25(docs, "id", "t", ["margin"]).count() == 2


def test_empty_inputs(spark):
    none = spark.createDataFrame([], HITS)
    assert retrieval.fuse(none).collect() == []
    assert fulltext.bm25(spark.createDataFrame([], "id int, t string"), "id", "t", ["x"]).collect() == []


def test_cover_rank_counts_places_of_words_and_phrases(spark):
    texts = ["Of the with of  THE.", "withal of-the the the the", "", None, "of them with1 with"]
    rows = spark.createDataFrame([(t, t) for t in texts], "name string, body string")
    rank = fulltext.cover_rank({"name": "A", "body": "C"}, '"of the" OR with OR "the the"')
    places = [3, 4, 0, 0, 1]
    assert [round(r.r, 9) for r in rows.select(rank.alias("r")).collect()] == [round(1.2 * n, 9) for n in places]
    assert fulltext.query_terms('"net income" OR revenue') == [["net", "income"], ["revenue"]]


def test_families_members_and_sheets(spark):
    from quarrylane.operators import chunking

    units = spark.createDataFrame([("a", "text", ["x", " ", None]), ("a", " ", None), ("b", None, [])], "bank string, text string, words array<string>")
    got = {(r.bank, r.family): (r.n_texts, r.batches) for r in chunking.embedding_families(units, ["bank"], {"content": F.array("text"), "keyword": F.col("words")}, 2).collect()}
    assert got == {("a", "content"): (1, 1), ("a", "keyword"): (1, 1), ("b", "content"): (0, 0), ("b", "keyword"): (0, 0)}
    sections = spark.createDataFrame([(1, [1, 2, 2, None]), (2, None), (3, [])], "id long, members array<long>")
    chunks = spark.createDataFrame([(1,), (None,)], "key long")
    assert sorted(map(tuple, merge.list_orphans(sections, "id", "members", chunks, "key").collect()), key=str) == [(1, 2), (1, None)]
    cells = spark.createDataFrame([(1, "=A1", None), (1, "=A2", "3"), (2, None, None)], "sheet long, formula string, value string")
    sheets = spark.createDataFrame([(1, "Capital"), (2, " VARIABLES "), (3, None)], "sheet long, title string")
    assert sorted(map(tuple, chunking.workbook_findings(cells, sheets, ["sheet"], "title").collect())) == [(1, "formula_cache_missing", "medium", 1), (2, "system_sheet_emitted", "high", 1)]
