"""Reviews by scope, groups in order of sight, rows to embed, planned charts and slots, on small fixtures."""

import pytest

from quarrylane.operators import charts, chunking, ordering, review


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("[0, 2]", [0, 2]),
        ('["3", " 4 ", "x", "-1", ""]', [3, 4]),
        ("[1.0, 1.5, 1, true, null, [2], {}]", [1]),
        ("[]", []),
        ('{"remove": [1]}', None),
        ("remove 1", None),
        ("[1] is my answer", None),
        ("[1], [2]", None),
        ("", None),
        (None, None),
    ],
)
def test_indices_of_an_answer(spark, answer, want):
    rows = spark.createDataFrame([(answer,)], "a string")
    assert rows.select(review.removals(rows.a).alias("r")).first().r == want


def reviewed(spark, n, answer, scope="s"):
    hits = spark.createDataFrame([(scope, i, 100.0 - i, "x") for i in range(n)], "scope string, key int, score double, rank_note string")
    answers = spark.createDataFrame([(scope, answer)], "scope string, answer string")
    rows = review.reviewed(hits, answers, ["scope"], "score", "key").orderBy("rank").collect()
    return [r.key for r in rows], [r.key for r in rows if r.restored]


def test_review(spark):
    assert reviewed(spark, 20, "[0, 1]") == (list(range(20)), [])  # so few need no review
    assert reviewed(spark, 21, "[0, 1]") == (list(range(2, 21)), [])
    assert reviewed(spark, 50, "[0, 45, 29]")[0] == list(range(1, 21))  # 45 is no place in the pool
    assert reviewed(spark, 50, "no list") == (list(range(20)), [])
    assert reviewed(spark, 50, str(list(range(25)))) == ([0, 1, 2, 3, 4, 25, 26, 27, 28, 29], [0, 1, 2, 3, 4])
    assert reviewed(spark, 25, str(list(range(25)))) == (list(range(10)), list(range(10)))
    assert reviewed(spark, 25, "[0]", scope=None) == (list(range(1, 21)), [])
    assert reviewed(spark, 0, "[0]") == ([], [])


def test_groups_in_order_of_sight(spark):
    rows = [("s", k, i) for i, k in enumerate("bbaacbaa")] + [(None, None, 1), (None, "z", 0), (None, None, 2)]
    table = spark.createDataFrame(rows, "scope string, key string, pos int")
    got = {(r.scope, r.pos): (r.group_no, r.place) for r in ordering.grouped_by_first(table, ["scope"], ["key"], "pos").collect()}
    want, seen, counts = {}, {}, {}
    for scope, key, pos in sorted(rows, key=lambda r: (r[0] or "", r[2])):
        groups = seen.setdefault(scope, {})
        no = groups.setdefault(key, len(groups) + 1)
        counts[scope, key] = counts.get((scope, key), 0) + 1
        want[scope, pos] = (no, counts[scope, key])
    assert got == want
    assert ordering.grouped_by_first(table.limit(0), ["scope"], ["key"], "pos").collect() == []


def test_rows_to_embed(spark):
    units = spark.createDataFrame(
        [("d", "1", 7, "text", ["a", None, "b"]), ("d", "1", 5, " ", None), ("d", None, 9, "more", [])], "document_id string, section_id string, unit_id int, content string, words array<string>"
    )
    sections = spark.createDataFrame([("d", "1", "first"), ("d", "2", "empty"), ("d", "3", " ")], "document_id string, section_id string, summary string")
    documents = spark.createDataFrame([("d", "all"), ("e", None), ("f", "none")], "document_id string, summary string")
    rows = {r.embedding_id.split("::keyword::001")[0]: r for r in chunking.index_rows(units, sections, documents, {"keyword": "words"}).collect()}
    scopes = sorted((r.embedding_scope, r.embedding_type, r.text, tuple(r.unit_ids)) for r in rows.values())
    assert scopes == [
        ("content_unit", "content", "more", (9,)), ("content_unit", "content", "text", (7,)), ("content_unit", "keyword", "a", (7,)), ("content_unit", "keyword", "b", (7,)),
        ("document", "document_summary", "all", (5, 7, 9)), ("document", "document_summary", "none", ()), ("section", "section_summary", "empty", ()), ("section", "section_summary", "first", (5, 7)),
    ]


def test_subjects_of_a_question(spark):
    assert charts.subjects("Show the trend of NIM in 2024 for RBC") == ["interest", "margin", "net", "nim", "spread"]
    assert charts.subjects("Compare banks in Q1 2024") == []
    shown = spark.createDataFrame([("Net interest margin",), ("Loans",), (None,)], "shown string")
    assert [r[0] for r in shown.select(charts.relevant(shown.shown, "nim?")).collect()] == [True, False, False]
    assert [r[0] for r in shown.select(charts.relevant(shown.shown, "Compare banks")).collect()] == [True] * 3


FACT = "pos int, bank string, period int, metric_key string, unit string, value double"
SLOT = "slot_id int, chart_type string, banks array<string>, periods array<int>, metrics array<string>, evidence_ids array<int>"
CANDIDATE = "slot_id int, candidate_id int, chart string, score int, used_ids array<int>"


def test_charts_of_slots(spark):
    facts = spark.createDataFrame(
        [(i, bank, period, metric, unit, float(i)) for i, (bank, period, metric, unit) in enumerate(
            [("RY", 1, "cet1 ratio", "%"), ("TD", 1, "cet1 ratio", "%"), ("RY", 2, "cet1 ratio", "%"), ("RY", 1, "revenue", "$"), ("RY", 2, "revenue", "$"), ("TD", 1, "roe", "%")])],
        FACT,
    )
    slots = spark.createDataFrame(
        [
            (1, "small_multiple_panel", ["ry", "RY"], [], None, [1]),  # two metrics over two periods
            (2, "small_multiple_panel", ["RY"], [], ["cet1"], [1]),  # one series is no panel, and nothing else fits
            (3, "peer_rank_bar", ["RY", "TD"], [1], ["CET1 ratio, reported"], [1]),  # own facts
            (4, "peer_rank_bar", ["RY", "TD"], [1], [], [1]),  # a candidate comes before own facts
            (5, "trend_line", ["RY"], None, ["revenue"], None),
            (6, "multi_series_line", ["RY", "TD"], [1, 2], None, [1]),
            (7, "trend_line", [], [1], None, [1]),
        ],
        SLOT,
    )
    candidates = spark.createDataFrame(
        [(4, 10, "peer_rank_bar", 5, [1]), (4, 11, "peer_rank_bar", 5, [1]), (4, 9, "peer_rank_bar", 9, [2]), (4, 8, "heatmap", 9, [1]), (4, 7, "peer_rank_bar", 9, []), (3, 6, "peer_rank_bar", 9, None), (7, 5, "trend_line", 1, [1])],
        CANDIDATE,
    )
    got = {r.slot_id: r for r in charts.slot_charts(slots, facts, candidates).collect()}
    assert {k: (r.tier, r.candidate_id, r.metric_key, r.unit) for k, r in got.items()} == {
        1: ("panel", None, None, None), 3: ("facts", None, "cet1 ratio", "%"), 4: ("candidate", 10, None, None), 5: ("facts", None, "revenue", "$"), 6: ("facts", None, "cet1 ratio", "%"), 7: ("candidate", 5, None, None),
    }
    assert [(s.metric_key, s.unit, [(p.label, p.value) for p in s.points]) for s in got[1].series] == [("cet1 ratio", "%", [("1", 0.0), ("2", 2.0)]), ("revenue", "$", [("1", 3.0), ("2", 4.0)])]
    empty = charts.slot_charts(slots.limit(0), facts, candidates)
    assert empty.collect() == []


def test_panels_keep_first_series_and_points(spark):
    facts = spark.createDataFrame([(1, "small_multiple_panel", p, "RY", p, f"m{m}", "%", 1.0) for m in range(9) for p in range(50)], "slot_id int, chart_type string, " + FACT)
    series = charts.panels(facts).first().series
    assert [s.metric_key for s in series] == [f"m{m}" for m in range(6)] and {len(s.points) for s in series} == {40}
    assert [p.period for p in series[0].points] == list(range(40))


def test_slots_that_ask_for_the_same_share_their_facts(spark, monkeypatch):
    asked, looked_up = [], charts.facts_of_slots
    monkeypatch.setattr(charts, "facts_of_slots", lambda slots, facts: asked.append(slots.count()) or looked_up(slots, facts))
    slots = spark.range(200).selectExpr("id AS slot_id", "'peer_rank_bar' AS chart_type", "array(1L) AS evidence_ids", "array('RY', 'TD') AS banks", "array(1) AS periods", "IF(id % 2 = 0, array('cet1'), NULL) AS metrics")
    facts = spark.createDataFrame([(1, "RY", 1, "cet1", "%", 1.0), (2, "td", 1, "cet1", "%", 2.0), (0, "RY", 1, "roe", "%", 1.0), (3, "TD", 1, "roe", "%", 1.0)], FACT)
    none = spark.createDataFrame([], "slot_id long, candidate_id long, chart string, score long, used_ids array<long>")
    got = charts.slot_charts(slots, facts, none).collect()
    assert asked == [2]
    assert sorted((r.slot_id, r.tier, r.metric_key) for r in got) == [(i, "facts", "roe" if i % 2 else "cet1") for i in range(200)]
