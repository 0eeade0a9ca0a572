"""Chart candidates from tables, and availability by overlap of names, on literal rows."""

from pyspark.sql import functions as F

from quarrylane.operators import merge, tables

SCHEMA = "table_id long, title string, summary string, combo string, columns array<string>, rows array<map<string,string>>, evidence_ids array<string>"


def found(spark, columns, rows, title="Figures", combo="Slides: RY Q1 2024", evidence=("E1",), question=""):
    entries = [dict(zip(columns, r, strict=False)) for r in rows]
    table = spark.createDataFrame([(1, title, "", combo, columns, entries, list(evidence))], SCHEMA)
    return {r.chart: r for r in tables.candidates(table, question).collect()}


def values(points):
    return [(p.label, p.value) for p in points]


def test_one_row_over_periods_is_a_trend(spark):
    got = found(spark, ["Metric", "Q2 2024", "Q1 2024"], [["ROE", "12%", "(1.5%)"]], question="trend")
    r = got["trend_line"]
    assert (r.title, r.subtitle, r.unit, r.score) == ("RY ROE trend", "Q1 2024 to Q2 2024 | table-derived", "%", 98)
    assert values(r.series[0].points) == [("Q1 2024", -1.5), ("Q2 2024", 12.0)] and set(got) == {"trend_line"}


def test_rows_over_periods_share_a_unit_or_become_a_panel(spark):
    same = found(spark, ["Metric", "Q1 2024", "Q2 2024"], [["A", "$1", "$2"], ["B", "$3", "n/a"], ["C", "$5", "$6"], [None, "$7", "$8"]])
    assert [s.name for s in same["multi_series_line"].series] == ["A", "C"] and same["multi_series_line"].unit == "$"
    mixed = found(spark, ["Metric", "Q1 2024", "Q2 2024"], [[f"m{i}x".replace(str(i), "abcdefgh"[i]), "1" + "%$"[i % 2], "2" + "%$"[i % 2]] for i in range(8)])
    assert len(mixed["small_multiple_panel"].series) == 6 and mixed["small_multiple_panel"].subtitle.startswith("8 series")


def test_banks_rank_or_become_a_panel(spark):
    one = found(spark, ["Measure", "RY", "TD", "Peer"], [["CET1", "13 bps", "12 bps", "11"]])["peer_rank_bar"]
    assert values(one.points) == [("RY", 13.0), ("TD", 12.0)] and one.unit == "bps" and one.title == "CET1 peer ranking"
    two = found(spark, ["Measure", "RY", "TD"], [["x", "1", "2"], ["y", "3", "4"]])
    assert [s.name for s in two["small_multiple_panel"].series] == ["x", "y"] and two["small_multiple_panel"].score == 76


def test_parts_and_steps(spark):
    shares = found(spark, ["Segment", "First"], [["A", "60"], ["B", "38"], ["C", "-5"]])["composition_100_bar"]
    assert [(p.group, p.label, p.value) for p in shares.points] == [("First", "A", 60.0), ("First", "B", 38.0)]
    assert "composition_stacked_bar" in found(spark, ["Segment", "First"], [["A", "600"], ["B", "38"]])
    steps = found(spark, ["Item", "Amount"], [["Opening", "100"], ["Profit", "20"], ["Total so far", "120"], ["Dividends", "(5)"], ["Closing", "115"]])["waterfall"]
    assert [(p.label, p.value, p.is_total) for p in steps.points] == [("Opening", 100.0, True), ("Profit", 20.0, False), ("Total so far", 120.0, True), ("Dividends", -5.0, False), ("Closing", 115.0, True)]


def test_tables_that_give_nothing(spark):
    assert found(spark, ["Metric", "Q1 2024", "Q2 2024"], [["A", "1", "2"]], evidence=()) == {}
    assert found(spark, [], [["A"]]) == {} and found(spark, ["Metric"], []) == {}
    assert found(spark, ["Metric", "Q1 2024", "Q2 2024"], [["A", "none", "2"]]) == {}


def test_cells_are_found_without_regard_to_case(spark):
    table = spark.createDataFrame([(1, "", "", "", ["Metric", "Q1 2024"], [{"metric ": "A", "q1 2024": "5", "Q1 2024": "7"}, {}], ["E"])], SCHEMA)
    assert {(r.row, r.col): r.raw for r in tables.cells(table).collect()} == {(0, 0): "A", (0, 1): "7", (1, 0): None, (1, 1): None}


def test_first_overlapping_row_answers(spark):
    table = spark.createDataFrame(
        [(2, 2024, "Q1", "1", "RY", "Royal", ["RBC"], ["canada"], ["Slides "]), (1, 2024, "Q1", "2", "TD", None, None, ["Canada"], ["slides"]), (3, 2024, "Q2", "1", "RY", "Royal", [], None, ["other"])],
        "pos int, year int, quarter string, bank_id string, symbol string, name string, aliases array<string>, tags array<string>, database_names array<string>",
    )
    asked = [(1, 2024, "Q1", "rbc", " "), (2, 2024, "Q1", None, "CANADA"), (3, 2024, "Q2", "RY", None), (4, 2024, "Q1", None, None), (1, 2024, "Q1", "rbc", " ")]
    combos = spark.createDataFrame([(*a, "slides") for a in asked], "id int, year int, quarter string, symbol string, name string, source string")
    offered = merge.names_of(F.col("bank_id"), F.col("symbol"), F.col("name"), lists=(F.col("aliases"), F.col("tags")))
    out = merge.availability_by_overlap(combos, table, ["year", "quarter"], merge.names_of(F.col("symbol"), F.col("name")), offered, "source", "pos", ["bank_id", "symbol", "name"])
    got = sorted((r.id, r.bank_id, r.symbol, r.name, r.available) for r in out.collect())
    assert sorted(got, key=str) == sorted([(1, "1", "RY", "Royal", True)] * 2 + [(2, "2", "TD", "CANADA", True), (3, None, "RY", None, False), (4, None, None, None, False)], key=str)


def test_tables_are_computed_once(spark, monkeypatch):
    plans, write = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    source = spark.range(1).selectExpr("id AS table_id", "'T' AS title", "'' AS summary", "'' AS combo", "array('M', 'Q1 2024', 'Q2 2024') AS columns", "array(map('M', 'a', 'Q1 2024', '1', 'Q2 2024', '2')) AS rows", "array('E1') AS evidence_ids")
    assert [r.chart for r in tables.candidates(source).collect()] == ["trend_line"]
    assert sum("Range" in p for p in plans) == 1


def test_candidates_join_and_shuffle_nothing(spark):
    """No table of heads, columns or labels is broadcast or dealt anew, so the driver's memory doesn't follow the input; tables with one id stay apart."""
    rows = [(1, t, "", "Slides: RY Q1 2024", ["Metric", "Q1 2024", "Q2 2024"], [{"Metric": t, "Q1 2024": "1", "Q2 2024": "2"}], ["E"]) for t in "AB"]
    found = tables.candidates(spark.createDataFrame(rows, SCHEMA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted((r.chart, r.title) for r in found.collect()) == [("trend_line", "RY A trend"), ("trend_line", "RY B trend")]
