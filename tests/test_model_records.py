"""Records in model output on literal texts."""

import json

from pyspark.sql import functions as F

from quarrylane.operators import model_records as M


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def test_object_text(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', '``` {"a": "}"} ```', 'so {"a": {"b": 2}} and so on', "no braces", "} {", "", None, '```JSON\n[1]\n```']
    assert column(spark, texts, M.object_text(F.col("t"))) == ['{"a": 1}', '{"a": 1}', '{"a": "}"}', '{"a": {"b": 2}}', "no braces", "} {", "", None, "[1]"]
    assert column(spark, [*texts, '{"a": '], M.parsed(F.col("t")).isNotNull()) == [True] * 4 + [False] * 6


def test_values_as_text_and_lists(spark):
    v = F.try_parse_json("t")
    values = ["null", "0", "false", "true", '""', '" x "', "5", "5.5", "[]", "{}", "[1]", "nonsense"]
    assert column(spark, values, M.shown(v)) == ["", "", "", "True", "", " x ", "5", "5.5", "", "", "[1]", ""]
    lists = ["null", '["a", null, 2]', '"one"', '"[\\"a\\", null, \\"b\\"]"', "7", "[]", "nonsense"]
    assert column(spark, lists, M.coerced_list(v)) == [[], ["a", "2"], ["one"], ["a", "b"], ["7"], [], []]


def test_tables(spark):
    v = F.try_parse_json("t")
    tables = [
        {"title": " T ", "columns": [" a ", "", "b"], "rows": [{"a": 1, "c": None}, [1, "x", "left out"], [2], 5, None], "notes": None},
        {"rows": [{"y": 1, "x": 2}]},
        {"columns": ["a"], "rows": "none"},
        {"columns": [], "rows": [[1, 2]]},
        {},
        "text",
    ]
    got = column(spark, [json.dumps(t) for t in tables], M.table_of(v))
    assert (got[0].title, got[0].columns, got[0].rows, got[0].notes) == ("T", ["a", "b"], [{"a": "1", "c": None}, {"a": "1", "b": "x"}, {"a": "2"}], "")
    assert (got[1].columns, got[1].rows) == (["x", "y"], [{"x": "2", "y": "1"}])
    assert (got[2].columns, got[2].rows) == (["a"], []) and got[3:] == [None, None, None]


def test_findings_and_their_errors(spark):
    good = {"finding": " f ", "page": 2.9, "location_detail": " here ", "metric_value": 3, "finding_type": " Summary "}
    texts = [
        json.dumps({"findings": [good, {**good, "page": "2"}, {**good, "finding": " "}, {**good, "location_detail": None}, 7, None]}),
        json.dumps({"findings": [good, {**good, "page": True}]}),
        json.dumps({"findings": []}),
        json.dumps({"other": 1}),
        "cut {",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, said string")
    found = M.findings(rows, "id", "said")
    errors = {(r.id, r.place): r.error for r in found.collect()}
    assert errors == {
        (0, 0): None, (0, 1): "finding page is required", (0, 2): "finding text is required", (0, 3): "finding location_detail is required", (0, 4): "each finding must be an object", (0, 5): "each finding must be an object",
        (1, 0): None, (1, 1): None, (3, None): "findings must be an array", (4, None): "no JSON object", (5, None): "no JSON object",
    }
    first = found.where("id = 1").orderBy("place").collect()
    assert [(r.finding, r.page, r.location_detail, r.metric_value, r.finding_type, r.source_ref_ids, r.table) for r in first] == [("f", 2, "here", "3", "summary", [], None), ("f", 1, "here", "3", "summary", [], None)]
    told = {r.id: (r.n, r.error) for r in M.accepted(found, "id").collect()}
    assert told == {0: (0, "finding 1: finding page is required"), 1: (2, None), 3: (0, "findings must be an array"), 4: (0, "no JSON object"), 5: (0, "no JSON object")}
    assert M.findings(rows.where("false"), "id", "said").collect() == []


def test_responses_are_read_once(spark, tmp_path):
    said = [(1, '{"findings": []}'), (2, '{"findings": {}}'), (3, "no"), (4, None), (5, '{"findings": [null, 1]}'), (6, '{"findings": [{"finding": "f", "page": 1, "location_detail": "x"}]}'), (7, '{"findings": "[1]"}')]
    spark.createDataFrame(said, "k long, said string").write.parquet(f"{tmp_path}/said")
    found = M.findings(spark.read.parquet(f"{tmp_path}/said"), "k", "said")
    none, no_list, no_object = "no JSON object", "findings must be an array", "each finding must be an object"
    assert sorted(((r.k, r.place, r.error) for r in found.collect()), key=str) == [(2, None, no_list), (3, None, none), (4, None, none), (5, 0, no_object), (5, 1, no_object), (6, 0, None), (7, None, no_list)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
