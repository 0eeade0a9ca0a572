from pyspark.sql import functions as F

from quarrylane import api, schemas
from quarrylane.operators import charts


def test_schemas_name_their_keys():
    assert len(schemas.CHUNKS) == 21 and len(schemas.EMBEDDINGS) == 22 and len(schemas.AVAILABILITY) == 11
    for name, key in schemas.KEYS.items():
        assert set(key) <= set(schemas.TABLES[name].names)


def test_slot_audit(spark):
    slots = spark.createDataFrame([("s1", ["RY"], [1, 2], ["net income"]), ("s2", ["TD"], [1], ["loans"])], "slot_id string, banks array<string>, periods array<int>, metrics array<string>")
    known = spark.createDataFrame([("ry", 1, "Net Income (adjusted)"), ("TD", 1, "loan")], "bank string, period int, metric string")
    got = {r.slot_id: (r.n_missing, [tuple(b) for b in r.backfill or []]) for r in api.audit_slots(slots, known).collect()}
    assert got == {"s1": (1, [("RY", 2)]), "s2": (0, [])}


def test_result_status(spark):
    combos = spark.createDataFrame([("a",), ("b",), ("c",)], "bank string")
    one = lambda *banks: spark.createDataFrame([(b,) for b in banks], "bank string")
    got = {r.bank: r.status for r in api.result_status(combos, one("a", "b"), one("b"), ["bank"]).collect()}
    assert got == {"a": "success", "b": "partial_success", "c": "no_available_data"}


def test_assembled_findings(spark):
    rows = [(1, "Same", 2, "L", "s"), (2, "same", 2, "l", "s"), (3, "other", None, None, "s")]
    f = spark.createDataFrame(rows, "finding_id int, finding string, page int, location string, source_id string")
    f = f.withColumns({c: F.lit(None).cast("string") for c in ("file_name", "sheet", "section")})
    kept, registry = api.assembled(f)
    assert {r.finding_id for r in kept.collect()} == {1, 3}
    assert {r.first_pos: r.id for r in registry.collect()} == {1: "E1", 3: "E2"}


def test_latest_prompts_and_composition(spark):
    p = spark.createDataFrame([(1, "m", "l", "n", 5), (2, "m", "l", "n", 5), (3, "m", "l", "n", 1)], "id int, model string, layer string, name string, updated_at int")
    assert api.latest_prompts(p).first().id == 2 and api.latest_prompts(p, highest_id=False).first().id == 1
    assert api.composed_prompt({"database": "d", "fiscal": "f", "project": " "}) == "f\n\nd"


def test_points_need_evidence(spark):
    schema = "point_id int, evidence_ids array<string>, value double, start double, end double"
    points = spark.createDataFrame([(1, ["E1"], 10.0, None, None), (2, ["E9"], 10.0, None, None), (3, ["E1"], 3.0, 10.0, 13.0), (4, ["E1"], 4.0, 10.0, 13.0), (5, [], 1.0, None, None), (6, ["E1"], None, None, None)], schema)
    numbers = spark.createDataFrame([("E1", 10.005), ("E1", 13.0)], "evidence_id string, number double")
    assert sorted(r.point_id for r in charts.valid_points(points, numbers).collect()) == [1, 3]


def test_least_data(spark):
    cases = [("scatter_plot", 4, 0, True, True), ("scatter_plot", 4, 0, False, False), ("slopegraph", 4, 2, False, True), ("slopegraph", 4, 1, False, False), ("waterfall", 3, 0, False, True), ("unknown", 9, 9, True, False)]
    rows = spark.createDataFrame(cases, "c string, p int, s int, xy boolean, want boolean")
    assert all(r.got == r.want for r in rows.select("want", charts.enough(F.col("c"), F.col("p"), F.col("s"), F.col("xy")).alias("got")).collect())
