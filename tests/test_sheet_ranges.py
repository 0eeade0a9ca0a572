"""References, series and merged cells of literal sheets."""

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import sheet_ranges as ranges

CASES = {
    "'Sheet 1'!$B$2:$B$13": ("Sheet 1", 2, 13, 2, 2),
    "Data!C4": ("Data", 4, 4, 3, 3),
    "=Data!$AA$9:$Z$3": ("Data", 3, 9, 26, 27),
    "'It''s'!XFD1048576": ("It's", 1048576, 1048576, 16384, 16384),
    "Data!XFE1": None,
    "Data!A0": None,
    "Data!A1048577": None,
    "(Data!A1,Data!B1)": None,
    "B2:B4": None,
    "": None,
    None: None,
}


def test_bounds(spark):
    got = spark.createDataFrame([(k,) for k in CASES], "ref string").select("ref", ranges.bounds(F.col("ref")).alias("at")).collect()
    assert {r.ref: r["at"] and tuple(r["at"]) for r in got} == CASES


@pytest.fixture
def cells(spark):
    rows = [("w", "S", r, 1, f"c{r}") for r in (1, 2, 4)] + [("w", "S", r, 2, str(r * 10)) for r in range(1, 601) if r != 2] + [("v", "S", 1, 2, "other book")]
    return spark.createDataFrame(rows, "book string, sheet string, row int, col int, text string")


def test_series(spark, cells):
    rows = [("a", "w", "S!$A$1:$A$4", "S!$B$1:$B$4"), ("long", "w", None, "S!B1:B600"), ("wide", "w", "S!A1:B1", "S!A4:B4"), ("bad", "w", "nowhere", "T!A1"), ("none", "w", "S!D1:D9", "S!E1:E9")]
    series = spark.createDataFrame(rows, "id string, book string, `categories` string, `values` string")
    points = ranges.series_points(series, cells, "book", ["id"])
    found = {k: [r.point for r in sorted(points.where(F.col("id") == k).collect(), key=lambda r: r["index"])] for k in ("a", "wide", "bad", "none")}
    assert found == {"a": ["c1: 10", "c2: ", "Point 3: 30", "c4: 40"], "wide": ["c1: c4", "10: 40"], "bad": [], "none": []}
    shown = {r.id: r for r in ranges.previews(points, ["id"]).collect()}
    assert shown["long"].n_points == 599
    assert shown["long"].preview == "; ".join(f"Point {i}: {i * 10}" for i in range(1, 14) if i != 2)
    assert sorted(shown) == ["a", "long", "wide"]


def test_merged(spark):
    cells = spark.createDataFrame([("w", "S", 1, 1, "head"), ("w", "S", 1, 2, "hidden"), ("w", "S", 3, 3, "alone"), ("w", "S", 5, 6, "stays")], "book string, sheet string, row int, col int, text string")
    merges = spark.createDataFrame([("w", "S", "A1:B2"), ("w", "S", "A1:B2"), ("w", "S", "E5:F5"), ("w", "S", "??"), ("w", "S", None)], "book string, sheet string, ref string")
    got = sorted(tuple(r)[2:] for r in ranges.merged_filled(cells, merges, "book").collect())
    assert got == [(1, 1, "head"), (1, 2, "head"), (2, 1, "head"), (2, 2, "head"), (3, 3, "alone"), (5, 6, "stays")]
