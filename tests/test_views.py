"""Pages of the chunk view, numbered by ranges of ids."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylane.plans import views


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_pages_over_ranges_of_ids(spark, monkeypatch, width):
    monkeypatch.setattr(views, "ID_RANGE", width)
    rows = [(i * 3 - 50, "hot" if i % 5 else None, "en" if i % 7 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string").orderBy(F.rand(1))
    got = {r.doc_id: r.page for r in views._ranks(docs).collect()}
    want, seen = {}, defaultdict(int)
    for doc, source, lang in rows:
        seen[source, lang] += 1
        want[doc] = seen[source, lang]
    assert got == want
    assert views._ranks(docs.limit(0)).collect() == []


def test_pages_of_the_table_and_none(spark):
    data = "/root/testdata/sf0.001"
    assert views.chunks(spark, data, n=F.lit(1)).columns == ["doc_id", "bank", "source_type", "file_id", "n_chars", "n", "page"]
    assert views.chunks(spark, data).columns == ["doc_id", "bank", "source_type", "file_id", "n_chars", "text", "page"]
    assert "Exchange" not in views.chunks(spark, data, pages=False)._jdf.queryExecution().executedPlan().toString()
