import hashlib
import math
from collections import Counter

from quarrylane.llm import mixing
from tests.llm.fixtures import DOC_SCHEMA, awkward


def plain_copies(doc_id, rate, seed=mixing.DEFAULT_SEED):
    n = 0
    for part in range(1, max(1, math.ceil(rate / mixing.MAX_MEAN)) + 1):
        mean = rate / max(1, math.ceil(rate / mixing.MAX_MEAN))
        u = int(hashlib.md5(f"copies{seed}|{'' if doc_id is None else doc_id}|{part}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-mean), math.exp(-mean)
        while c <= u and k < 2000:
            k += 1
            p *= mean / k
            c += p
        n += k
    return n


def test_copies_invert_the_distribution(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = {"src0": 0.5, "src3": 0.3, "src4": 0.0}
    rate = {r.source: r.rate for r in mixing.rates(table, weights).collect()}
    rows = table.select("doc_id", "source").collect()
    want = Counter({r.doc_id: n for r in rows if (n := plain_copies(r.doc_id, rate[r.source]))})
    got = mixing.mixed(table, weights)
    assert got.columns == [*table.columns, "copy_no", "mix_key"]
    found = got.select("doc_id", "source", "copy_no").collect()
    assert Counter(r.doc_id for r in found) == want
    share = Counter(r.source for r in found)
    assert abs(share["src0"] / len(found) - 0.5) < 0.06 and abs(share["src3"] / len(found) - 0.3) < 0.06 and share["src4"] == 0
    salted = mixing.mixed(table, weights, broadcast_sources=1)
    assert Counter(r.doc_id for r in salted.select("doc_id").collect()) == want


def test_high_means(spark):
    table = spark.createDataFrame([(i, "t", "en", "small" if i < 3 else "big", 1) for i in range(3000)], DOC_SCHEMA)
    got = mixing.mixed(table, {"small": 0.6}).groupBy("doc_id").count().where("doc_id < 3").collect()
    rate = 0.6 * 3000 / 3
    assert all(abs(r["count"] - rate) < 6 * math.sqrt(rate) for r in got) and len(got) == 3
    assert {r["doc_id"]: r["count"] for r in got} == {i: plain_copies(i, rate) for i in range(3)}


def test_order_is_fixed_and_awkward_rows(spark):
    table = awkward(spark)
    first = [tuple(r) for r in mixing.mixed(table, epochs=5.0).orderBy("mix_key", "text").collect()]
    again = [tuple(r) for r in mixing.mixed(table.repartition(3), epochs=5.0).orderBy("mix_key", "text").collect()]
    assert first == again and len(first) > 10
    assert mixing.mixed(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_clashing_names(spark):
    import pytest

    table = awkward(spark).withColumnRenamed("fp", "copy_no").withColumnRenamed("id", "mix_key")
    with pytest.raises(ValueError):
        mixing.mixed(table)
    got = mixing.mixed(table, copy_col="c", key_col="k", epochs=3.0)
    assert got.columns == [*table.columns, "c", "k"] and got.count() > 3


def test_null_and_repeated_ids_are_drawn_apart(spark):
    """Rows that share an id, or have none, get copies and keys of their own; equal rows too, however they are dealt out."""
    rows = [(None, f"text {i}", "en", "src0", 1) for i in range(200)] + [(5, f"other {i}", "en", "src0", 1) for i in range(200)] + [(None, "the same", "en", "src1", 1)] * 200
    table = spark.createDataFrame(rows, DOC_SCHEMA)
    for ids in (1, 100):
        apart = mixing.told_apart(table.repartition(7), broadcast_ids=ids)
        assert apart.select("__ql_ident").distinct().count() == len(rows) and apart.drop("__ql_ident").exceptAll(table).count() == 0
    got = mixing.mixed(table, epochs=3.0).collect()
    assert len({r.mix_key for r in got}) == len(got)
    for kind in ("text", "other"):
        counts = Counter(r.text for r in got if r.text.startswith(kind))
        assert len(set(counts.values())) > 2 and len(counts) > 150
    assert 450 < sum(r.text == "the same" for r in got) < 750
    again = mixing.mixed(table.repartition(3), epochs=3.0).collect()
    assert sorted((r.text, r.mix_key) for r in got) == sorted((r.text, r.mix_key) for r in again)
