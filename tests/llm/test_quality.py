from collections import Counter

from quarrylane.llm import quality
from tests.llm.fixtures import DOC_SCHEMA, awkward, docs


def plain(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def rows(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in df.collect()]


def test_measurements_match_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in table.collect()}
    assert dict(rows(quality.ledger(table))) == want


def test_overlapping_repeats_and_awkward_rows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "x " * 50, "a b c d", "l1\nl1\n \n \nl1", "    nbsp is a word", None, ""]
    table = docs(spark, texts)
    assert dict(rows(quality.ledger(table))) == {i: plain(t) for i, t in enumerate(texts)}
    hard = awkward(spark)
    assert quality.ledger(hard).count() == hard.count()
    kept = quality.filtered(hard)
    assert kept.columns == hard.columns and kept.schema == hard.schema
    assert quality.ledger(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_policies_and_ablations(spark):
    table = spark.createDataFrame([(0b01, 1), (0b11, 2), (0b00, 3), (0b100, 4), (0b100, 5)], "failed long, doc_id long")
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_rejected) for r in quality.ablations(table).collect()}
    assert got["base-1", "too_few_words"] == (2, 1, 2)
    assert got["base-1", "repeated_words"] == (1, 0, 2)
    assert got["prose-1", "symbol_flood"] == (2, 2, 4)
    assert table.where(quality.passes(quality.BASE)).count() == 3


def test_clean_labelled_documents_stay(spark):
    path = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    kept = quality.ledger(table).select("doc_id", quality.passes().alias("kept"), quality.passes(quality.BASE).alias("base"))
    judged = kept.join(labels, "doc_id").groupBy("quality").agg({"*": "count"}).count()
    assert judged == 2
    clean_lost = kept.join(labels, "doc_id").where("quality = 1 and base and not kept").count()
    junk_kept = kept.join(labels, "doc_id").where("quality = 0 and kept").count()
    assert clean_lost == 0 and junk_kept <= 2
