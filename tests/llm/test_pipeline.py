import hashlib
import math
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from quarrylane.llm import bpe, langid
from quarrylane.llm.queries import MIX_WEIGHTS
from tests.llm.fixtures import DOC_SCHEMA, awkward
from tests.llm.test_quality import plain as plain_quality
from tests.llm.test_mixing import plain_copies
from tests.llm.test_similar import plain_kept

DATA = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    names = docs.columns

    def keeps(t):
        n, chars, symbols, dup, repeat = plain_quality(t)
        lines = sum(bool(x.encode().split()) for x in t.split("\n"))
        return not (n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 20 * n)

    first = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert first.columns == names
    kept = {r.doc_id for r in first.collect()}
    assert kept == {i for i, t in text.items() if keeps(t)}

    second = corpus_pipeline.language_stage(spark, first, DATA)
    assert second.columns == names
    predicted = {r.doc_id: r for r in langid.predict(first, langid.train(first)).collect()}
    clear = {r.doc_id for r in second.collect()}
    assert clear == {i for i in kept if predicted[i].lang_pred != "und" and predicted[i].score >= 0.5} and len(clear) > 0.95 * len(kept)

    third = corpus_pipeline.dedup_stage(spark, second, DATA)
    assert third.columns == names
    ordered = sorted(clear)
    unique = {r.doc_id for r in third.collect()}
    assert unique == {ordered[i] for i in plain_kept([text[i] for i in ordered])}

    fourth = corpus_pipeline.mixing_stage(spark, third, DATA)
    assert fourth.columns == names
    copies = Counter(r.doc_id for r in fourth.collect())
    source = {r.doc_id: r.source for r in docs.collect() if r.doc_id in unique}
    size = Counter(source.values())
    rest = 1 - sum(MIX_WEIGHTS.values())
    roots = sum(round(math.sqrt(n), 9) for s, n in size.items() if s not in MIX_WEIGHTS)
    rate = {s: (MIX_WEIGHTS[s] if s in MIX_WEIGHTS else rest * round(math.sqrt(n), 9) / roots) * len(unique) / n for s, n in size.items()}
    assert copies == Counter({i: n for i in unique if (n := plain_copies(i, rate[source[i]]))})

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = corpus_pipeline.encoding_stage(spark, fourth, DATA).collect()
    assert Counter(r.doc_id for r in rows) == copies
    for r in rows[:50]:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary(text[r.doc_id]))).encode()).hexdigest()

    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, rows))


def test_awkward_and_empty_tables(spark):
    table = awkward(spark)
    empty = spark.createDataFrame([], DOC_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, DATA).count() <= 2 * table.count()
        assert stage(spark, empty, DATA).count() == 0
