import numpy as np

import corpus_pipeline
from quarrylane.llm import similar, simhash
from tests.llm.fixtures import DOC_SCHEMA, awkward, docs


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    """Smallest id of each component of pairs at a similarity of 0.8."""
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def varied(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"x{rng.integers(1 << 30)}"
    return " ".join(out)


def some_texts():
    """Groups at similarities around 0.8, chains, unrelated texts with a common passage, and texts of few words."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(60)]
    texts = ["", "   ", "two words", "Two  Words", "other words"]
    for _ in range(12):
        words = [f"w{i}" for i in rng.integers(0, 900, 160)]
        texts += [varied(rng, words, n) for n in (0, 1, 2, 3, 4, 5, 9)]
        texts.append(" ".join(passage + words[:40]))
    return texts


def test_stage_drops_pairs_that_simhash_keeps(spark):
    texts = some_texts()
    table = docs(spark, texts)
    want = plain_kept(texts)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, table, "").collect()) == want
    assert simhash.keep_first(table).count() > len(want)


def test_blocks_change_nothing(spark):
    texts = some_texts()
    kept = similar.keep_first(docs(spark, texts), block_rows=3).collect()
    assert sorted(r.doc_id for r in kept) == plain_kept(texts)


def test_rows_with_null_or_repeated_ids_stay(spark):
    names = ["north", "south", "east", "west"]
    rows = [(i, f"a document about the {n} and nothing else at all", "en", "src0", 1) for i, n in zip((None, None, 3, 3), names)]
    assert similar.keep_first(spark.createDataFrame([*rows, *rows], DOC_SCHEMA)).count() == 4


def test_awkward_and_empty(spark):
    table = awkward(spark)
    kept = similar.keep_first(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "None"]
    assert similar.keep_first(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
