import math

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylane.llm import bpe, tokencount
from tests.llm.fixtures import DOC_SCHEMA, awkward


@pytest.fixture(scope="module")
def model():
    return tokencount.Unigram.load(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(model):
    """sentencepiece's own unigram decoder over the same pieces and scores."""
    import struct

    piece = lambda text, score, kind: bpe._bytes(1, bpe._bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bpe._number(3, kind))
    body = piece("<unk>", 0.0, 2) + b"".join(piece(p, s, 1) for p, s in model.pieces.items())
    trainer = bpe._bytes(2, bpe._number(3, 1) + bpe._number(4, len(model.pieces) + 1) + bpe._number(41, -1) + bpe._number(42, -1) + bpe._number(43, -1))
    normaliser = bpe._bytes(3, bpe._bytes(1, b"identity") + bpe._number(3, 0) + bpe._number(4, 0) + bpe._number(5, 0))
    return sentencepiece.SentencePieceProcessor(model_proto=body + trainer + normaliser)


def brute(word, model):
    """Best log probability over all segmentations, and the token counts of those that reach it, without a trie."""
    best = [(0.0, {0})] + [(-math.inf, set())] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            score, n = model.pieces.get(piece), 1
            if score is None and end - start == 1:
                n = len(piece.encode())
                score = n * model.byte
            if score is None:
                continue
            total, counts = best[start][0] + score, {c + n for c in best[start][1]}
            if total > best[end][0] + 1e-9:
                best[end] = (total, counts)
            elif abs(total - best[end][0]) <= 1e-9:
                best[end] = (best[end][0], best[end][1] | counts)
    return best[-1]


def test_documents_match_the_library(spark, model, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(table, model).collect()}
    for r in table.collect():
        words = r.text.split()
        assert got[r.doc_id] == (len(words), sum(len(library.encode("▁" + w)) for w in words))


SMALL = tokencount.Unigram.zipf(["a", "b", "ab", "▁", "▁a", "aba", "bb", "▁ab"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé", max_size=8), max_size=12))
def test_shared_prefixes_give_each_word_its_own_best(words):
    words = ["▁" + w for w in words]
    together = tokencount.trie_counts(words, SMALL)
    for w in words:
        assert together[w] == tokencount.trie_counts([w], SMALL)[w]
        score, counts = brute(w, SMALL)
        assert score > -math.inf and together[w] in counts


def test_caches_and_blocks_change_nothing(spark, model, monkeypatch):
    texts = [" ".join(f"w{n * i % 41}x" for i in range(20)) + " " + "y" * 300 for n in range(20)]
    want = list(tokencount.Counter(model).count_block(texts))
    monkeypatch.setattr(tokencount, "CACHE_ENTRIES", 5)
    counter = tokencount.Counter(model)
    assert [c for t in texts for c in counter.count_block([t])] == want


def test_awkward_rows(spark, model):
    table = awkward(spark)
    got = tokencount.token_counts(table, model).collect()
    assert len(got) == table.count()
    by_id = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in got}
    assert by_id[1] == by_id[2] == by_id[6] == (0, 0)
    assert by_id[5][0] == 80_000
    assert tokencount.token_counts(spark.createDataFrame([], DOC_SCHEMA), model).collect() == []
