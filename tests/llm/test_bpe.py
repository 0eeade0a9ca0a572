import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylane.llm import bpe
from tests.llm.fixtures import DOC_SCHEMA, awkward

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def codec(vocabulary):
    return bpe.Codec(vocabulary)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_documents_match_the_library(spark, vocabulary, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(table, vocabulary).collect()}
    for r in table.collect():
        ids = library.encode_ordinary(r.text)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


ODD = [
    "", " ", "  a", "a  b", "a \n b", "a\n\nb c ", " lead", "trail ", "tab\tx y", "I'll don't 'S", "x" * 3000, "a b c", "　 a b", "\x1c a \x1cb",
    "<|endoftext|> a <unk> ▁ b", "数据 处理\U0001f600 \U0001f468‍\U0001f469", "\x00 a\x00b c", "1234 56a b7", "... !!! a.b", "a\r\n b",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sT1.é 数"), st.characters(exclude_categories=["Cs"]))))
def test_any_text_matches_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_cache_generations(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    small = bpe.Codec(vocabulary)
    for n in range(30):
        text = " ".join(f"word{n * i % 37} other{i}" for i in range(12))
        assert small.encode(text) == library.encode_ordinary(text)


def test_round_trip_and_awkward_rows(spark, vocabulary):
    table = awkward(spark)
    ids = bpe.encoded(table, vocabulary)
    assert ids.count() == table.count()
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decoded(ids, vocabulary).collect()}
    assert back == {r.doc_id: r.text or "" for r in table.collect()}
    assert bpe.digests(spark.createDataFrame([], DOC_SCHEMA), vocabulary).collect() == []
    assert bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), vocabulary).first().bytes is None


def test_vocabulary_must_be_whole():
    with pytest.raises(ValueError):
        bpe.serialised_model({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        bpe.serialised_model({b"a": 0})
