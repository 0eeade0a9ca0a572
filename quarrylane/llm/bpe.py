"""Byte-level BPE encoding and decoding.

The vocabulary (a file of byte strings and ranks) is serialised as a
sentencepiece BPE model: each byte is mapped to a printable character, each
token is a piece scored by its negative rank, and the normaliser is the
identity. sentencepiece then merges the characters of a pre-token in rank
order. Decoding maps pieces back to bytes.

The driver reads the vocabulary file and ships the model; executors need no file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries in each of the two generations of a worker's cache.
CACHE_ENTRIES = 150_000
#: Code points encoded at a time.
BLOCK = 1 << 21


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; one unknown piece follows them."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without a gap")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    # Field numbers and enum values of the sentencepiece model format.
    piece = lambda text, score, kind: _bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece("".join(chars[b] for b in token), -float(rank), 1) for token, rank in by_rank]
    pieces.append(piece("<unk>", 0.0, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(by_rank)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


@dataclass(frozen=True)
class Vocabulary:
    """What a worker needs: the ranks, the serialised model and the pre-token pattern."""

    tokens: tuple[bytes, ...]
    model: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        ranks = read_ranks(path)
        return cls(tuple(sorted(ranks, key=ranks.get)), serialised_model(ranks), pattern)


class Codec:
    """Encodes and decodes; keeps what it found for recent chunks of text.

    A chunk is what stands between two single spaces. The pattern never puts a
    space at the end of a pre-token but in runs of white space, so a text whose
    chunks neither are empty nor begin or end with white space splits into
    pre-tokens chunk by chunk, each with its space before it. Other texts are
    split whole.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = vocabulary.tokens
        self.rank = {t: i for i, t in enumerate(vocabulary.tokens)}
        self.split = regex.compile(vocabulary.pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.to_chars = dict(enumerate(byte_characters()))
        self.recent: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def ids_of(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token: its rank if it is a token, else what sentencepiece merges."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pre_tokens]
        out = [[r] if (r := self.rank.get(b)) is not None else None for b in raw]
        rest = [i for i, x in enumerate(out) if x is None]
        merged = self.processor.encode([raw[i].decode("latin-1").translate(self.to_chars) for i in rest], num_threads=1) if rest else []
        for i, ids in zip(rest, merged, strict=True):
            out[i] = ids
        return out

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for; an id outside the vocabulary is an error."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def _entries(self, pieces: list[list[str]]) -> list[tuple]:
        """(ids, ids as text, bytes that they decode to) of each list of pre-tokens."""
        distinct = list(dict.fromkeys(chain.from_iterable(pieces)))
        ids = dict(zip(distinct, self.ids_of(distinct), strict=True))
        found = [tuple(chain.from_iterable(map(ids.__getitem__, p))) for p in pieces]
        return [(f, " ".join(map(str, f)), self.decode(f)) for f in found]

    def _learn(self, chunks: set[str]) -> None:
        """Entries for chunks with a space before them; None for one that a text can't be split at."""
        alone = []
        for c in chunks:
            if (known := self.older.get(c)) is not None:
                self.recent[c] = known
            elif not c or c[0].isspace() or c[-1].isspace() or len(c) > 1000:
                self.recent[c] = None
            else:
                alone.append(c)
        self.recent.update(zip(alone, self._entries([self.split(" " + c) for c in alone]), strict=True))

    def encode_block(self, texts: list[str]) -> Iterator[list[tuple]]:
        """The entries that make up each text, in order."""
        if len(self.recent) > CACHE_ENTRIES:
            self.older, self.recent = self.recent, {}
        chunks = [t.split(" ") for t in texts]
        self._learn(set(chain.from_iterable(c[1:] for c in chunks)) - self.recent.keys())
        rest, whole = [], []
        for t, c in zip(texts, chunks, strict=True):
            parts = list(map(self.recent.__getitem__, c[1:]))
            if None in parts or c[0][-1:].isspace():
                parts, head = [], t
            else:
                head = c[0]
            rest.append(parts)
            whole.append(self.split(head))
        for head, parts in zip(self._entries(whole), rest, strict=True):
            yield [head, *parts] if head[0] else parts

    def encode(self, text: str) -> list[int]:
        return [i for entry in next(self.encode_block([text])) for i in entry[0]]


_codecs: dict[str, Codec] = {}


def _codec(vocabulary: Vocabulary) -> Codec:
    """One codec in each worker process, so that its cache lives through tasks."""
    key = hashlib.sha256(vocabulary.model + vocabulary.pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _mapped(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, columns, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= BLOCK:
                    size += len(texts[end])
                    end += 1
                rows = columns(codec.encode_block(texts[at:end]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *rows.values()], names=["doc_id", *rows])
                at = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) for every row of ``docs``; a null text has no ids."""

    def columns(entries):
        return {"ids": pa.array([list(chain.from_iterable(e[0] for e in parts)) for parts in entries], pa.list_(pa.int32()))}

    return _mapped(docs, vocabulary, id_col, text_col, columns, "doc_id long, ids array<int>")


def digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` for every row of ``docs``.

    The first hash is of the decimal ids joined by one space, the second of the
    bytes that these ids decode to. A null text counts as empty. Null and
    repeated ids stay rows of their own. An empty table gives an empty result;
    other columns, whatever their names, are not looked at.
    """

    def columns(entries):
        n, of_ids, of_bytes = [], [], []
        for parts in entries:
            n.append(sum(len(e[0]) for e in parts))
            of_ids.append(hashlib.sha256(" ".join([e[1] for e in parts]).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(b"".join([e[2] for e in parts])).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}

    return _mapped(docs, vocabulary, id_col, text_col, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``bytes`` (binary) for every row of ids; null ids decode to null, an id outside the vocabulary is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            out = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")
