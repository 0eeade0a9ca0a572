"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text's tokens are the most likely segmentation of its words into pieces of a
vocabulary. Distinct pre-tokens are put into a trie; the forward pass (best log
probability up to a place, and the pieces it takes) runs once for each node,
so words share the work for their common prefix, and the count is kept at
each word's last node. The sorted list of distinct pre-tokens is that trie in
depth-first order: only the nodes of the current branch are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_ENTRIES = 300_000
#: Code points counted at a time.
BLOCK = 1 << 21
#: Longest pre-token whose count is cached, in code points.
CACHED_LENGTH = 64


@dataclass(frozen=True)
class Unigram:
    """Log probabilities of pieces; a character in no piece takes one byte piece per UTF-8 byte."""

    pieces: dict[str, float]
    byte: float
    longest: int

    @classmethod
    def load(cls, path: str) -> Unigram:
        """The pieces of a sentencepiece file, most likely first by its scores, under Zipf's law.

        The file was made for merging and its scores are ranks, so each piece's
        probability is in proportion to one over its rank.
        """
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
        return cls.zipf([p.id_to_piece(i) for i in sorted(usable, key=lambda i: (-p.get_score(i), i))])

    @classmethod
    def zipf(cls, ordered: list[str]) -> Unigram:
        total = sum(1 / r for r in range(1, len(ordered) + 1)) or 1.0
        scores = {piece: -math.log(r * total) for r, piece in enumerate(ordered, 1)}
        return cls(scores, -math.log((len(ordered) + 1) * total), max(map(len, ordered), default=1))


def trie_counts(words: Iterable[str], model: Unigram) -> dict[str, int]:
    """Tokens of each word's best segmentation; of equal ones that with the longest last piece."""
    pieces, longest, byte = model.pieces.get, model.longest, model.byte
    best, count = [0.0], [0]
    before = ""
    terminal = {}
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                if (score := pieces(word[start:end])) is not None and best[start] + score > top:
                    top, n = best[start] + score, count[start] + 1
            if end and pieces(word[end - 1]) is None:
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                if best[end - 1] + size * byte > top:
                    top, n = best[end - 1] + size * byte, count[end - 1] + size
            best.append(top)
            count.append(n)
        terminal[word] = count[len(word)]
        before = word
    return terminal


class Counter:
    """Counts texts block by block; keeps the counts of recent pre-tokens."""

    def __init__(self, model: Unigram) -> None:
        self.model = model
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count_block(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.recent) > CACHE_ENTRIES:
            self.older, self.recent = self.recent, {}
        words = [t.split() for t in texts]
        new = set(chain.from_iterable(words)) - self.recent.keys()
        known = {w: n for w in new if (n := self.older.get(w)) is not None}
        self.recent.update(known)
        found = trie_counts((MARK + w for w in new if w not in known), self.model)
        long = {}
        for w, n in found.items():
            (self.recent if len(w) <= CACHED_LENGTH else long)[w[1:]] = n
        for w in words:
            if long and not long.keys().isdisjoint(w):
                yield len(w), sum(self.recent.get(x) or long[x] for x in w)
            else:
                yield len(w), sum(map(self.recent.__getitem__, w))


_counters: list[Counter] = []


def _counter(model: Unigram) -> Counter:
    """One counter in each worker process, so that its cache lives through tasks."""
    if not _counters or _counters[0].model is not model:
        _counters[:] = [Counter(model)]
    return _counters[0]


def token_counts(docs: DataFrame, model: Unigram, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_pretokens``, ``n_tokens`` (long) for every row of ``docs``.

    Pre-tokens are the words between white space, each with a mark before it.
    A null or blank text has none. Null and repeated ids stay rows of their own,
    equal texts have equal counts, and where segmentations tie in score the
    first found counts. An empty table gives an empty result; other columns,
    whatever their names, are not looked at. Texts are counted whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= block:
                    size += len(texts[end])
                    end += 1
                counts = list(counter.count_block(texts[at:end]))
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *columns], names=["doc_id", "n_pretokens", "n_tokens"])
                at = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
