"""Providers stand for models and services; each has a deterministic default.

A provider gets a list of texts and returns one result for each. Calls run in
the executors by Arrow batches; a batch whose results don't match is halved
until it does, and failed calls are tried again after growing waits.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[Sequence[str]], list[Any]]
#: Words whose hashes an embedder keeps.
CACHED_WORDS = 100_000


def hashing_embedder(dim: int = 64) -> Provider:
    """Unit vectors of signed word hashes; some words' hashes are kept."""
    known: dict[str, tuple[int, float]] = {}

    def place(word: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
        found = h % dim, 1.0 if h >> 63 else -1.0
        if len(known) < CACHED_WORDS:
            known[word] = found
        return found

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w, n in Counter(re.findall(r"\w+", t.lower())).items():
                at, sign = known.get(w) or place(w)
                v[at] += sign * n
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def first_sentence(texts: Sequence[str]) -> list[str]:
    return [re.split(r"(?<=[.!?])\s", t.strip(), maxsplit=1)[0] for t in texts]


def call(provider: Provider, texts: Sequence[str], tries: int = 3, wait: float = 0.5) -> list[Any]:
    """Results of a batch; halves a batch whose result count is wrong, and retries a call that raises."""
    for attempt in range(1, tries + 1):
        try:
            got = provider(texts)
            break
        except Exception:
            if attempt == tries:
                raise
            time.sleep(wait * attempt)
    if len(got) == len(texts):
        return list(got)
    if len(texts) == 1:
        raise ValueError(f"the provider returned {len(got)} results for one text")
    half = len(texts) // 2
    return call(provider, texts[:half], tries, wait) + call(provider, texts[half:], tries, wait)


def call_keyed(provider: Callable[[dict[Any, str]], dict[Any, Any]], texts: dict[Any, str], tries: int = 3, wait: float = 0.5) -> dict[Any, Any]:
    """Results by id. A batch whose ids don't come back exactly is halved; a call that raises is tried again after growing waits."""
    for attempt in range(1, tries + 1):
        try:
            got = provider(texts)
            break
        except Exception:
            if attempt == tries:
                raise
            time.sleep(wait * attempt)
    if got.keys() == texts.keys():
        return got
    if len(texts) == 1:
        raise ValueError(f"ids mismatch: asked for {sorted(texts)}, got {sorted(got)}")
    items = list(texts.items())
    half = len(items) // 2
    return call_keyed(provider, dict(items[:half]), tries, wait) | call_keyed(provider, dict(items[half:]), tries, wait)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows: only a piece's texts are Python objects at a time."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def apply_keyed(df: DataFrame, key: str, text: str, provider: Callable[[dict[Any, str]], dict[Any, Any]], result: str, batch: int = 100, name: str = "result") -> DataFrame:
    """``key``, ``name`` of every row with a text, by a provider that takes and returns ids; keys must be unique within a batch of rows."""
    def aligned(pairs: Sequence[Any]) -> list[Any]:
        asked = dict(pairs)
        got = call_keyed(provider, asked)
        return [got[k] for k, _ in pairs]

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {name} {result}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches, batch):
            pairs = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({key: rows.column(0), name: pa.array(aligned(pairs), kind)})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(result))
    return df.where(F.trim(F.coalesce(F.col(text).cast("string"), F.lit(""))) != "").select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def apply(df: DataFrame, key: str, text: str, provider: Provider, result: str, batch: int = 100, name: str = "result") -> DataFrame:
    """``key``, ``name`` (of SQL type ``result``) for every row; blank texts are skipped and get null."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {name} {result}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches, batch):
            texts = rows.column(1).to_pylist()
            real = [i for i, t in enumerate(texts) if t and t.strip()]
            out: list[Any] = [None] * len(texts)
            if real:
                for i, r in zip(real, call(provider, [texts[i] for i in real]), strict=True):
                    out[i] = r
            yield pa.RecordBatch.from_pydict({key: rows.column(0), name: pa.array(out, kind)})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(result))
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
