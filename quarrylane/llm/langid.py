"""Language identification of mixed-language text.

Script ranges narrow the languages a word may be in; character trigrams score
the word under each of them; a Viterbi pass over the words, with a penalty for
each switch, labels spans. A text's language is the one with most letters.

The model is a table of hashed trigram counts per language, summed over all
training rows by Spark, so its size is set by ``BUCKETS`` and the number of
languages whatever the corpus. No language is left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.staging import discard, staged

BUCKETS = 1 << 16
#: A language takes 256 KB in the model, which every executor gets. A column with more values than this holds no languages and is refused.
MAX_LANGUAGES = 1024
#: Languages that a task counts before it hands on what it has.
COUNTED_LANGUAGES = 256
SWITCH_PENALTY = 15.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
NOT_CANDIDATE = -40.0
UNDETERMINED = "und"
#: Code points scored at a time.
BLOCK = 1 << 20

# First and last code point of the main blocks of each script (Unicode).
SCRIPT_RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
#: Script ids: 0 is no letter, 1 a letter of a script not listed, then as listed.
N_SCRIPTS = 2 + len(SCRIPT_RANGES)
#: Added to the script id of a combining mark.
MARK = 0x80


@cache
def _classes() -> np.ndarray:
    """Script id of every letter and combining mark. A mark stays in its word, but is no letter."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    out = np.fromiter((k in "LM" for k in kinds), dtype=np.uint8, count=0x110000)
    for n, ranges in enumerate(SCRIPT_RANGES.values()):
        for low, high in ranges:
            block = out[low : high + 1]
            block[block > 0] = n + 2
    out[np.fromiter((k == "M" for k in kinds), dtype=bool, count=0x110000)] |= MARK
    return out


def _lowered(text: str) -> str:
    """Lower case with every code point kept in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """Runs of letters and marks with a letter in them, of a list of text pieces; ``first`` indexes the array that has a value per code point.

    ``letters`` counts a word's letters, ``size`` its code points; ``goes_on``
    marks a part that belongs to the word before.
    """

    bucket: np.ndarray
    first: np.ndarray
    script: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    size: np.ndarray
    letters: np.ndarray
    goes_on: np.ndarray


class Piece(NamedTuple):
    """Part of a text from ``at``. Where a cut goes through a run of letters, ``before`` and ``after`` are the code points across it; ``lead`` is then the script of the run's first."""

    text: str
    at: int = 0
    before: str = "\0"
    after: str = "\0"
    lead: int = 0


def words_of(pieces: list[Piece]) -> Words:
    """Words of pieces. The parts of a run that is cut are rows of their own, with the trigrams that they have in the whole run."""
    joined = "".join(p.before + p.text + p.after for p in pieces)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(p.text) + 2 for p in pieces])
    begins = np.append(0, ends[:-1]) + 1
    edges = np.concatenate([begins - 1, ends - 1])
    across = points[edges]
    kind = _classes()[points]
    kind[edges] = 0
    at = np.flatnonzero(kind)
    marks = kind[at] >= MARK
    if marks.any():
        word = np.cumsum(kind[at - 1] == 0) - 1
        lettered = np.bincount(word, weights=~marks) > 0
        # A run that is cut has a letter somewhere.
        inner = np.concatenate([begins, ends - 2])[across > 0]
        lettered[word[np.searchsorted(at, inner)]] = True
        kind[at[~lettered[word]]] = 0
        at, marks = at[lettered[word]], marks[lettered[word]]
    points = np.where(kind > 0, points, 0).astype(np.uint32)
    points[edges] = across
    h = points[at - 1] * np.uint32(0x9E3779B1) + points[at] * np.uint32(0x85EBCA77) + points[at + 1] * np.uint32(0xC2B2AE3D)
    bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    first = np.flatnonzero(kind[at - 1] == 0)
    where = at[first]
    piece = np.searchsorted(begins, where, side="right") - 1
    goes_on = (where == begins[piece]) & (across[: len(pieces)][piece] > 0)
    script = np.where(goes_on, np.array([p.lead for p in pieces])[piece], kind[where] & (MARK - 1))
    letters = np.add.reduceat(~marks, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
    return Words(bucket, first, script, piece, where - begins[piece], np.diff(np.append(first, len(at))), letters, goes_on)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # [BUCKETS, languages], log probabilities
    candidates: np.ndarray  # [N_SCRIPTS, languages]
    commonest: int  # the language with most training letters, for words without evidence
    penalty: float = SWITCH_PENALTY

    def sums(self, w: Words) -> np.ndarray:
        """Sum of log probabilities per word, or part of one, and language."""
        return np.add.reduceat(self.table[w.bucket], w.first, axis=0) if len(w.first) else np.empty((0, len(self.languages)), np.float32)

    def scores(self, out: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Log score per word and language, from sums of whole words; a word in a script of no language is no evidence."""
        allowed = self.candidates[script]
        out = np.where(allowed, out, np.float32(NOT_CANDIDATE) + out.max(axis=1, keepdims=True, initial=-1e9))
        out[~allowed.any(axis=1)] = 0
        return out - out.max(axis=1, keepdims=True, initial=-1e9)


def constant_is_best(scores: np.ndarray, starts: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """Per text, whether no detour from its best single language can pay for its switches.

    A detour through k spans gains at most k times the best run sum of score
    differences and costs k switches at least; so none pays if that sum is not
    over the penalty.
    """
    sizes = np.diff(np.append(starts, len(scores)))
    text = np.repeat(np.arange(len(starts)), sizes)
    own = scores[np.arange(len(scores)), best[text]]
    worst = np.zeros(len(starts))
    for k in range(scores.shape[1]):
        d = (scores[:, k] - own).astype(np.float64)
        total = np.cumsum(d)
        before = total - d
        low = before.max(initial=0) - before.min(initial=0) + np.abs(d).max(initial=0) + 1
        shift = text * low
        run = np.minimum.accumulate(before - shift) + shift
        np.maximum(worst, np.maximum.reduceat(total - run, starts), out=worst)
    return worst <= penalty - 1e-6


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label per word, for many texts in step; a tie stays, then takes the first language."""
    sizes = np.diff(np.append(starts, len(scores)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    stays = np.ones(scores.shape, dtype=bool)
    from_ = np.zeros(len(scores), dtype=np.int16)
    delta = scores[starts].astype(np.float64)
    for t in range(1, longest):
        n = active[t]
        rows = starts[:n] + t
        d = delta[:n]
        top = d.argmax(axis=1)
        jump = d[np.arange(n), top][:, None] - penalty
        stays[rows] = d >= jump
        from_[rows] = top
        delta[:n] = np.maximum(d, jump) + scores[rows]
    labels = np.zeros(len(scores), dtype=np.int16)
    label = delta.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        labels[rows] = label[:n]
        label[:n] = np.where(stays[rows, label[:n]], label[:n], from_[rows])
    return labels


def _kinds(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _run_letters(text: str, at: int) -> tuple[bool, int]:
    """Whether the run of letters and marks from ``at`` has a letter; if not, where it ends."""
    while at < len(text):
        kinds = _kinds(text[at : at + BLOCK])
        out = np.flatnonzero(kinds == 0)
        end = int(out[0]) if len(out) else len(kinds)
        if (kinds[:end] < MARK).any():
            return True, at + end
        at += end
        if len(out):
            break
    return False, at


def _pieces(text: str) -> Iterator[Piece]:
    """A text in pieces of at most BLOCK code points, cut where no word is, or through a run of letters that is longer."""
    at, before, lead = 0, "\0", 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(c, at, at + BLOCK) for c in " \n\t") + 1
        after = "\0"
        if cut <= at:
            kinds = _kinds(text[at : at + BLOCK])
            out = np.flatnonzero(kinds == 0)
            if len(out):
                cut = at + int(out[-1]) + 1
            elif before == "\0" and not (run := _run_letters(text, at))[0]:
                at = run[1]  # marks alone are no word
                continue
            else:
                cut = at + BLOCK
                if _kinds(text[cut])[0]:
                    after = text[cut]
                    lead = lead if before != "\0" else int(kinds[0] & (MARK - 1))
        yield Piece(text[at:cut], at, before, after, lead)
        before, lead = (text[cut - 1], lead) if after != "\0" else ("\0", 0)
        at = cut
    yield Piece(text[at:], at, before, "\0", lead)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def label_words(model: Model, texts: list[str]):
    """For each text: (labels, starts, sizes, letters, evidence) of its words, starts and sizes in code points of the text.

    ``evidence`` is false for a word in a script of no language, which scores
    the same under all.
    """
    for lo, hi in _blocks(texts):
        pieces, owner = [], []
        for i in range(lo, hi):
            for p in _pieces(_lowered(texts[i])):
                pieces.append(p)
                owner.append(i - lo)
        sums, starts, sizes, letters, scripts, goes_on, text = [], [], [], [], [], [], []
        group: list[int] = []

        def score(group):
            w = words_of([pieces[g] for g in group])
            sums.append(model.sums(w))
            starts.append(w.start + np.array([pieces[g].at for g in group])[w.piece])
            sizes.append(w.size)
            letters.append(w.letters)
            scripts.append(w.script)
            goes_on.append(w.goes_on)
            text.append(np.array([owner[g] for g in group])[w.piece])

        size = 0
        for g, p in enumerate(pieces):
            if group and size + len(p.text) > BLOCK:
                score(group)
                group, size = [], 0
            group.append(g)
            size += len(p.text)
        if group:
            score(group)
        sums, start, n, n_letters, script, more, text = (np.concatenate(x) for x in (sums, starts, sizes, letters, scripts, goes_on, text))
        if more.any():
            whole = np.flatnonzero(~more)
            sums, n, n_letters = (np.add.reduceat(x, whole, axis=0) for x in (sums, n, n_letters))
            start, script, text = start[whole], script[whole], text[whole]
        scores = model.scores(sums, script)
        known = model.candidates[script].any(axis=1)
        at = np.searchsorted(text, np.arange(hi - lo + 1))
        full = np.flatnonzero(np.diff(at))
        labels = np.zeros(len(scores), dtype=np.int16)
        if len(full):
            begin = at[full]
            best = np.add.reduceat(scores.astype(np.float64), begin, axis=0).argmax(axis=1)
            labels[:] = np.repeat(best, np.diff(np.append(begin, len(scores))))
            mixed = full[~constant_is_best(scores, begin, best, model.penalty)]
            if len(mixed):
                rows = np.concatenate([np.arange(at[m], at[m + 1]) for m in mixed])
                firsts = np.cumsum([0, *(at[m + 1] - at[m] for m in mixed[:-1])])
                labels[rows] = viterbi(scores[rows], firsts, model.penalty)
        for i in range(hi - lo):
            s = slice(at[i], at[i + 1])
            yield labels[s], start[s], n[s], n_letters[s], known[s]


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_mod: int, held: int) -> DataFrame:
    """Rows to learn from: non-null language, and not held out."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(ident) % held_mod != held)).select(
        F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")
    )


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_mod: int = 4,
    held: int = 2,
    penalty: float = SWITCH_PENALTY,
) -> Model:
    """Count trigrams by language over all rows that are not held out (crc32 of the id mod ``held_mod`` is ``held``).

    Rows with a null text or language teach nothing. Without any training row
    the model knows no language and every text is undetermined.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}

        def rows():
            for lang in counts:
                hit = np.flatnonzero(counts[lang])
                seen = np.flatnonzero(scripts[lang])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(hit) + len(seen)), pa.string()),
                        pa.array(np.concatenate([hit, -seen])),
                        pa.array(np.concatenate([counts[lang][hit], scripts[lang][seen]])),
                    ],
                    names=["lang", "slot", "n"],
                )

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for t, lang in zip(batch.column(0), batch.column(1), strict=True):
                by_lang.setdefault(lang.as_py(), []).append(t.as_py())
            for lang, texts in by_lang.items():
                if lang not in counts:
                    if len(counts) >= COUNTED_LANGUAGES:  # bounds the memory; what was counted so far is summed by Spark
                        yield from rows()
                        counts.clear()
                        scripts.clear()
                    counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
                    scripts[lang] = np.zeros(N_SCRIPTS, dtype=np.int64)
                group, size = [], 0
                for p in (p for t in texts for p in _pieces(_lowered(t))):
                    if group and size + len(p.text) > BLOCK:
                        _add(counts[lang], scripts[lang], group)
                        group, size = [], 0
                    group.append(p)
                    size += len(p.text) + 2
                _add(counts[lang], scripts[lang], group)
        yield from rows()

    sums = (
        _training_rows(docs, id_col, text_col, lang_col, held_mod, held)
        .mapInArrow(count, "lang string, slot long, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )
    sums = staged(sums, "trigram_counts")
    # Slots from 0 are trigram buckets, negative ones scripts; script id 0 never occurs in a word.
    languages = sorted(r.lang for r in sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((N_SCRIPTS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    if languages:
        found = sums.toArrow()  # at most MAX_LANGUAGES * (BUCKETS + N_SCRIPTS) rows
        slot, n = found["slot"].to_numpy(), found["n"].to_numpy()
        column = np.array([place[lang] for lang in found["lang"].to_pylist()])
        tri = slot >= 0
        counts[slot[tri], column[tri]] = n[tri]
        scripts[-slot[~tri], column[~tri]] = n[~tri]
    discard(sums)
    table = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    letters = scripts.sum(axis=0)
    return Model(languages, table, scripts >= np.maximum(1, SCRIPT_SHARE * letters), int(letters.argmax()) if languages else 0, penalty)


def _add(counts: np.ndarray, scripts: np.ndarray, pieces: list[Piece]) -> None:
    w = words_of(pieces)
    counts += np.bincount(w.bucket, minlength=BUCKETS)
    scripts += np.bincount(w.script, weights=w.letters, minlength=N_SCRIPTS).astype(np.int64)


def _mapped(docs: DataFrame, model: Model, text_col: str, keep: list, rows, schema: str) -> DataFrame:
    """``rows(batch, model, labelled words of each text)``, beside the kept columns of the row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            if m.languages:
                labelled = label_words(m, texts)
            else:
                none = np.empty(0, np.int64)
                labelled = ((none,) * 5 for _ in texts)
            yield rows(batch, m, labelled)

    return docs.select(F.col(text_col).cast("string").alias("__ql_t"), *keep).mapInArrow(run, schema)


def share(model: Model, labels: np.ndarray, letters: np.ndarray, evidence: np.ndarray) -> tuple[int, float]:
    """The language that labels most letters of words with evidence, the first by name in a tie, and its share of all letters.

    Without evidence it is the commonest training language, and the share is 0.
    """
    known = np.bincount(labels, weights=letters * evidence, minlength=len(model.languages))
    k = int(known.argmax()) if known.any() else model.commonest
    return k, float(known[k] / letters.sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every row of ``docs``.

    ``lang_pred`` is the language that labels most letters (the first by name
    in a tie), ``score`` its share of all letters. Words in a script that no
    language was learnt in are no evidence; a text of such words alone gets the
    commonest training language and 0. A null text, one without letters, or a
    model without languages gives ``und`` and 0. Null and repeated ids stay
    rows of their own, other columns are not looked at, and an empty table
    gives an empty result.
    """

    def rows(batch, m, labelled):
        preds, scores = [], []
        for labels, _, _, letters, evidence in labelled:
            k, score = share(m, labels, letters, evidence) if len(labels) else (-1, 0.0)
            preds.append(m.languages[k] if len(labels) else UNDETERMINED)
            scores.append(score)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    ident = F.col(id_col).cast("long").alias("__ql_id")
    return _mapped(docs, model, text_col, [ident], rows, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``spans``: runs of words of one language as (start, end, lang), in code points of the text."""

    def rows(batch, m, labelled):
        out = []
        for labels, starts, sizes, *_ in labelled:
            cuts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else np.empty(0, int)
            ends = np.append(cuts[1:], len(labels)) - 1
            out.append([{"start": int(starts[a]), "end": int(starts[b] + sizes[b]), "lang": m.languages[labels[a]]} for a, b in zip(cuts, ends[: len(cuts)], strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, kind)], names=["doc_id", "spans"])

    ident = F.col(id_col).cast("long").alias("__ql_id")
    return _mapped(docs, model, text_col, [ident], rows, "doc_id long, spans array<struct<start:long,end:long,lang:string>>")


def filtered(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a determined language that holds at least ``min_score`` of the letters, with all columns, whatever their names; no shuffle.

    Rows that ``predict`` gives ``und`` or a lower score go.
    """
    names = docs.columns
    fields = docs.select(*[F.col(f"`{c}`").alias(f"__ql_{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"__ql_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def rows(batch, m, labelled):
        keep = [bool(len(labels)) and share(m, labels, letters, evidence)[1] >= min_score for labels, _, _, letters, evidence in labelled]
        return batch.select(range(1, batch.num_columns)).filter(pa.array(keep, pa.bool_()))

    source = f"__ql_{names.index(text_col)}"
    kept = _mapped(fields, model, source, [F.col(c) for c in fields.columns], rows, schema)
    return kept.select(*[F.col(f"__ql_{i}").alias(c) for i, c in enumerate(names)])
