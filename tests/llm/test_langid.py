import random
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from quarrylane.llm import langid
from tests.llm.fixtures import DOC_SCHEMA, awkward

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def brute(scores, penalty):
    """Best path by trying all."""
    n, k = scores.shape
    return max(sum(scores[i, p[i]] for i in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:])) for p in product(range(k), repeat=n))


def value(scores, labels, penalty):
    return scores[np.arange(len(labels)), labels].sum() - penalty * (labels[1:] != labels[:-1]).sum()


def test_viterbi_is_optimal_and_shortcut_is_sound():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 7, 3)
        scores = rng.normal(0, 2, (sizes.sum(), 3))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        labels = langid.viterbi(scores, starts, 2.0)
        best = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)
        plain = langid.constant_is_best(scores, starts, best, 2.0)
        for i, (a, n) in enumerate(zip(starts, sizes)):
            want = brute(scores[a : a + n], 2.0)
            assert abs(value(scores[a : a + n], labels[a : a + n], 2.0) - want) < 1e-9
            if plain[i]:
                assert abs(scores[a : a + n, best[i]].sum() - want) < 1e-9


def test_held_out_accuracy(spark, model):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.predict(table, model).join(table, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").select("lang", "lang_pred").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 150 and right / len(got) > 0.97


def plain_words(text):
    """(code points with their neighbours, script, letters) of each word, a code point at a time."""
    low = [x if len(x := c.lower()) == 1 else c for c in text]
    kind = [unicodedata.category(c)[0] in "LM" for c in low]
    out, at = [], 0
    while at < len(low):
        end = at
        while end < len(low) and kind[end]:
            end += 1
        if letters := sum(unicodedata.category(c)[0] == "L" for c in low[at:end]):
            point = lambda i: ord(low[i]) if 0 <= i < len(low) and kind[i] else 0
            script = next((n + 2 for n, ranges in enumerate(langid.SCRIPT_RANGES.values()) if any(a <= ord(low[at]) <= b for a, b in ranges)), 1)
            out.append(([tuple(point(i + d) for d in (-1, 0, 1)) for i in range(at, end)], script, letters))
        at = max(end, at + 1)
    return out


def plain_bucket(trigram):
    h = sum(c * f for c, f in zip(trigram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) & 0xFFFFFFFF
    return (((h ^ (h >> 15)) * 0x27D4EB2F) & 0xFFFFFFFF) >> 16


def plain_train(rows):
    """(languages, log probability of a bucket by language, candidate languages by script, commonest)."""
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for trigrams, script, letters in plain_words(text):
                counts[lang].update(map(plain_bucket, trigrams))
                scripts[lang][script] += letters
    log = {x: lambda b, c=c, n=sum(c.values()): np.log((c[b] + langid.SMOOTHING) / (n + langid.SMOOTHING * langid.BUCKETS)) for x, c in counts.items()}
    wide = lambda s: {x for x, c in scripts.items() if c[s] >= max(1, langid.SCRIPT_SHARE * sum(c.values()))}
    return sorted(counts), log, wide, max(sorted(counts), key=lambda x: sum(scripts[x].values()))


def plain_predict(text, trained):
    languages, log, wide, commonest = trained
    words = plain_words(text or "")
    if not words:
        return "und", 0.0
    paths = {x: (0.0, []) for x in languages}
    for n, (trigrams, script, _) in enumerate(words):
        score = {x: sum(log[x](plain_bucket(t)) for t in trigrams) for x in languages}
        top = max(score.values())
        if allowed := wide(script):
            score = {x: s if x in allowed else langid.NOT_CANDIDATE + top for x, s in score.items()}
        else:
            score = dict.fromkeys(languages, 0.0)
        best = max(languages, key=lambda x: paths[x][0])
        stay = {x: n == 0 or paths[x][0] >= paths[best][0] - langid.SWITCH_PENALTY for x in languages}
        paths = {x: (paths[x][0] + score[x], [*paths[x][1], x]) if stay[x] else (paths[best][0] - langid.SWITCH_PENALTY + score[x], [*paths[best][1], x]) for x in languages}
    labels = max(paths.values(), key=lambda p: p[0])[1]
    known = Counter()
    for label, (_, script, letters) in zip(labels, words):
        known[label] += letters * bool(wide(script))
    pick = max(languages, key=lambda x: known[x]) if any(known.values()) else commonest
    return pick, known[pick] / sum(letters for _, _, letters in words)


def test_predict_matches_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text[:3000], r.lang) for r in table.collect()]
    extra = ["", "\u0301 12", "数据 слово", "die " + "слово" * 3, "e\u0301te\u0301 the", "Straße und the of and " * 9]
    rows += [(1000 + i, t, None) for i, t in enumerate(extra)]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(small)
    trained = plain_train(rows)
    assert model.languages == trained[0] and model.languages[model.commonest] == trained[3]
    for b in range(0, langid.BUCKETS, 97):
        assert np.allclose(model.table[b], [trained[1][x](b) for x in trained[0]], rtol=1e-4)
    for r in langid.predict(small, model).collect():
        lang, score = plain_predict(rows[r.doc_id][1] if r.doc_id < 1000 else extra[r.doc_id - 1000], trained)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_marks_are_no_letters_and_unknown_scripts_no_evidence(spark, model):
    texts = ["\u0301 12", "\u0301\u0302", "数据", "e\u0301", "数据数据数据 the"]
    got = [r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()]
    assert [r.lang_pred for r in got[:2]] == ["und", "und"]
    assert got[2].lang_pred == model.languages[model.commonest] and got[2].score == 0
    assert got[3].score == 1 and got[4].score == 3 / 9
    kept = langid.filtered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert [r.doc_id for r in kept.collect()] == [3]


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "COUNTED_LANGUAGES", 3)
    rows = [(i, f"word{chr(97 + i % 20)} more of it", f"l{i % 20:02d}", "s", 0) for i in range(200)]
    table = spark.createDataFrame(rows, DOC_SCHEMA)
    assert langid.train(table).languages == [f"l{i:02d}" for i in range(20)]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 19)
    with pytest.raises(ValueError):
        langid.train(table)


def test_spans_of_mixed_text(spark, model):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    pick = {lang: table.where(f"lang = '{lang}' and n_chars > 600").orderBy("doc_id").first().text[:400] for lang in ("de", "fr")}
    text = pick["de"] + " 123 ... " + pick["fr"]
    mixed = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = langid.spans(mixed, model).first().spans
    assert {"de", "fr"} <= {s.lang for s in found}
    switch = next(s for s in found if s.lang == "fr" and s.end - s.start > 100)
    assert abs(switch.start - len(pick["de"])) < 60
    assert found[0].start == next(i for i, c in enumerate(text) if c.isalpha())


def test_awkward_rows(spark, model):
    table = awkward(spark)
    got = langid.predict(table, model).collect()
    assert len(got) == table.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[6].lang_pred == "und" and by_id[1].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.filtered(table, model)
    assert kept.columns == table.columns and kept.count() == 5
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert langid.predict(empty, model).collect() == []
    none = langid.train(empty)
    assert none.languages == [] and {r.lang_pred for r in langid.predict(table, none).collect()} == {"und"}


def test_script_narrows(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("слово и дело", "ru"), ("word and deed", "en"), ("ordet og handling", "da")] * 8)]
    model = langid.train(spark.createDataFrame(rows, DOC_SCHEMA))
    got = langid.predict(spark.createDataFrame([(100, "незнакомый"), (101, "数据")], "doc_id long, text string"), model).collect()
    assert got[0].lang_pred == "ru"
    assert got[1].lang_pred in ("da", "en", "ru")


def test_long_text_in_pieces(spark, model, monkeypatch):
    table = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 3000").limit(5)
    texts = [r.text for r in table.collect()]
    whole = [[x.tolist() for x in words] for words in langid.label_words(model, texts)]
    monkeypatch.setattr(langid, "BLOCK", 500)
    assert [[x.tolist() for x in words] for words in langid.label_words(model, texts)] == whole


def test_cut_runs_of_letters_score_as_whole_ones(model, monkeypatch):
    """Runs longer than a block, of letters, of letters and marks, and of marks alone, give the words and trigrams of the whole text."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeéжя́́ -א") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["́" * 40, "́" * 40 + "a", "a" + "́" * 40, "x" * 41 + " " + "́" * 30 + " y", "ж" * 20 + "a" * 20, ""]

    def outcome():
        labelled = [[x.tolist() for x in words] for words in langid.label_words(model, texts)]
        counts, scripts = np.zeros(langid.BUCKETS, dtype=np.int64), np.zeros(langid.N_SCRIPTS, dtype=np.int64)
        for t in texts:
            langid._add(counts, scripts, list(langid._pieces(langid._lowered(t))))
        return labelled, counts, scripts

    labelled, counts, scripts = outcome()
    for block in (1, 2, 3, 7, 16):
        monkeypatch.setattr(langid, "BLOCK", block)
        cut, cut_counts, cut_scripts = outcome()
        assert [x[1:] for x in cut] == [x[1:] for x in labelled]
        assert np.array_equal(cut_counts, counts) and np.array_equal(cut_scripts, scripts)
        assert sum(a[0] != b[0] for a, b in zip(cut, labelled, strict=True)) == 0
