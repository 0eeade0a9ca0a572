"""Boolean full text: stems, queries and covers against brute force."""

import random
import re

import duckdb
import pytest

from quarrylane.functions.fulltext import LABEL_WEIGHTS
from quarrylane.functions.stems import STOP_WORDS, inflections, stem
from quarrylane.operators import boolean_text as B
from quarrylane.plans import fulltext as F

FIELDS = {"name": "A", "body": "C"}


def occurrences(words, t):
    """(begin, end) of each place of a term in a list of stems."""
    return [(i, i + t[-1][1]) for i in range(len(words)) if all(i + o < len(words) and words[i + o] == s for s, o in t)]


def brute(fields, query):
    """(rank, covers): all intervals that satisfy the query and hold no smaller one that does."""
    words, weights = [], []
    for name, label in FIELDS.items():
        found = [None if w in STOP_WORDS else stem(w) for w in re.findall("[a-z0-9]+", (fields[name] or "").lower())]
        words += found
        weights += [LABEL_WEIGHTS[label]] * len(found)
    query = [a for a in B.parsed(query) if not any(occurrences(words, t) for t in a.excluded)]
    satisfied = lambda i, j: any(all(any(i <= b and e <= j for b, e in occurrences(words, t)) for t in a.needed) for a in query)
    good = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if satisfied(i, j)]
    least = [(i, j) for i, j in good if not any((a, b) != (i, j) and i <= a and b <= j for a, b in good)]
    return least, words, weights


def rank(least, words, weights, query):
    wanted = {s for a in B.parsed(query) for t in (*a.needed, *a.excluded) for s, _ in t}
    total = 0.0
    for i, j in least:
        inside = [weights[p] for p in range(i, j + 1) if words[p] in wanted]
        total += len(inside) / sum(1 / w for w in inside) / (1 + (j - i) - (len(inside) - 1))
    return total


QUERIES = ["bank loan", "bank OR loan", "bank -loan", '"net income" bank', '"net income" OR loan bank', '"bank of loan"', "bank loan growth -net OR income", '"bank bank" loan', '-"net income" bank', "banks banking"]


@pytest.mark.parametrize("query", QUERIES)
def test_covers_match_brute_force(spark, query):
    rng = random.Random(5)
    vocabulary = ["bank", "Banks", "banking", "loan", "loans", "net", "income", "the", "of", "growth", "other", "words"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))
    rows = [(i, text(5), text(14)) for i in range(60)] + [(100, None, None), (101, "", "bank loan"), (102, "net income", None)]
    got = {r.key: (r.raw, r.n_covers) for r in B.ranked(spark.createDataFrame(rows, "id long, name string, body string"), "id", FIELDS, query).collect()}
    want = {}
    for i, name, body in rows:
        least, words, weights = brute({"name": name, "body": body}, query)
        if least:
            want[i] = (rank(least, words, weights, query), len(least))
    assert got.keys() == want.keys() and want
    assert all(abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1] for i in want)


def test_parsing():
    t = lambda *words: tuple((w, i) for i, w in words)
    assert B.parsed('revenues "net income" -losses OR "cost of funds"') == (B.Alternative((t((0, "revenu")), t((0, "net"), (1, "incom"))), (t((0, "loss")),)), B.Alternative((t((0, "cost"), (2, "fund")),), ()))
    assert B.parsed("") == B.parsed("the of") == B.parsed("-bank") == B.parsed("OR OR") == ()
    assert B.parsed('"open phrase') == (B.Alternative((t((0, "open"), (1, "phrase")),), ()),)


def test_queries_without_terms_match_nothing(spark):
    rows = spark.createDataFrame([(1, "bank", "loan")], "id long, name string, body string")
    for query in ("", "the", "-bank", "-the OR of"):
        assert B.ranked(rows, "id", FIELDS, query).collect() == []
    assert B.ranked(rows.where("false"), "id", FIELDS, "bank").collect() == []


def test_stored_dictionary_gives_the_same(spark):
    rows = spark.createDataFrame([(1, "Banking", "on loans"), (2, "bank", None)], "id long, name string, body string")
    forms = B.dictionary(rows, FIELDS)
    assert {(r.word, r.stem) for r in forms.collect()} == {("banking", "bank"), ("loans", "loan"), ("bank", "bank")}
    assert sorted(map(tuple, B.ranked(rows, "id", FIELDS, "banks", forms).collect())) == sorted(map(tuple, B.ranked(rows, "id", FIELDS, "banks").collect()))


def test_stems():
    # Words and stems from the published description of the stemmer.
    known = "consign consign consigned consign consistency consist consolation consol knightly knight kneeling kneel hopping hop hoping hope happily happili generously generous communication communic relational relat sensibly sensibl replacement replac adoption adopt controlling control agreed agre running run dying die skies sky news news revenues revenu earnings earn"
    words = known.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))


@pytest.mark.parametrize("name", ["fulltext_and", "fulltext_not", "fulltext_phrase_or"])
def test_queries_know_words_with_two_endings(spark, tmp_path, name):
    texts = ["tionlyly of ment", "tionesing x mente", "Tioninging de rewhinging", "tioneded, ments eauinged", "tionesly de tion de", "tion ment eau", "rewhesly tionedsed ment", "tioness ment tionlyingly ment", "tionings de", "tion des tioned ded", ""]
    spark.createDataFrame([*enumerate(texts), (90, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, F.CATALOG.queries[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(F.CATALOG.sql[name]).fetchall()) and got


def test_inflections_count_for_the_longest_stem(spark):
    forms = {r.word: r.stem for r in B.inflected(spark, "loan -loaned OR the").collect()}
    assert forms["loaninged"] == forms["loan"] == "loan" and len(forms) == len(inflections("loan"))
    assert B.inflected(spark, "the").count() == 0
