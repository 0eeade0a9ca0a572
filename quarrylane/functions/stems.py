"""English stems and stop words for full-text search.

Stems follow the published rules of the Snowball English stemmer. They are
taken once for each distinct word, never for each occurrence.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual English stop words of full-text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
    should now""".split()
)
# Words with stems of their own, and words that stay as they are.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes and what takes their place, by step; longer suffixes come first.
_STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
# Endings of a stem's forms; a form has at most one of each list, in this order.
_ENDINGS = (("", "e", "es", "ed", "ing", "ly", "edly", "ingly", "lying", "lyed"), ("", "s", "ed", "ing", "ly"))
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
_SHORT_END = re.compile(f"(?:^[{_VOWELS}][^{_VOWELS}]|[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin that a suffix must lie in."""
    for start in ("gener", "commun", "arsen"):
        if word.startswith(start):
            first = len(start)
            break
    else:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _replaced(word: str, rules, start: int) -> str | None:
    """The word by the longest rule that fits; None if none does, unchanged where it lies before ``start``."""
    for suffix, new in rules:
        if word.endswith(suffix):
            return word[: -len(suffix)] + new if len(word) - len(suffix) >= start else word
    return None


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = re.sub(f"(^|[{_VOWELS}])y", r"\1Y", word)
    r1, r2 = _regions(w)
    has_vowel = lambda s: any(c in _VOWELS for c in s)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT_LATER:
        return w
    # Past forms and gerunds.
    ending = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), "")
    if ending in ("eedly", "eed"):
        w = w[: -len(ending)] + "ee" if len(w) - len(ending) >= r1 else w
    elif ending and has_vowel(w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # Derivations, longest first.
    new = _replaced(w, _STEP_2, r1)
    if new is not None:
        w = new
    elif w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
        w = w[:-1]
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
        w = w[:-2]
    new = _replaced(w, _STEP_3, r1)
    if new is not None:
        w = new
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    suffix = next((s for s in _STEP_4 if w.endswith(s)), None)
    if suffix:
        w = w[: -len(suffix)] if len(w) - len(suffix) >= r2 else w
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def inflections(base: str) -> list[str]:
    """The forms of a stem that doesn't change before its endings: with none, one or two of them. The stemmer takes only some pairs off again.

    As for the stemmer, words of one or two letters have no other form.
    """
    if len(base) <= 2:
        return [base]
    return list(dict.fromkeys(base + first + second for first in _ENDINGS[0] for second in _ENDINGS[1]))


def stems(words: Column) -> Column:
    """The stem of each word of a column, in Arrow batches; meant for distinct words."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(stem, na_action="ignore")

    return run(words)
