"""Full text with AND, OR, NOT, phrases and stems, ranked by cover density.

A query reads like a web search: words that follow each other must all occur,
``OR`` separates alternatives, ``-`` excludes a word or phrase, quotes make a
phrase. Words count by their stems; stop words are left out but keep their
place in a phrase.

A dictionary of the store's distinct words gives the forms of the query's
stems; after that texts are only searched for these forms. A cover is a least
interval of places that satisfies the query: places are swept in order, with
the last place of each term, so one sorted pass finds all covers however long a
text is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.functions.fulltext import LABEL_WEIGHTS, TOKEN, tokens
from quarrylane.functions.stems import STOP_WORDS, inflections, stem, stems

#: Forms of a query's stems up to so many are broadcast with their stems.
BROADCAST_FORMS = 100_000

#: A word is a term of one stem at offset 0; a phrase has several.
Term = tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Alternative:
    """Terms that must all occur, and terms that must not."""

    needed: tuple[Term, ...]
    excluded: tuple[Term, ...]


def term(text: str) -> Term:
    """Stems of a word or phrase with their offsets; stop words are left out, and offsets begin at the first word kept."""
    words = re.findall(TOKEN, text.lower())
    kept = [(stem(w), i) for i, w in enumerate(words) if w not in STOP_WORDS]
    return tuple((s, i - kept[0][1]) for s, i in kept)


def parsed(query: str) -> tuple[Alternative, ...]:
    """The alternatives of a query; those that need nothing are left out, as they would match by absence alone."""
    out: list[Alternative] = []
    needed: list[Term] = []
    excluded: list[Term] = []

    def close() -> None:
        if needed:
            out.append(Alternative(tuple(dict.fromkeys(needed)), tuple(dict.fromkeys(excluded))))
        needed.clear()
        excluded.clear()

    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|(\S+))', query):
        if word == "OR" and not minus:
            close()
        elif found := term(phrase or word):
            (excluded if minus else needed).append(found)
    close()
    return tuple(out)


def dictionary(docs: DataFrame, fields: dict[str, str], first_letters: str | None = None) -> DataFrame:
    """``word``, ``stem`` of the distinct words of some text columns, or of those with certain first letters (a stem keeps its word's)."""
    words = F.array_distinct(F.concat(*[tokens(F.col(c)) for c in fields]))
    if first_letters is not None:
        words = F.filter(words, lambda w: F.lit(first_letters).contains(F.substring(w, 1, 1)))
    distinct = docs.select(F.explode(words).alias("word")).distinct()
    return distinct.where(~F.col("word").isin(*STOP_WORDS)).withColumn("stem", stems(F.col("word")))


def inflected(spark: SparkSession, query: str) -> DataFrame:
    """``word``, ``stem`` of all inflections of a query's stems, also those with two endings: forms for ``ranked`` that need no pass over the rows.

    A word that is an inflection of several stems counts for the longest.
    """
    wanted = sorted({s for a in parsed(query) for t in (*a.needed, *a.excluded) for s, _ in t}, key=lambda s: (len(s), s))
    forms = {w: s for s in wanted for w in inflections(s) if w not in STOP_WORDS}
    return spark.createDataFrame(list(forms.items()), "word string, stem string")


def _weighed(weight: float):
    return lambda t: F.struct(t.alias("word"), F.lit(weight).alias("weight"))


def postings(docs: DataFrame, key: str, fields: dict[str, str], forms: DataFrame) -> DataFrame:
    """``key``, ``pos``, ``stem``, ``weight`` of the places of some words; places run on from field to field."""
    weighted = [F.transform(tokens(F.col(c)), _weighed(LABEL_WEIGHTS[label])) for c, label in fields.items()]
    places = docs.select(F.col(key).alias("key"), F.posexplode(F.concat(*weighted)).alias("pos", "t")).select("key", "pos", "t.word", "t.weight")
    few = forms.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS
    return places.join(F.broadcast(forms) if few else forms, "word").select("key", "pos", "stem", "weight")


def covers(places: DataFrame, query: tuple[Alternative, ...]) -> DataFrame:
    """``key``, ``begin``, ``end``, ``words`` (query words inside), ``inverse`` (sum of 1 / weight) of every cover, from ``postings``."""
    terms = list(dict.fromkeys(t for a in query for t in (*a.needed, *a.excluded)))
    words = [t for t in terms if len(t) == 1]
    phrases = [t for t in terms if len(t) > 1]
    by_place = Window.partitionBy("key").orderBy("pos")
    # Of each place: how many query words, and how much inverse weight, stand up to it.
    summed = places.withColumns({"n": F.row_number().over(by_place), "inv": F.sum(1 / F.col("weight")).over(by_place.rowsBetween(Window.unboundedPreceding, 0))})
    here = F.struct(F.col("pos").alias("begin"), (F.col("n") - 1).alias("n"), (F.col("inv") - 1 / F.col("weight")).alias("inv"))
    number = {t[0][0]: i for i, t in enumerate(terms) if len(t) == 1}
    own = reduce(lambda c, s: c.when(F.col("stem") == s, F.lit(number[s])), number, F.when(F.lit(False), F.lit(-1)))
    events = summed.select("key", "pos", "n", "inv", own.alias("term"), here.alias("at"))
    for p in phrases:
        wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).alias("i")) for s, i in p])).alias("w")
        hits = summed.select("key", "pos", "stem", wanted).where("stem = w.s")
        starts = hits.groupBy("key", (F.col("pos") - F.col("w.i")).alias("begin")).agg(F.count("*").alias("found")).where(F.col("found") == len(p)).drop("found")
        # A phrase is there from the place of its last word on, and a cover of it begins at its first.
        opened = starts.join(summed.select("key", F.col("pos").alias("begin"), here.alias("at")), ["key", "begin"])
        ended = opened.withColumn("pos", F.col("begin") + p[-1][1]).join(summed.select("key", "pos", "n", "inv"), ["key", "pos"])
        events = events.unionByName(ended.select("key", "pos", "n", "inv", F.lit(terms.index(p)).alias("term"), "at"))
    upto = by_place.rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    last = {t: F.max(F.when(F.col("term") == i, F.col("at"))).over(upto) for i, t in enumerate(terms)}
    there = {t: F.coalesce(F.max(F.col("term") == terms.index(t)).over(whole), F.lit(False)) for a in query for t in a.excluded}
    seen = events.withColumns({f"last{i}": last[t] for i, t in enumerate(terms)} | {f"there{terms.index(t)}": c for t, c in there.items()})
    seen = seen.groupBy("key", "pos", "n", "inv").agg(*[F.max(c).alias(c) for c in seen.columns if c.startswith(("last", "there"))])

    def start(a: Alternative) -> Column:
        """Where the shortest interval up to here begins that holds all terms; null without one."""
        ends = [F.col(f"last{terms.index(t)}") for t in a.needed]
        least = F.least(*ends) if len(ends) > 1 else ends[0]
        allowed = [F.col(f"last{terms.index(t)}").isNotNull() for t in a.needed] + [~F.col(f"there{terms.index(t)}") for t in a.excluded]
        return F.when(reduce(lambda x, y: x & y, allowed), least)

    starts = [start(a) for a in query]
    swept = seen.withColumn("from", F.greatest(*starts) if len(starts) > 1 else starts[0])
    before = F.lag("from.begin").over(by_place)
    new = F.col("from").isNotNull() & (F.col("before").isNull() | (F.col("from.begin") > F.col("before")))
    found = swept.withColumn("before", before).where(new)
    return found.select("key", F.col("from.begin").alias("begin"), F.col("pos").alias("end"), (F.col("n") - F.col("from.n")).alias("words"), (F.col("inv") - F.col("from.inv")).alias("inverse"))


def ranked(docs: DataFrame, key: str, fields: dict[str, str], query: str, forms: DataFrame | None = None) -> DataFrame:
    """``key``, ``raw``, ``n_covers`` of the rows that match a query.

    A cover adds the harmonic mean of its words' weights, divided by one more
    than the other words that stand in it. ``fields`` maps text columns to
    weight labels. ``forms`` is a stored ``dictionary``, or ``inflected``; without one the forms
    are looked for in the rows. A query of stop words or of exclusions alone
    matches nothing; a null text is empty, and a null key is a key of its own.
    """
    alternatives = parsed(query)
    wanted = sorted({s for a in alternatives for t in (*a.needed, *a.excluded) for s, _ in t})
    if not wanted:
        return docs.where("false").select(F.col(key).alias("key"), F.lit(0.0).alias("raw"), F.lit(0).cast("long").alias("n_covers"))
    known = forms if forms is not None else dictionary(docs, fields, "".join(sorted({s[0] for s in wanted})))
    found = covers(postings(docs, key, fields, known.where(F.col("stem").isin(*wanted))), alternatives)
    noise = F.col("end") - F.col("begin") - (F.col("words") - 1)
    return found.groupBy("key").agg(F.sum(F.col("words") / F.col("inverse") / (1 + noise)).alias("raw"), F.count("*").alias("n_covers"))
