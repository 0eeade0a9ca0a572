"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; a policy is a named, versioned mask over the bits,
so a changed policy is a bitwise AND over stored rows and reads no text. What
each rule adds to a policy (its ablation) follows from the few distinct bit
patterns and their counts. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds; ``bit`` is its place in the ledger for ever."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_flood", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Documents that fail any of ``rules`` are rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("prose-1", ("too_few_words", "repeated_words", "symbol_flood", "repeated_lines")),
    Policy("prose-2", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more in the array."""

    def covered(hashes: Column) -> Column:
        def places(s: Column) -> Column:
            twin = lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
            return F.array_sort(F.array_compact(F.transform(s, lambda e, j: F.when(twin(e, j), e["i"]))))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW))).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(_let(ordered, places), total))

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return _let(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])), covered)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_let(words, hashed))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measurements and ``failed`` (the bitmask), then the columns in ``keep``.

    Measurements (long): ``n_words``, ``word_chars`` (code points in words),
    ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines`` (such lines
    equal to an earlier one), ``n_repeat_words`` (words in windows of five that
    occur twice or more). A null text counts as one without words; the id may
    be null or repeated, and each row is judged alone, whole and whatever its
    length. An empty table gives an empty ledger. Columns in ``keep`` come back
    as ``__ql_keep_0``, ``__ql_keep_1``, ... so that none clashes with the
    ledger's own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"__ql_{i}") for i, c in enumerate(keep)]
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__ql_t"), *kept)
    parts = base.select(
        "doc_id",
        *[f"__ql_{i}" for i in range(len(keep))],
        F.regexp_extract_all("__ql_t", F.lit(WORD), F.lit(0)).alias("__ql_w"),
        F.filter(F.split("__ql_t", "\n", -1), lambda x: x.rlike(WORD)).alias("__ql_l"),
        F.regexp_count("__ql_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    measured = parts.select(
        "doc_id",
        F.size("__ql_w").cast("long").alias("n_words"),
        F.length(F.array_join("__ql_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__ql_l").cast("long").alias("n_lines"),
        (F.size("__ql_l") - F.size(F.array_distinct("__ql_l"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("__ql_w")).alias("n_repeat_words"),
        *[f"__ql_{i}" for i in range(len(keep))],
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return measured.select("doc_id", *names, bits.alias("failed"), *[F.col(f"__ql_{i}").alias(f"__ql_keep_{i}") for i in range(len(keep))])


def passes(policy: Policy = CURRENT, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def filtered(docs: DataFrame, policy: Policy = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with the columns of ``docs``; no shuffle."""
    names = docs.columns
    kept = ledger(docs, id_col, text_col, keep=tuple(names)).where(passes(policy))
    return kept.select(*[F.col(f"__ql_keep_{i}").alias(c) for i, c in enumerate(names)])


def ablations(ledger_rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: ``n_failed``, ``n_only`` (rejected by this rule alone, so kept without it), ``n_rejected`` by the policy.

    Documents are first summed by bit pattern, of which there are at most two
    to the number of rules, and policies meet the patterns only.
    """
    patterns = ledger_rows.groupBy("failed").agg(F.count("*").alias("n"))
    masks = F.array(
        *[
            F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
            for p in policies
            for r in RULES
            if r.name in p.rules
        ]
    )
    hit = F.col("failed").bitwiseAND(F.col("m.mask"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
    return (
        patterns.select("failed", "n", F.explode(masks).alias("m"))
        .groupBy(F.col("m.policy").alias("policy"), F.col("m.rule").alias("rule"))
        .agg(
            count(hit.bitwiseAND(F.col("m.bit")) != 0).alias("n_failed"),
            count(hit == F.col("m.bit")).alias("n_only"),
            count(hit != 0).alias("n_rejected"),
        )
    )
