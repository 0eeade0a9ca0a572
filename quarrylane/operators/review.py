"""What a reviewer takes out of the hits of many scopes, from its answers as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hits that a reviewer sees, that are kept at most, and that are left at least.
POOL, KEEP, FLOOR = 30, 20, 10


def removals(answer: Column) -> Column:
    """Distinct indices of a JSON list: integers, whole decimals, and texts of digits; all else in it is passed over.

    Null for an answer that is null, no JSON or no list, so that nothing of it is followed.
    """

    def index(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        text = F.trim(F.try_variant_get(item, "$", "string"))
        number = F.try_variant_get(item, "$", "double")
        whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("long"))
        return F.when(kind == "STRING", F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), whole)

    # As the only item of a list, an answer with words after its JSON doesn't parse, which it would by itself.
    answers = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), answer, F.lit("]"))), "$", "array<variant>")
    items = F.when(F.size(answers) == 1, F.try_variant_get(F.get(answers, F.lit(0)), "$", "array<variant>"))
    return F.array_distinct(F.array_compact(F.transform(items, index)))


def reviewed(hits: DataFrame, answers: DataFrame, by: Sequence[str], score: str, key: str, pool: int = POOL, keep: int = KEEP, floor: int = FLOOR) -> DataFrame:
    """Hits that stay in each scope, with ``rank``, their place among the scope's best ``pool``, from 0, and ``restored``.

    ``answers``: ``by`` and ``answer``, at most one a scope, whose indices are
    such places. A scope of at most ``keep`` hits needs no review, and one
    without an answer that is a list keeps all its pool; of what stays, the best
    ``keep`` are returned. Where removals leave fewer than ``floor``, the best
    removed stay as well. Equal scores are in order of the key, which should
    tell hits apart; a null score comes last. The pool is taken before hits are
    brought together, so a scope may have any number of them.
    """
    scope = Window.partitionBy(*by)
    place = F.row_number().over(scope.orderBy(F.desc_nulls_last(score), key))
    pooled = hits.withColumn("rank", place).where(F.col("rank") <= max(pool, keep + 1)).withColumn("rank", F.col("rank") - 1)
    theirs = answers.select(*[F.col(c).alias(f"__{c}") for c in by], removals(F.col("answer")).alias("__out"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = pooled.join(theirs, same, "left").withColumn("__many", F.count("*").over(scope) > keep)
    met = met.where(~F.col("__many") | (F.col("rank") < pool)).withColumn("__gone", F.col("__many") & F.coalesce(F.array_contains("__out", F.col("rank").cast("long")), F.lit(False)))
    left = F.count_if(~F.col("__gone")).over(scope)
    again = F.count_if("__gone").over(scope.orderBy("rank")) <= F.greatest(F.lit(0), F.least(F.lit(floor), F.count("*").over(scope)) - left)
    met = met.withColumn("restored", F.col("__gone") & again).where(~F.col("__gone") | F.col("restored"))
    return met.withColumn("__n", F.row_number().over(scope.orderBy("rank"))).where(F.col("__n") <= keep).select(*hits.columns, "rank", "restored")
