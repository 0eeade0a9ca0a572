"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that brings it to its share of the
mix. A document's number of copies inverts the Poisson distribution of that
mean at a uniform value seeded by a hash of its id, so it is the same wherever
and however often it is computed. Rows whose id is null or repeated are told
apart by their text, and equal ones of these by a number. Copies are then
shuffled globally by another hash. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.staging import staged

#: Up to so many sources their rates are broadcast; beyond, they are joined by a shuffle with salted keys.
BROADCAST_SOURCES = 10_000
#: Up to so many repeated ids are broadcast.
BROADCAST_IDS = 100_000
SALTS = 32
#: A higher mean is drawn as a sum of Poisson parts of at most this mean, so that exp(-mean) stays a normal number.
MAX_MEAN = 512.0
DEFAULT_SEED = 20240


def unit(seed: int, what: str, *parts: Column) -> Column:
    """A uniform value in [0, 1) from 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", F.lit(f"{what}{seed}"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """Array of the Poisson probabilities of at most 0, 1, ... copies, as far as double precision tells them from 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda a, k: F.struct(
        (a["p"] * mean / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * mean / k)).alias("cdf")
    )
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", epochs: float = 1.0) -> DataFrame:
    """``source``, ``n`` (documents), ``rate`` (mean copies of a document).

    The mix has ``epochs`` times the input's documents. ``weights`` are target
    shares by source and may sum to less than 1; sources without one share the
    rest in proportion to the square root of their size. A null source is a
    source of its own, named ''. A weight of 0 removes a source; if the weights
    sum to 1, sources without one get nothing.
    """
    weights = dict(weights or {})
    stated = sum(weights.values())
    if any(w < 0 for w in weights.values()) or stated > 1 + 1e-9:
        raise ValueError("target weights must not be negative nor sum to more than 1")
    counts = staged(docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n")), "source_counts")
    target = F.lit(None).cast("double")
    if weights:
        named = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*[F.lit(float(w)) for w in weights.values()]))
        target = F.try_element_at(named, F.col("source"))
    # Decimals, so that the sum doesn't hang on the order of rows.
    size = F.when(target.isNull(), F.round(F.sqrt("n"), 9)).otherwise(F.lit(0.0)).cast("decimal(38,9)")
    total = counts.agg(F.sum("n").alias("n"), F.sum(size).cast("double").alias("size")).first()
    rest = max(0.0, 1 - stated)
    share = F.coalesce(target, F.lit(rest) * size.cast("double") / F.lit(total.size or 1.0))
    return counts.select("source", "n", (share * F.lit(float(epochs * (total.n or 0))) / F.col("n")).alias("rate"))


def copies(rate: Column, cdf: Column, seed: int, *ident: Column) -> Column:
    """Number of copies of a document: the inverse of the Poisson distribution at its hash, summed over the parts of a high mean."""
    one = lambda part: F.size(F.filter(cdf, lambda c: c <= unit(seed, "copies", *ident, part))).cast("long")
    return F.aggregate(F.sequence(F.lit(1), parts(rate)), F.lit(0).cast("long"), lambda n, part: n + one(part))


def parts(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rate / MAX_MEAN).cast("int"))


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with a column ``__ql_ident`` (string) that no two rows share: the id where it is a row's own, else id, text hash and a number.

    Rows that are equal in id and text are numbered from 0, so which of them has
    which number makes no difference. Numbers come from those within a
    partition and a running sum over partitions; no group meets in one task.
    """
    ident = F.col(f"`{id_col}`").cast("string")
    repeated = staged(docs.groupBy(ident.alias("__ql_id")).agg(F.count("*").alias("n")).where("__ql_id is null or n > 1").select("__ql_id"), "repeated_ids")
    n = repeated.count()
    if not n:
        return docs.withColumn("__ql_ident", ident)
    named = repeated.where("__ql_id is not null").withColumn("__ql_odd", F.lit(True))
    if n <= broadcast_ids:
        named = F.broadcast(named)
    marked = docs.where(ident.isNotNull()).join(named, ident == F.col("__ql_id"), "left").drop("__ql_id")
    own = marked.where("__ql_odd is null").drop("__ql_odd").withColumn("__ql_ident", ident)
    text = F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) if text_col in docs.columns else F.lit("")
    odd = marked.where("__ql_odd").drop("__ql_odd").unionByName(docs.where(ident.isNull()))
    odd = staged(odd.withColumn("__ql_ident", F.concat_ws("|", F.coalesce(ident, F.lit("")), text)).withColumn("__ql_part", F.spark_partition_id()), "repeated_rows")
    counts = odd.groupBy("__ql_ident", "__ql_part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("__ql_ident").orderBy("__ql_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__ql_ident", "__ql_part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("__ql_before"))
    here = F.row_number().over(Window.partitionBy("__ql_ident", "__ql_part").orderBy(F.lit(1))) - 1
    numbered = odd.withColumn("__ql_here", here).join(offsets, ["__ql_ident", "__ql_part"])
    number = (F.col("__ql_before") + F.col("__ql_here")).cast("string")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return own.unionByName(numbered.select(*names, F.concat_ws("|", "__ql_ident", number).alias("__ql_ident")))


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    epochs: float = 1.0,
    seed: int = DEFAULT_SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
    copy_col: str = "copy_no",
    key_col: str = "mix_key",
) -> DataFrame:
    """The columns of ``docs``, then ``copy_col`` (long, from 0) and ``key_col`` (string): one row per copy, dealt to partitions and ordered there by the key.

    Ordering everything by the key gives one fixed global shuffle. Rows whose
    id is null or repeated get copies and keys of their own (see
    ``told_apart``), so no key is hot. An empty table gives an empty mix; a
    null text counts as empty.
    ``docs`` may have any other columns; of those named as the two added ones the added ones must be renamed.
    """
    if clash := {copy_col, key_col} & set(docs.columns):
        raise ValueError(f"name the added columns otherwise: {sorted(clash)} are columns of the documents")
    by_source = rates(docs, weights, source_col, epochs)
    small = by_source.select(F.col("source").alias("__ql_source"), F.col("rate").alias("__ql_rate"), cumulative(F.col("rate") / parts(F.col("rate"))).alias("__ql_cdf"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    ident = F.col("__ql_ident")
    tagged = told_apart(docs, id_col, text_col).withColumn("__ql_key", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    if by_source.limit(broadcast_sources + 1).count() <= broadcast_sources:
        joined = tagged.join(F.broadcast(small), F.col("__ql_key") == F.col("__ql_source"))
    else:
        # A hot source is dealt over all salts; the rates are repeated once for each.
        salted = small.withColumn("__ql_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salt = F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int")
        joined = tagged.withColumn("__ql_own", salt).join(salted, (F.col("__ql_key") == F.col("__ql_source")) & (F.col("__ql_own") == F.col("__ql_salt")))
    n = copies(F.col("__ql_rate"), F.col("__ql_cdf"), seed, ident)
    copied = joined.withColumn("__ql_n", n).where("__ql_n > 0").select(*names, ident, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__ql_n") - 1)).alias(copy_col))
    key = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), ident, F.col(copy_col).cast("string")))
    return copied.withColumn(key_col, key).drop("__ql_ident").repartition(key_col).sortWithinPartitions(key_col)
