"""Records in the JSON that a model writes, be it fenced, wrapped in prose or drifting in its types.

Texts become variants: nothing is inferred, and a text that is no JSON is null
instead of an error. Each record is checked by itself, and what is wrong with
it stands beside it with its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of a finding.
FINDING_TYPES = ("quantitative", "qualitative", "table", "summary", "detailed")
#: Texts of a finding that may be absent.
TEXTS = ("metric_name", "metric_value", "unit", "period", "segment", "details")
_BLANKS = r"^\s+|\s+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, _BLANKS, "")


def object_text(c: Column) -> Column:
    """The JSON object of a text: what a fence holds, or what lies between the first and last brace; else the stripped text."""
    inner = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")

    def between(text: Column) -> Column:
        first, last = F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) + 1
        has_both = (first > 0) & text.contains("}") & (last > first)
        return F.when(text.startswith("{") & text.endswith("}"), text).when(has_both, F.substr(text, first, last - first + 1)).otherwise(text)

    return let(stripped(c), lambda t: let(F.when(t.startswith("```"), inner(t)).otherwise(t), between))


def parsed(c: Column) -> Column:
    """The object of a text as a variant; null where there is none."""
    return let(F.try_parse_json(object_text(c)), lambda v: F.when(is_object(v), v))


def is_object(v: Column) -> Column:
    """Whether a variant is an object, without a look at what is in it."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def kind(v: Column) -> Column:
    """object, array, string, boolean, number or void; null for a null variant."""

    def named(name: Column) -> Column:
        out = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        return out.when(name == "VOID", "void").when(name.isNotNull(), "number")

    return let(F.schema_of_variant(v), named)


def shown(v: Column) -> Column:
    """A value as text: empty for null, false, 0 and empty strings and lists; ``True`` for true, JSON for lists and objects."""

    def text(x: Column) -> Column:
        falsy = (x["kind"] == "void") | ((x["kind"] == "number") & (x["text"].try_cast("double") == 0)) | x["text"].isin("[]", "{}")
        return F.coalesce(F.when(falsy, "").when(x["kind"] == "boolean", F.when(x["text"] == "true", "True").otherwise("")).otherwise(x["text"]), F.lit(""))

    return let(F.struct(kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")), text)


def field(v: Column, name: str) -> Column:
    """A member of an object, as a variant."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def items(v: Column) -> Column:
    """The members of an array, as variants; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def coerced_list(v: Column) -> Column:
    """A list, the JSON of a list or one value as an array of texts; nulls are left out."""
    none = F.array().cast("array<string>")
    texts = lambda a: F.transform(F.filter(F.try_variant_get(a, "$", "array<variant>"), lambda x: ~F.coalesce(F.is_variant_null(x), F.lit(True))), lambda x: F.try_variant_get(x, "$", "string"))

    def listed(x: Column) -> Column:
        of_text = let(F.when(x["kind"] == "string", F.try_parse_json(x["text"])), lambda i: F.when(kind(i) == "array", texts(i)))
        return F.when(x["kind"] == "array", texts(v)).when(x["kind"].isNull() | (x["kind"] == "void"), none).otherwise(F.coalesce(of_text, F.array(x["text"])))

    return let(F.struct(kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")), listed)


def table_of(v: Column) -> Column:
    """A table as a struct of title, columns, rows (maps of texts) and notes; null where there is neither a column nor a row.

    Rows may be objects, or lists in the order of the columns, which end with
    the columns. Without columns those of the first row are taken, in order of
    their names.
    """
    many = F.array().cast("array<variant>")
    names = F.filter(F.transform(F.coalesce(items(field(v, "columns")), many), lambda c: stripped(F.coalesce(F.try_variant_get(c, "$", "string"), F.lit("None")))), lambda c: c != "")

    def row(r: Column, columns: Column) -> Column:
        cells = F.transform(F.try_variant_get(r, "$", "array<variant>"), lambda c: F.try_variant_get(c, "$", "string"))
        paired = lambda c: F.arrays_zip(F.slice(columns, 1, F.size(c)).alias("k"), F.slice(c, 1, F.size(columns)).alias("v"))
        first = lambda e, i: (F.array_position(columns, e["k"]) == i + 1)
        by_place = let(cells, lambda c: F.map_from_entries(F.transform(F.filter(paired(c), first), lambda e: F.struct(e["k"], e["v"]))))
        return let(kind(r), lambda k: F.when(k == "object", F.try_variant_get(r, "$", "map<string,string>")).when((k == "array") & (F.size(columns) > 0), by_place))

    def filled(columns: Column) -> Column:
        rows = F.filter(F.transform(F.coalesce(items(field(v, "rows")), many), lambda r: row(r, columns)), lambda r: r.isNotNull())
        own = lambda rows: F.when(F.size(columns) > 0, columns).otherwise(F.coalesce(F.array_sort(F.map_keys(F.get(rows, F.lit(0)))), F.array().cast("array<string>")))
        return let(rows, lambda rows: F.struct(own(rows).alias("columns"), rows.alias("rows")))

    title, notes = stripped(shown(field(v, "title"))), stripped(shown(field(v, "notes")))
    whole = lambda t: F.when((F.size(t["columns"]) > 0) | (F.size(t["rows"]) > 0), F.struct(title.alias("title"), t["columns"].alias("columns"), t["rows"].alias("rows"), notes.alias("notes")))
    return F.when(kind(v) == "object", let(let(names, filled), whole))


def findings(responses: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``place`` (from 0), ``error`` and the fields of every finding of every response.

    A response without an object, or whose ``findings`` are no list, is one row
    with a null place and its error; one with an empty list has no row. Fields
    of a wrong record are null. A page is cut to a whole number.
    """
    opened = let(parsed(F.col(text)), lambda v: F.struct(v.isNull().alias("none"), let(field(v, "findings"), items).alias("items")))
    listed = responses.select(key, F.explode(F.array(opened)).alias("o")).select(key, F.col("o.none").alias("__none"), F.col("o.items").alias("__items"))
    # A response is read once: one without a list is a row without a place, an empty list is none.
    each = listed.where("__items is null or size(__items) > 0").select(key, F.when(F.col("__items").isNull(), F.when(F.col("__none"), "no JSON object").otherwise("findings must be an array")).alias("__bad"), F.posexplode_outer("__items").alias("place", "f"))
    # Members and their kinds are taken once.
    needed = ("finding", "page", "location_detail")
    member = lambda name: field(F.col("f"), name)
    taken = F.struct(is_object(F.col("f")).alias("is_object"), *[member(n).alias(n) for n in needed], *[kind(member(n)).alias(f"{n}_kind") for n in needed])
    opened = each.select(key, "place", "f", "__bad", F.explode(F.array(taken)).alias("m"))
    text_of = lambda name: stripped(F.try_variant_get(F.col(f"m.{name}"), "$", "string"))
    blank = lambda name: F.coalesce((F.col(f"m.{name}_kind") != "string") | (text_of(name) == ""), F.lit(True))
    error = (
        F.when(F.col("__bad").isNotNull(), F.col("__bad"))
        .when(~F.coalesce(F.col("m.is_object"), F.lit(False)), "each finding must be an object")
        .when(blank("finding"), "finding text is required")
        .when(~F.coalesce(F.col("m.page_kind").isin("number", "boolean"), F.lit(False)), "finding page is required")
        .when(blank("location_detail"), "finding location_detail is required")
    )
    page = F.col("m.page")
    fields = {
        "finding": text_of("finding"),
        "page": F.when(F.col("m.page_kind") == "boolean", F.try_variant_get(page, "$", "boolean").cast("long")).otherwise(F.try_variant_get(page, "$", "double").cast("long")),
        "location_detail": text_of("location_detail"),
        "source_ref_ids": let(member("source_ref_ids"), coerced_list),
        **{n: let(member(n), shown) for n in TEXTS},
        "finding_type": let(F.lower(stripped(let(member("finding_type"), shown))), lambda t: F.when(t.isin(*FINDING_TYPES), t).otherwise("")),
        "table": let(member("table"), table_of),
    }
    checked = opened.withColumn("error", error)
    return checked.select(key, "place", "error", *[F.when(F.col("error").isNull(), c).alias(n) for n, c in fields.items()])


def accepted(found: DataFrame, key: str) -> DataFrame:
    """``key``, ``n`` and ``error`` of each response with a row: its findings count only if none is wrong; the first error is told with its place."""
    said = F.concat(F.coalesce(F.concat(F.lit("finding "), F.col("place").cast("string"), F.lit(": ")), F.lit("")), F.col("error"))
    wrong = found.groupBy(key).agg(F.count("*").alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct(F.coalesce("place", F.lit(-1)).alias("p"), said.alias("said")))).alias("w"))
    return wrong.select(key, F.when(F.col("w").isNull(), F.col("n")).otherwise(0).alias("n"), F.col("w.said").alias("error"))
