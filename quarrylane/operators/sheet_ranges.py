"""Ranges of sheets: references of chart series resolved to cells, previews of their points, merged cells filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a band; a range meets the cells of the bands it lies in.
BAND_ROWS = 256
#: Fixed value: points shown of a series.
PREVIEW_POINTS = 12
# A reference to a cell or range of one sheet, and the last row and column of a sheet.
REFERENCE = r"^=?(?:'((?:[^']|'')*)'|([^'!]+))!\$?([A-Za-z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Za-z]{1,3})\$?([0-9]{1,7}))?$"
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384


def column_number(letters: Column) -> Column:
    """1 for A, 26 for Z, 27 for AA; null for what is not one to three letters."""
    upper = F.upper(letters)
    digit = lambda i: F.ascii(F.substring(upper, i, 1)) - 64
    two = digit(1) * 26 + digit(2)
    number = F.when(F.length(upper) == 1, digit(1)).when(F.length(upper) == 2, two).otherwise(two * 26 + digit(3))
    return F.when(upper.rlike("^[A-Z]{1,3}$"), number).cast("int")


def bounds(reference: Column) -> Column:
    """(sheet, r0, r1, c0, c1) of a reference such as ``'Sheet 1'!$B$2:$B$13`` or ``Data!C4``.

    A quote in a sheet's name is doubled. Corners may come in any order. Null for
    text that is no such reference, for several areas, and beyond a sheet's ends.
    """
    part = lambda i: F.regexp_extract(F.trim(reference), REFERENCE, i)
    sheet = F.when(part(2) != "", part(2)).otherwise(F.replace(part(1), F.lit("''"), F.lit("'")))
    ra, ca = part(4).try_cast("int"), column_number(part(3))
    rb, cb = F.coalesce(part(6).try_cast("int"), ra), F.coalesce(column_number(part(5)), ca)
    found = F.struct(sheet.alias("sheet"), F.least(ra, rb).alias("r0"), F.greatest(ra, rb).alias("r1"), F.least(ca, cb).alias("c0"), F.greatest(ca, cb).alias("c1"))
    inside = (F.least(ra, rb) >= 1) & (F.greatest(ra, rb) <= LAST_ROW) & (F.greatest(ca, cb) <= LAST_COLUMN)
    return F.when(F.trim(reference).rlike(REFERENCE) & inside, found)


def cells_in(ranges: DataFrame, cells: DataFrame, book: str, at: str = "at") -> DataFrame:
    """``ranges`` beside each cell that they cover, with ``row``, ``col``, ``text`` and ``index`` (1 for the first corner, along rows).

    ``ranges`` has the ``book`` column and ``at`` as ``bounds`` gives it; a null one covers
    nothing. An interval join as an equality on (book, sheet, band of rows): a
    cell is in one band, a range in those it crosses.
    """
    band = lambda r: F.floor(r / BAND_ROWS).cast("int")
    wanted = ranges.where(F.col(at).isNotNull()).withColumn("__band", F.explode(F.sequence(band(F.col(f"{at}.r0")), band(F.col(f"{at}.r1")))))
    own = cells.select(F.col(book).alias("__book"), F.col("sheet").alias("__sheet"), band(F.col("row")).alias("__b"), F.col("row").alias("__row"), F.col("col").alias("__col"), F.col("text").alias("__text"))
    near = (F.col(book) == F.col("__book")) & (F.col(f"{at}.sheet") == F.col("__sheet")) & (F.col("__band") == F.col("__b"))
    inside = F.col("__row").between(F.col(f"{at}.r0"), F.col(f"{at}.r1")) & F.col("__col").between(F.col(f"{at}.c0"), F.col(f"{at}.c1"))
    width = F.col(f"{at}.c1") - F.col(f"{at}.c0") + 1
    index = (F.col("__row") - F.col(f"{at}.r0")).cast("long") * width + F.col("__col") - F.col(f"{at}.c0") + 1
    named = {"__row": "row", "__col": "col", "__text": "text"}
    return wanted.join(own, near & inside).withColumn("index", index).select(*ranges.columns, *[F.col(a).alias(b) for a, b in named.items()], "index")


def series_points(series: DataFrame, cells: DataFrame, book: str, key: list[str], categories: str = "categories", values: str = "values") -> DataFrame:
    """``key``, ``index``, ``point`` (``category: value``) of each series of chart references.

    The i-th cell of one range pairs with the i-th of the other. A point without
    category is named ``Point i``; one without either is left out, and a reference that can't
    be resolved gives blanks, so that a series of two such has no points. ``key`` tells series apart.
    """
    sides = [series.select(*key, book, F.lit(name).alias("__side"), bounds(F.col(c)).alias("at")) for name, c in (("c", categories), ("v", values))]
    met = cells_in(sides[0].union(sides[1]), cells, book).where(F.coalesce("text", F.lit("")) != "")
    of = lambda name: F.max(F.when(F.col("__side") == name, F.col("text")))
    paired = met.groupBy(*key, "index").agg(of("c").alias("__c"), of("v").alias("__v"))
    label = F.coalesce("__c", F.concat(F.lit("Point "), F.col("index").cast("string")))
    return paired.select(*key, "index", F.concat(label, F.lit(": "), F.coalesce("__v", F.lit(""))).alias("point"))


def previews(points: DataFrame, key: list[str], limit: int = PREVIEW_POINTS) -> DataFrame:
    """``key``, ``n_points`` and ``preview``: the first ``limit`` points, ``; `` between them. Only those are gathered."""
    first = points.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("index"))).where(F.col("__n") <= limit)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("index", "point"))), lambda p: p["point"])
    shown = first.groupBy(*key).agg(F.array_join(texts, "; ").alias("preview")).select(*[F.col(k).alias(f"__{k}") for k in key], "preview")
    counts = points.groupBy(*key).agg(F.count("*").alias("n_points"))
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return counts.join(shown, same).select(*key, "n_points", "preview")


def merged_filled(cells: DataFrame, merges: DataFrame, book: str) -> DataFrame:
    """``book``, ``sheet``, ``row``, ``col``, ``text`` with each merged range's first cell repeated over the range.

    ``merges`` has ``book``, ``sheet`` and ``ref`` such as ``B2:D4``. Cells in a merged range other
    than its first give way. A range without a first cell leaves its cells as they are.
    """
    at = bounds(F.concat(F.lit("x!"), F.col("ref")))
    ranges = merges.select(book, "sheet", at.alias("a")).where("a is not null").select(book, "sheet", "a.r0", "a.c0", "a.r1", "a.c1").distinct()
    plain = cells.select(book, "sheet", "row", "col", "text")
    firsts = ranges.join(plain.withColumnsRenamed({"row": "r0", "col": "c0"}), [book, "sheet", "r0", "c0"])
    rows = firsts.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    filled = rows.groupBy(book, "sheet", "row", "col").agg(F.min("text").alias("text"))
    return plain.join(filled.select(book, "sheet", "row", "col"), [book, "sheet", "row", "col"], "left_anti").unionByName(filled)
