"""Chart candidates from tables of findings.

A table is a list of columns and a list of rows, each a map of texts. Its cells
are looked up and parsed once and written by columns, with what each column is
(numbers, texts, periods and banks in its name); period, bank, composition and
waterfall candidates are taken from them. All of a table lies in one row, as
tables come and as candidates go, so nothing is joined, dealt anew or sent to
the driver, and each step is linear in a table's cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.operators.facts import BASE_SCORES, OTHER_SCORE, intent_boost
from quarrylane.session import written

# Patterns of names and labels, and what a candidate adds to its chart's base score.
PERIOD = r"(?i)\bQ[1-4]\s*(?:FY)?20\d{2}\b|\b20\d{2}\b"
BANK = r"(?i)\b(?:RY|RBC|TD|BMO|BNS|CM|CIBC|NA|NBC)(?:-CA)?\b"
MIX = r"(?i)\b(?:mix|share|composition|percent|percentage|%)\b"
PARTS = r"(?i)\b(?:segment|category|business|division|geography|portfolio|mix|share)\b"
BRIDGE = r"(?i)\b(?:bridge|walk|movement|reconciliation|rollforward|roll-forward|beginning|ending|opening|closing|total|net|change|impact)\b"
TOTAL = r"(?i)\b(?:total|ending|closing|balance)\b"
BONUS = {"trend_line": 10, "multi_series_line": 12, "small_multiple_panel": 12, "peer_rank_bar": 10, "bank_panel": 8, "composition": 14, "waterfall": 16}
#: Series of a panel, and columns of a composition.
SERIES, GROUPS = 6, 4
#: Totals between these are shares of a hundred.
SHARES = (95, 105)

POINT = "struct<group:string,label:string,value:double,is_total:boolean>"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unit_of(values: Column) -> Column:
    """The unit that an array of cells shows: %, bps, $, x or none."""

    def found(low: Column) -> Column:
        out = F.when(low.contains("%") | low.contains("percent"), "%").when(low.contains("bps") | low.contains("basis point"), "bps").when(low.contains("$"), "$")
        return out.when(low.rlike(r"\b\d+(?:\.\d+)?x\b"), "x").otherwise("")

    return _bound(F.lower(F.array_join(values, " ")), found)


def _grid(columns: Column, rows: Column) -> Column:
    """The cells of a table: for each column its ``name`` and ``cells``, which have ``raw`` and ``value`` of each row."""

    def raw(entries: Column, name: Column) -> Column:
        near = F.get(F.filter(F.map_entries(entries), lambda e: F.lower(F.trim(e["key"])) == F.lower(F.trim(name))), F.lit(0))["value"]
        return F.when(F.map_contains_key(entries, name), F.try_element_at(entries, name)).otherwise(near)

    def column(name: Column) -> Column:
        raws = F.transform(rows, lambda e: raw(e, name))
        return F.struct(name.alias("name"), F.transform(raws, lambda r: F.struct(r.alias("raw"), text.parse_number(r).alias("value"))).alias("cells"))

    return F.transform(columns, column)


def cells(tables: DataFrame) -> DataFrame:
    """``table_id``, ``row``, ``col``, ``name``, ``raw``, ``value`` of every cell.

    A cell is looked up by its column's name, or without regard to case and
    outer blanks where no key is equal; one without an entry is null.
    """
    columns = tables.select("table_id", F.posexplode(_grid(F.col("columns"), F.col("rows"))).alias("col", "g"))
    return columns.select("table_id", "col", "g.name", F.posexplode("g.cells").alias("row", "cell")).select("table_id", "row", "col", "name", "cell.raw", "cell.value")


def _profiled(grid: Column, n_rows: Column) -> Column:
    """``label_col`` and ``columns`` of a table, each with ``col``, ``name``, ``cells`` and what it is.

    A column is numeric if two cells, or the only one, hold a number. The label
    is the first column of which at least half the cells that aren't blank hold
    no number, else the first.
    """
    blank = lambda c: F.trim(F.coalesce(c["raw"], F.lit(""))) == ""
    count = lambda found, rule: F.size(F.filter(found, rule))

    def counted(g: Column, col: Column) -> Column:
        numbers, filled, texts = (count(g["cells"], rule) for rule in (lambda c: c["value"].isNotNull(), lambda c: ~blank(c), lambda c: c["value"].isNull() & ~blank(c)))
        return F.struct(col.alias("col"), g["name"].alias("name"), g["cells"].alias("cells"), numbers.alias("numbers"), filled.alias("filled"), texts.alias("texts"))

    def of(columns: Column) -> Column:
        labels = F.filter(columns, lambda c: (c["filled"] > 0) & (c["texts"] >= F.greatest(F.lit(1), F.floor(c["filled"] / 2))))
        return _bound(F.coalesce(F.get(labels, F.lit(0))["col"], F.lit(0)), lambda label: F.struct(label.alias("label_col"), F.transform(columns, lambda c: kinds(c, c["col"] != label)).alias("columns")))

    def kinds(c: Column, other: Column) -> Column:
        numeric = other & (c["numbers"] >= F.greatest(F.lit(1), F.least(F.lit(2), n_rows)))
        named = lambda rule: F.coalesce(c["name"].rlike(rule), F.lit(False))
        return F.struct(c["col"].alias("col"), c["name"].alias("name"), c["cells"].alias("cells"), numeric.alias("numeric"), (other & named(PERIOD)).alias("period"), (numeric & named(BANK)).alias("bank"))

    return _bound(F.transform(grid, counted), of)


def _score(chart: Column, bonus: Column, question: str) -> Column:
    base = F.map_from_arrays(F.array(*map(F.lit, BASE_SCORES)), F.array(*map(F.lit, BASE_SCORES.values())))
    return (F.coalesce(F.try_element_at(base, chart), F.lit(OTHER_SCORE)) + intent_boost(chart, question) + bonus).cast("int")


def candidates(tables: DataFrame, question: str = "") -> DataFrame:
    """``table_id``, ``chart``, ``title``, ``subtitle``, ``unit``, ``score``, ``series``, ``points``: up to four charts of each table.

    ``tables``: ``table_id``, ``title``, ``summary``, ``combo``, ``columns``
    (array of names), ``rows`` (array of maps of texts), ``evidence_ids``. A
    table without evidence gives nothing, nor do null or empty lists of columns
    or rows. Each row of ``tables`` is a table of its own. Series have at least
    two points; panels show the first six.
    """
    blank = F.lit("")
    shown = F.coalesce(F.nullif(F.col("title"), blank), F.nullif(F.col("summary"), blank), F.lit("Source table"))
    combo = F.trim(F.regexp_replace(F.coalesce("combo", blank), r"^[A-Za-z][A-Za-z 0-9&-]*:\s+", ""))
    tables = tables.where(F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0)
    n_rows = F.size("rows")
    profile = _profiled(_grid(F.col("columns"), F.col("rows")), n_rows)
    # What a table is made of, by scans and groupings of the caller, and its cells are computed once for all that follows.
    placed = written(tables.select("table_id", shown.alias("title"), combo.alias("combo"), n_rows.alias("n_rows"), profile.alias("p")).select("table_id", "title", "combo", "n_rows", "p.*")).where("n_rows > 0 and size(columns) > 0")
    head = F.get("columns", F.col("label_col"))
    labels = F.transform(head["cells"], lambda c: F.trim(F.coalesce(c["raw"], F.lit(""))))
    return placed.select("table_id", F.inline(F.filter(_bound(labels, lambda x: _charts(x, head["name"], question)), lambda c: c.isNotNull())))


def _charts(labels: Column, label_name: Column, question: str) -> Column:
    return F.array(_of_series(labels, "period", question), _of_series(labels, "bank", question), _composition(labels, label_name, question), _waterfall(labels, question))


def _shaped(chart: Column, title: Column, subtitle: Column, unit: Column, bonus: Column, question: str, series: Column | None = None, points: Column | None = None) -> Column:
    none_s, none_p = F.array().cast(f"array<struct<name:string,unit:string,points:array<{POINT}>>>"), F.array().cast(f"array<{POINT}>")
    return _bound(
        chart,
        lambda c: F.struct(
            c.alias("chart"), title.alias("title"), subtitle.alias("subtitle"), unit.alias("unit"), _score(c, bonus, question).alias("score"), (none_s if series is None else series).alias("series"), (none_p if points is None else points).alias("points")
        ),
    )


def _point(group: Column, label: Column, value: Column, is_total: Column) -> Column:
    return F.struct(group.cast("string").alias("group"), label.alias("label"), value.alias("value"), is_total.alias("is_total"))


def _points(items: Column) -> Column:
    return F.transform(items, lambda i: i["p"])


def _unit(items: Column) -> Column:
    return unit_of(F.transform(items, lambda i: i["raw"]))


def _of_series(labels: Column, kind: str, question: str) -> Column:
    """Trends over period columns, or rankings and panels over bank columns: each row of a table is a series."""
    order = lambda name: text.period_key(name) if kind == "period" else F.lit(0)
    chosen = F.sort_array(F.transform(F.filter("columns", lambda c: c[kind]), lambda c: F.struct(order(c["name"]).alias("k"), c["col"].alias("col"), c["name"].alias("name"), c["cells"].alias("cells"))))

    def row(columns: Column, label: Column, i: Column) -> Column:
        items = F.transform(columns, lambda c: _bound(F.get(c["cells"], i), lambda x: F.struct(_point(F.lit(None), c["name"], x["value"], F.lit(False)).alias("p"), x["raw"].alias("raw"))))
        return F.struct(i.alias("row"), label.alias("label"), F.filter(items, lambda x: x["p"]["value"].isNotNull()).alias("items"))

    def rows(columns: Column) -> Column:
        found = F.filter(F.transform(labels, lambda label, i: row(columns, label, i)), lambda r: F.size(r["items"]) >= 2)
        return F.transform(found, lambda r: F.struct(r["row"].alias("row"), r["label"].alias("label"), _unit(r["items"]).alias("unit"), _points(r["items"]).alias("points")))

    def chart(columns: Column, found: Column) -> Column:
        return _bound(F.filter(found, lambda r: r["label"] != ""), lambda named: F.when(F.size(named) > 0, shape(columns, found, named)))

    # The first rows are enough to show; the first of all is a ranking's even if it has no name.
    def shape(columns: Column, found: Column, named: Column) -> Column:
        single, first, count = F.size(named) == 1, F.get(named, F.lit(0)), F.size(named).cast("string")
        series = F.transform(F.slice(named, 1, SERIES), lambda r: F.struct(r["label"].alias("name"), r["unit"].alias("unit"), r["points"].alias("points")))
        combo = F.nullif(F.col("combo"), F.lit(""))
        if kind == "period":
            bank = F.when(F.col("combo") == "", "Bank").otherwise(F.regexp_replace("combo", r" \S+ \S+$", ""))
            ends = F.concat(F.get(columns, F.lit(0))["name"], F.lit(" to "), F.element_at(columns, -1)["name"], F.lit(" | table-derived"))
            title = F.when(single, F.concat_ws(" ", bank, first["label"], F.lit("trend"))).otherwise(F.concat_ws(" ", "title", F.lit("trend")))
            subtitle = F.when(single, ends).otherwise(F.concat(count, F.lit(" series from "), F.coalesce(combo, F.lit("source table"))))
            bonus = F.when(single, BONUS["trend_line"]).otherwise(BONUS["multi_series_line"])

            def of_units(many: Column) -> Column:
                name = F.when(single, "trend_line").when(many, "small_multiple_panel").otherwise("multi_series_line")
                return _shaped(name, title, subtitle, F.when(many, "").otherwise(first["unit"]), bonus, question, series=series)

            return _bound(F.exists(named, lambda r: r["unit"] != first["unit"]), of_units)
        top = F.get(F.filter(found, lambda r: r["row"] == 0), F.lit(0))
        nothing = F.array()
        series, points = F.when(single, nothing.cast(f"array<struct<name:string,unit:string,points:array<{POINT}>>>")).otherwise(series), F.when(single, top["points"]).otherwise(nothing.cast(f"array<{POINT}>"))
        title = F.when(single, F.concat_ws(" ", first["label"], F.lit("peer ranking"))).otherwise(F.concat_ws(" ", "title", F.lit("peer metrics")))
        subtitle = F.when(single, F.coalesce(combo, F.col("title"))).otherwise(F.concat(count, F.lit(" metrics with separate scales")))
        bonus = F.when(single, BONUS["peer_rank_bar"]).otherwise(BONUS["bank_panel"])
        found_chart = _shaped(F.when(single, "peer_rank_bar").otherwise("small_multiple_panel"), title, subtitle, F.when(single, top["unit"]).otherwise(""), bonus, question, series, points)
        return F.when(~single | top.isNotNull(), found_chart)

    return _bound(chosen, lambda columns: F.when(F.size(columns) >= 2, _bound(rows(columns), lambda found: chart(columns, found))))


def _composition(labels: Column, label_name: Column, question: str) -> Column:
    """Parts of wholes: the first numeric columns are groups, the rows their categories."""
    words = F.concat_ws(" ", label_name, "title")

    def part(c: Column) -> Column:
        items = F.transform(c["cells"], lambda x, i: F.struct(_point(c["name"], F.get(labels, i), x["value"], F.lit(False)).alias("p"), x["raw"].alias("raw")))
        return F.filter(items, lambda x: (x["p"]["value"] >= 0) & (x["p"]["label"] != ""))

    def shape(groups: Column) -> Column:
        total = lambda items: F.aggregate(items, F.lit(0.0), lambda a, x: a + x["p"]["value"])
        shares = F.forall(groups, lambda g: total(g).between(*SHARES))
        subtitle = F.coalesce(F.nullif(F.col("combo"), F.lit("")), F.concat(F.size(groups).cast("string"), F.lit(" group(s)")))

        def chart(items: Column, unit: Column) -> Column:
            name = F.when((unit == "%") | words.rlike(MIX) | shares, "composition_100_bar").otherwise("composition_stacked_bar")
            return _shaped(name, F.concat_ws(" ", "title", F.lit("composition")), subtitle, unit, F.lit(BONUS["composition"]), question, points=_points(items))

        return _bound(F.flatten(groups), lambda items: F.when(F.size(items) >= 2, _bound(_unit(items), lambda unit: chart(items, unit))))

    groups = F.filter(F.transform(F.slice(F.filter("columns", lambda c: c["numeric"]), 1, GROUPS), part), lambda g: F.size(g) > 0)
    return F.when(words.rlike(PARTS) & (F.col("n_rows") >= 2), _bound(groups, shape))


def _waterfall(labels: Column, question: str) -> Column:
    """Steps from an opening to a closing value: the first numeric column of a table whose title or labels speak of such."""
    spoken = F.col("title").rlike(BRIDGE) | F.exists(labels, lambda x: x.rlike(BRIDGE))

    def step(x: Column, i: Column) -> Column:
        total = lambda label: (i == 0) | (i == F.col("n_rows") - 1) | label.rlike(TOTAL)
        return _bound(F.get(labels, i), lambda label: F.struct(_point(F.lit(None), label, x["value"], total(label)).alias("p"), x["raw"].alias("raw")))

    def shape(column: Column) -> Column:
        items = F.filter(F.transform(column["cells"], step), lambda x: x["p"]["value"].isNotNull() & (x["p"]["label"] != ""))
        subtitle = F.coalesce(F.nullif(F.col("combo"), F.lit("")), column["name"])
        chart = lambda found: _shaped(F.lit("waterfall"), F.concat_ws(" ", "title", F.lit("bridge")), subtitle, _unit(found), F.lit(BONUS["waterfall"]), question, points=_points(found))
        return _bound(items, lambda found: F.when(F.size(found) >= 3, chart(found)))

    return F.when((F.col("n_rows") >= 3) & spoken, _bound(F.get(F.filter("columns", lambda c: c["numeric"]), F.lit(0)), lambda column: F.when(column.isNotNull(), shape(column))))
