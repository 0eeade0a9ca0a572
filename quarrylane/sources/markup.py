"""HTML pages, transcript XML and XLSX workbooks as rows of units and cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

# Parts of a page that hold no content, and tags that end a unit.
DROPPED = r"(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<!--.*?-->|<head>.*?</head>"
BLOCKS = r"(?i)</?(?:p|h[1-6]|div|li|ul|ol|table|tr|article|section|br|body|html|footer|header)\b[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def page_units(html: Column) -> Column:
    """Texts of a page's blocks in order: tags dropped, entities read, white space collapsed, blank ones left out. JVM only."""

    def clean(part):
        part = F.regexp_replace(part, r"<[^>]*>", " ")
        for entity, char in ENTITIES:
            part = F.replace(part, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(part, r"\s+", " "))

    return F.filter(F.transform(F.split(F.regexp_replace(html, DROPPED, " "), BLOCKS, -1), clean), lambda t: t != "")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def transcript_rows(content: bytes) -> Iterator[dict]:
    """Speaker blocks of a transcript XML in document order, with or without a namespace; blank ones are skipped."""
    root = ElementTree.fromstring(content)
    people = {p.get("id"): (p.text or "").strip() for p in root.iter() if _local(p.tag) == "participant"}
    title = next(((e.text or "").strip() for e in root.iter() if _local(e.tag) == "title"), "")
    block = 0
    for n, section in enumerate((e for e in root.iter() if _local(e.tag) == "section"), 1):
        for speaker in (e for e in section.iter() if _local(e.tag) == "speaker"):
            text = "\n".join("".join(p.itertext()).strip() for p in speaker.iter() if _local(p.tag) == "p").strip()
            if not text:
                continue
            block += 1
            yield {"title": title, "section_no": n, "section": section.get("name", ""), "block": block, "speaker": people.get(speaker.get("id"), speaker.get("id") or ""), "kind": speaker.get("type", ""), "text": text}


TRANSCRIPT = pa.schema(
    [("path", pa.string()), ("title", pa.string()), ("section_no", pa.int32()), ("section", pa.string()), ("block", pa.int32()), ("speaker", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("error", pa.string())]
)


def _parsed(files: DataFrame, parse, schema: pa.Schema) -> DataFrame:
    """Rows that ``parse(path, content)`` makes of each file, one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_pylist(list(parse(path.as_py(), content.as_py())), schema=schema)

    return files.select("path", "content").mapInArrow(run, from_arrow_schema(schema))


def transcripts(files: DataFrame) -> DataFrame:
    """Speaker blocks of binary XML files; a file that doesn't parse gives one row with its error."""

    def parse(path: str, content: bytes) -> list[dict]:
        try:
            return [{"path": path, **r} for r in transcript_rows(content)]
        except ElementTree.ParseError as e:
            return [{"path": path, "error": str(e)}]

    return _parsed(files, parse, TRANSCRIPT)


# Fixed value: the number formats of a workbook that are percentages by number.
PERCENT_FORMATS = {9, 10}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_cells(content: bytes, max_sheets: int | None = None) -> Iterator[dict]:
    """Cells of a workbook's visible sheets: sheet name, row, column, value as text, whether its format is a percentage, its formula."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        percent: list[bool] = []
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            cells = styles.find(f"{_MAIN}cellXfs")
            ids = [int(x.get("numFmtId", "0")) for x in (cells if cells is not None else [])]
            percent = [i in PERCENT_FORMATS or "%" in own.get(i, "") for i in ids]
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        shown = [s for s in read("xl/workbook.xml").iter(f"{_MAIN}sheet") if s.get("state", "visible") == "visible"]
        for sheet in shown[:max_sheets]:
            target = targets[sheet.get(_REL)].lstrip("/")
            for c in read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_MAIN}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                kind, v, f = c.get("t", "n"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    value = None
                else:
                    value = strings[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text
                style = int(c.get("s", "0"))
                yield {
                    "sheet": sheet.get("name"), "row": int(row), "col": column, "value": value, "numeric": kind == "n" and value is not None,
                    "percent": style < len(percent) and percent[style], "formula": None if f is None else f.text,
                }


CELLS = pa.schema(
    [("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("numeric", pa.bool_()), ("percent", pa.bool_()), ("formula", pa.string())]
)


def workbooks(files: DataFrame, max_sheets: int | None = None) -> DataFrame:
    """Cells of binary XLSX files."""
    return _parsed(files, lambda path, content: ({"path": path, **c} for c in workbook_cells(content, max_sheets)), CELLS)


def cell_text(value: Column, numeric: Column, percent: Column) -> Column:
    """Shown text of a cell: percentages times 100, numbers half up to two places without trailing zeros, line ends as spaces."""
    number = F.round(F.when(percent, value.try_cast("decimal(38,12)") * 100).otherwise(value.try_cast("decimal(38,12)")), 2)
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    shown = F.when(numeric & number.isNotNull(), F.concat(plain, F.when(percent, "%").otherwise(""))).otherwise(value)
    return F.regexp_replace(F.coalesce(F.replace(shown, F.lit("_x000D_"), F.lit("\n")), F.lit("")), r"\s*\n\s*", " ")


def column_letters(n: Column) -> Column:
    """A for 1, Z for 26, AA for 27; up to three letters."""
    letter = lambda x: F.char(F.lit(64) + x)
    last = (n - 1) % 26 + 1
    rest = F.floor((n - last) / 26)
    mid = (rest - 1) % 26 + 1
    top = F.floor((rest - mid) / 26)
    return F.concat(F.when((rest > 0) & (top > 0), letter(top)).otherwise(""), F.when(rest > 0, letter(mid)).otherwise(""), letter(last))


def used_range(cells: DataFrame, by: list[str]) -> DataFrame:
    """Range of the cells that show something, such as ``A1:C5``, and its numbers of rows and columns, per sheet."""
    shown = cells.where(F.coalesce("text", F.lit("")) != "")
    ends = shown.groupBy(*by).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    at = lambda c, r: F.concat(column_letters(F.col(c)), F.col(r).cast("string"))
    return ends.select(*by, F.concat(at("c0", "r0"), F.lit(":"), at("c1", "r1")).alias("used_range"), (F.col("r1") - F.col("r0") + 1).alias("n_rows"), (F.col("c1") - F.col("c0") + 1).alias("n_cols"))


def workbook_layout(content: bytes) -> Iterator[dict]:
    """What a workbook's sheets say of their layout: state, merged ranges, hidden rows and columns (first to last)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in read("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = read(target if target.startswith("xl/") else f"xl/{target}")
            yield {
                "sheet": sheet.get("name"),
                "state": sheet.get("state", "visible"),
                "merged": [m.get("ref") for m in root.iter(f"{_MAIN}mergeCell")],
                "hidden_rows": [int(r.get("r")) for r in root.iter(f"{_MAIN}row") if r.get("hidden") in ("1", "true")],
                "hidden_cols": [f"{c.get('min')}-{c.get('max')}" for c in root.iter(f"{_MAIN}col") if c.get("hidden") in ("1", "true")],
            }


LAYOUT = pa.schema(
    [("path", pa.string()), ("sheet", pa.string()), ("state", pa.string()), ("merged", pa.list_(pa.string())), ("hidden_rows", pa.list_(pa.int32())), ("hidden_cols", pa.list_(pa.string()))]
)


def layouts(files: DataFrame) -> DataFrame:
    """One row per sheet of binary XLSX files, hidden sheets included."""
    return _parsed(files, lambda path, content: ({"path": path, **s} for s in workbook_layout(content)), LAYOUT)


def sheet_markdown(cells: DataFrame, by: list[str]) -> DataFrame:
    """One markdown table per sheet: used columns as letters, row numbers first, pipes escaped.

    Each row is assembled first, so what is gathered per sheet is one text a row.
    """
    width = cells.groupBy(*by).agg(F.min("col").alias("__first"), F.max("col").alias("__last"))
    value = F.replace(F.col("text"), F.lit("|"), F.lit("\\|"))
    rows = cells.groupBy(*by, "row").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("col", value.alias("v"))))).alias("__m")).join(width, by)
    columns = F.sequence("__first", "__last")
    line = F.concat(F.lit("| "), F.col("row").cast("string"), F.lit(" | "), F.array_join(F.transform(columns, lambda c: F.coalesce(F.try_element_at("__m", c), F.lit(""))), " | "), F.lit(" |"))
    head = F.concat(F.lit("| Row | "), F.array_join(F.transform(columns, column_letters), " | "), F.lit(" |"), F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size(columns) + 1))
    lined = rows.select(*by, head.alias("head"), F.struct("row", line.alias("l")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n")
    return lined.groupBy(*by, "head").agg(body.alias("body")).select(*by, F.concat("head", F.lit("\n"), "body").alias("markdown"))
