import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.sources import files, markup


def test_folder_scan(spark, tmp_path):
    for p in ("2024_Q1/RY/a.pdf", "2024_Q1/TD/b.pdf", "2024_Q1/TD/c.pdf", "stray.txt", "2024_Q1/RY/~$a.pdf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    got = {r.filename: r for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.pdf", "b.pdf", "c.pdf", "stray.txt"}
    assert (got["a.pdf"].year, got["a.pdf"].quarter, got["a.pdf"].bank, got["a.pdf"].error) == (2024, "Q1", "RY", None)
    assert got["stray.txt"].error
    problems = files.one_file_per_bank(files.scan_folder(spark, str(tmp_path)), "pdf").collect()
    assert [(p.bank, p.problem) for p in problems] == [("TD", "more than one file")]


def test_strict_csv(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType())])
    path = tmp_path / "x.csv"
    path.write_text('id,text\n1,"a ""b""\nc"\nbad,row\n2,plain\n')
    rows, errors = files.strict_csv(spark, str(path), schema)
    assert sorted(tuple(r) for r in rows.cache().collect()) == [(1, 'a "b"\nc'), (2, "plain")]
    assert errors.count() == 1
    path.write_text("id,other\n1,2\n")
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(path), schema)


def test_manifest_and_json_lines(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"files": [{"file_id": "a", "source_type": "s", "source_filename": "n", "file_hash": "h"}]}))
    assert tuple(files.manifest(spark, str(path)).first())[:4] == ("a", "s", "h", "n")
    path.write_text(json.dumps([{"file_id": "a", "source": "s"}, {"file_id": "a", "source": "t"}]))
    with pytest.raises(ValueError):
        files.manifest(spark, str(path))
    path.write_text("")
    assert files.manifest(spark, str(path)).count() == 0
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": oops\n{"a": 2}\n')
    rows, errors = files.json_lines(spark, str(lines), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and errors.first().record == '{"a": oops'


def test_csv_sink_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5], True, "x\0y"), (2, [], False, None)], "id int, v array<double>, ok boolean, t string")
    files.write_csv(df, str(tmp_path / "out"), ["id"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "out")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", "[0.5]", "true", "xy"), ("2", None, "false", None)]
    name = "snapshot_test"
    assert files.refresh_snapshot(df, name) == 2
    assert files.refresh_snapshot(df.limit(1), name, apply=False) == 1 and spark.table(name).count() == 2
    assert files.refresh_snapshot(df.limit(1), name) == 1 and spark.table(name).count() == 1
    with pytest.raises(ValueError):
        files.refresh_snapshot(df.limit(0), name)
    assert spark.table(name).count() == 1
    assert files.create_tables(spark, {name: df.schema, "made_test": df.schema}) == ["made_test"]


XML = """<t xmlns="urn:x"><meta><title>Q1 2024 Earnings Call</title><participants><participant id="1">Ann Lee</participant></participants></meta>
<body><section name="Q&amp;A"><speaker id="1" type="a"><plist><p>One <b>two</b></p><p>three</p></plist></speaker><speaker id="2" type="q"><plist><p> </p></plist></speaker>
<speaker id="2" type="q"><plist><p>Why?</p></plist></speaker></section></body></t>"""


def test_transcripts(spark):
    table = spark.createDataFrame([("a.xml", XML.encode()), ("b.xml", b"<oops>")], "path string, content binary")
    got = markup.transcripts(table).orderBy("path", "block").collect()
    assert [(r.block, r.speaker, r.kind, r.text) for r in got if r.path == "a.xml"] == [(1, "Ann Lee", "a", "One two\nthree"), (2, "2", "q", "Why?")]
    assert got[0].title == "Q1 2024 Earnings Call" and got[-1].error


def workbook():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Main" r:id="a"/><sheet name="Gone" state="hidden" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Na|me</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" s="1"><f>1/8</f><v>0.1234</v></c></row><row r="3"><c r="B3"><v>2.345</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"/>')
    return out.getvalue()


def test_workbooks(spark):
    cells = markup.workbooks(spark.createDataFrame([("w.xlsx", workbook())], "path string, content binary")).withColumn("text", markup.cell_text(F.col("value"), F.col("numeric"), F.col("percent")))
    assert {(r.sheet, r.row, r.col): r.text for r in cells.collect()} == {("Main", 1, 1): "Na|me", ("Main", 1, 28): "12.34%", ("Main", 3, 2): "2.35", ("Main", 3, 3): "TRUE"}
    lines = markup.sheet_markdown(cells, ["path", "sheet"]).first().markdown.split("\n")
    assert lines[0].startswith("| Row | A | B |") and lines[0].endswith("| Z | AA | AB |")
    assert lines[2].startswith("| 1 | Na\\|me |") and lines[2].endswith("| 12.34% |") and len(lines) == 4


def test_page_units(spark):
    html = "<head><title>T &amp; x</title></head><nav>menu</nav><p>One <b>two</b><p>a &lt; b<!-- no --><script>p</script><div> </div><li>last</li>"
    r = spark.createDataFrame([(html,)], "h string").select(markup.page_title(F.col("h")), markup.page_units(F.col("h"))).first()
    assert r[1] == ["One two", "a < b", "last"]


def test_master_files_come_both_or_neither(spark, tmp_path):
    root = str(tmp_path)
    assert files.master_files(spark, root) is False
    (tmp_path / files.MASTER_DATA).write_text("id,text\n1,a\n")
    with pytest.raises(ValueError):
        files.master_files(spark, root)
    (tmp_path / files.MASTER_MANIFEST).write_text("[]")
    assert files.master_files(spark, root) is True


def test_a_blank_master_is_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType())])
    path = tmp_path / "master.csv"
    assert files.previous_master(spark, str(path), schema).collect() == []
    path.write_text(" \n \n")
    assert files.previous_master(spark, str(path), schema).collect() == []
    path.write_text("id,text\n1,a\n")
    assert [tuple(r) for r in files.previous_master(spark, str(path), schema).collect()] == [(1, "a")]


def test_every_file_has_the_header(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType())])
    (tmp_path / "a.csv").write_text("id,text\n1,a\n")
    (tmp_path / "b.csv").write_text("id,text\r\n2,b\r\n")
    assert files.strict_csv(spark, str(tmp_path), schema)[0].count() == 2
    (tmp_path / "c.csv").write_text("id,other\n3,c\n")
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(tmp_path), schema)


def test_layout_of_a_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="H" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><cols><col min="2" max="3" hidden="1"/></cols><sheetData><row r="1"/><row r="4" hidden="1"/></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    content = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.sheet: (r.state, r.merged, r.hidden_rows, r.hidden_cols) for r in markup.layouts(content).collect()}
    assert got == {"S": ("visible", ["A1:B2"], [4], ["2-3"]), "H": ("hidden", [], [], [])}


def test_snapshots_swap_together_or_not_at_all(spark):
    a, b = "snap_together_a", "snap_together_b"
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    read = lambda t: sorted(r.id for r in spark.table(t).collect())
    assert files.refresh_snapshots({a: rows(1, 2), b: rows(3)}) == {a: 2, b: 1}
    with pytest.raises(ValueError):
        files.refresh_snapshots({a: rows(9), b: rows(9).where("id < 0")})
    assert (read(a), read(b)) == ([1, 2], [3])
    with pytest.raises(Exception):
        files.refresh_snapshots({a: rows(9), "no_such_database.t": rows(9)})
    assert read(a) == [1, 2]
    assert files.refresh_snapshots({a: rows(4), b: rows(5, 6)}) == {a: 1, b: 2}
    assert (read(a), read(b)) == ([4], [5, 6])


def test_tables_are_made_together(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType())])
    assert files.create_tables(spark, {"made_one": schema, "made_two": schema}) == ["made_one", "made_two"]
    with pytest.raises(Exception):
        files.create_tables(spark, {"made_three": schema, "made_four": schema}, storage="no_such_format")
    with pytest.raises(Exception):
        files.create_tables(spark, {"made_three": schema, "made.bad": T.StructType([T.StructField("x", T.VoidType())])}, storage="no_such_format")
    assert not spark.catalog.tableExists("made_three") and spark.catalog.tableExists("made_one")
