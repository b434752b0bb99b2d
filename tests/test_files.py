"""Workbooks, loaders and application patterns."""

import io
import zipfile

import pytest

from pyspark.sql import functions as F

from tessera.operators import flow
from tessera.plans.layout import Layout
from tessera.sources import files, loaders
from tessera.streaming.records import stream_records

TEXT = 'a,b,a,c\n1,"x ""q"", y",2,\n"3\n4",,5,#N/A\n'


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return f"file://{path}"


def test_csv_heading(spark, tmp_path):
    df = files.read_any(spark, put(tmp_path, "t.csv", TEXT))
    assert df.columns == ["a", "b", "c"]
    assert [tuple(r) for r in df.collect()] == [("2", 'x "q", y', ""), ("5", "", "#N/A")]
    with pytest.raises(ValueError):
        files.read_csv(spark, put(tmp_path, "empty.csv", ""))
    with pytest.raises(NotImplementedError):
        files.read_any(spark, "t.unknown")


def test_csv_with_schema(spark, tmp_path):
    schema = {"type": "object", "properties": {"x": {"type": "number", "position": 1}, "y": {"type": "integer", "position": 0}}}
    path = put(tmp_path, "s.csv", "y,x\n1,10.5\n")
    assert [tuple(r) for r in files.read_csv(spark, path, schema).collect()] == [("x", "y"), ("10.5", "1")]
    assert [tuple(r) for r in files.read_csv(spark, path, schema, header=True, converted=True).collect()] == [(10.5, 1)]


def test_tab_and_json(spark, tmp_path):
    assert files.read_any(spark, put(tmp_path, "t.tab", "a\tb\n1\t2\n")).first().b == "2"
    assert files.read_any(spark, put(tmp_path, "t.ndjson", '{"a": 1.5, "b": [1]}\n'), schema="a double, b array<int>").first().b == [1]
    with pytest.raises(Exception):
        files.read_ndjson(spark, put(tmp_path, "bad.json", "{nope\n"), "a int").collect()


def test_external_metadata(spark, tmp_path):
    meta = spark.createDataFrame([("n", "", "integer"), ("s", "", "string")], "name string, description string, dataType string")
    schema = loaders.schema_from_metadata(meta)
    df = files.read_csv(spark, put(tmp_path, "m.csv", " 7,q\n"), schema, header=False, converted=True)
    assert tuple(df.first()) == (7, "q") and loaders.expects(df, schema)


def test_fixed_text(spark, tmp_path):
    schema = loaders.schema_from_copybook("01 R. 05 A PIC X(3). 05 B PIC 999V99. 05 FILLER PIC X. 05 C PIC S999.99. ", free=True)
    df = files.read_fixed_text(spark, put(tmp_path, "t.txt", "ASC12345  -12.50\n"), schema, paths=["A", "B", "C"])
    assert [str(x) for x in df.first()][0] == "ASC" and float(df.first()[1]) == 12345


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{r}"><sheets><sheet name="Sheet1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>int</t></si><si><r><t>te</t></r><r><t>xt</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{c}</t></is></c>' for c in "ABCDEF")
        row = '<c r="A2"><v>42</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" s="1"><v>20708</v></c><c r="D2" t="b"><v>1</v></c><c r="F2"><f>2/0</f><v>0</v></c>'
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData><row>{head}</row><row>{row}</row></sheetData></worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    path = put(tmp_path, "t.xlsx", xlsx())
    assert files.list_sheets(spark, path) == ["Sheet1"]
    assert tuple(files.read_any(spark, path, sheet="Sheet1").first()) == ("42", "text", "1956-09-10 00:00:00", "true", None, "=2/0")


def test_ods(spark, tmp_path):
    ns = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"' for p in ("office", "table", "text"))
    cell = lambda v: f'<table:table-cell office:value-type="string"><text:p>{v}</text:p></table:table-cell>'
    row = '<table:table-cell office:value-type="float" office:value="42"/><table:table-cell office:value-type="date" office:date-value="1956-09-10"/>'
    body = f'<table:table table:name="Sheet1"><table:table-row>{cell("a")}{cell("b")}</table:table-row><table:table-row>{row}</table:table-row></table:table>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f"<office:document-content {ns}>{body}</office:document-content>")
    assert tuple(files.read_any(spark, put(tmp_path, "t.ods", out.getvalue())).first()) == ("42", "1956-09-10")


def test_flow(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, 50.0)], "id int, kind string, v double")
    rules = {"required": ["kind"], "properties": {"kind": {}, "v": {"maximum": 10}}}
    cases = [("A", F.col("kind") == "a"), ("big", F.col("v") > 4)]
    assert [r.tag for r in flow.switch_case(df, cases).orderBy("id").collect()] == ["A", "rejected", "big"]
    assert sorted((r.id, r.tag) for r in flow.switch_overlap(df, cases).collect()) == [(1, "A"), (1, "big"), (2, "rejected"), (3, "big")]
    checked = flow.validated(df, rules)
    assert [len(r.errors) for r in checked.orderBy("id").collect()] == [0, 0, 2]
    assert {r.error: r.n for r in flow.error_counts(checked).collect()} == {"'kind' is a required property": 1, "'v' breaks maximum 10": 1}
    with pytest.raises(Exception, match="invalid row"):
        flow.validated(df, rules, fail_fast=True).collect()
    written = []
    assert tuple(flow.process(df, rules, lambda d: written.append(d.count())).first()) == (3, 2, 1) and written == [2]
    assert tuple(flow.process(df, rules, None).first()) == (3, 2, 1)
    assert "kind" in flow.profile_report(flow.profile(df, ["kind"]))


def test_stream(spark, tmp_path):
    layout = Layout(loaders.schema_from_copybook("01 R. 05 A PIC X(2). 05 B PIC 99. ", free=True))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.dat").write_bytes("ab12cd34".encode("cp037"))
    query = stream_records(spark, f"file://{tmp_path}/in", layout).writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.A for r in spark.table("decoded").collect()) == ["ab", "cd"]


def test_delimited_files_of_many_lines(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in (2, 1):
        (folder / f"{k}.csv").write_text("junk\nmore junk\nk,v\n" + "".join(f'{i},"a ""{i}"""\n' for i in range(k, 60, 2)))
    got = files.read_csv(spark, f"file://{folder}", skip=2)
    assert got.columns == ["k", "v"] and sorted(int(r.k) for r in got.collect()) == list(range(1, 60)) and got.where("k = '7'").first().v == 'a "7"'
    schema = {"type": "object", "properties": {"v": {"type": "string", "position": 1}}}
    assert files.read_csv(spark, f"file://{folder}", schema, skip=3).count() == 59
    assert not files.has_open_quotes(spark, f"file://{folder}") and files.has_open_quotes(spark, put(tmp_path, "open.csv", TEXT))
    path = put(tmp_path, "s.ndjson", '# a head\n{"a": 1}\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_ndjson(spark, path, "a int", skip=1).collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.read_ndjson(spark, path, skip=1)
    fixed = {"type": "object", "properties": {"A": {"type": "string", "maxLength": 2}}}
    assert [r.A for r in files.read_fixed_text(spark, put(tmp_path, "f.txt", "head\nab\ncd\n"), fixed, skip=1).collect()] == ["ab", "cd"]


def ods(body):
    ns = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"' for p in ("office", "table", "text"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<office:document-content {ns}><table:table table:name="S">{body}</table:table></office:document-content>')
    return out.getvalue()


def test_cells_stay_in_their_columns():
    text = lambda v: f'<table:table-cell office:value-type="string"><text:p>{v}</text:p></table:table-cell>'
    row = lambda cells, n=1: f'<table:table-row table:number-rows-repeated="{n}">{cells}</table:table-row>'
    wide = text("a") + '<table:table-cell table:number-columns-repeated="150"/>' + text("b") + '<table:table-cell table:number-columns-repeated="16000"/>'
    merged = text("a") + '<table:covered-table-cell table:number-columns-repeated="2"/>' + text("d")
    ((_, rows),) = files.ods_sheets(ods(row(wide) + row("<table:table-cell/>", 2) + row(merged, 2) + row("<table:table-cell/>", 10**6)))
    assert [[v for _, v in r] for r in rows] == [["a", *[None] * 150, "b"], [], [], *[["a", None, None, "d"]] * 2]


def test_row_gaps_and_other_headings(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx())) as old, zipfile.ZipFile(raw, "w") as new:
        for n in old.namelist():
            text = old.read(n).decode()
            new.writestr(n, text.replace('<row><c r="A2">', '<row r="5"><c r="A2">'))
    ((_, rows),) = files.xlsx_sheets(raw.getvalue())
    assert len(rows) == 5 and rows[1:4] == [[]] * 3 and rows[4][0] == ("n", "42")
    cell = '<table:table-cell office:value-type="string"><text:p>%s</text:p></table:table-cell>'
    (tmp_path / "two.ods").mkdir()
    for n, head in (("1.ods", "a"), ("2.ods", "b")):
        (tmp_path / "two.ods" / n).write_bytes(ods(f"<table:table-row>{cell % head}</table:table-row><table:table-row>{cell % 'x'}</table:table-row>"))
    with pytest.raises(Exception, match="another heading"):
        files.read_ods(spark, f"file://{tmp_path}/two.ods").collect()


def test_formats_whose_libraries_are_absent(monkeypatch):
    import sys
    from datetime import datetime
    from types import SimpleNamespace as New

    cells = [New(ctype=c, value=v) for c, v in ((1, "t"), (2, 42.0), (2, 0.5), (3, 20708.0), (4, 1), (5, 7), (0, ""), (6, ""))]
    sheet = New(name="S", nrows=1, row=lambda i: cells)
    book = New(datemode=0, sheets=lambda: [sheet])
    monkeypatch.setitem(
        sys.modules, "xlrd",
        New(open_workbook=lambda file_contents: book, xldate_as_datetime=lambda v, m: datetime(1956, 9, 10), error_text_from_code={7: "#DIV/0!"}),
    )
    want = [("s", "t"), ("n", "42"), ("n", "0.5"), ("d", "1956-09-10 00:00:00"), ("b", "true"), ("e", "#DIV/0!"), ("", None), ("", None)]
    assert list(files.xls_sheets(b"")) == [("S", [want])]
    table = New(name="T", rows=lambda values_only: [[1.0, "x", None, True, datetime(2020, 1, 2), 0.25]])
    monkeypatch.setitem(sys.modules, "numbers_parser", New(Document=lambda path: New(sheets=[New(name="S", tables=[table])])))
    want = [("n", "1"), ("s", "x"), ("", None), ("b", "true"), ("d", "2020-01-02 00:00:00"), ("n", "0.25")]
    assert list(files.numbers_sheets(b"")) == [("S::T", [want])]
    for suffix in (".xls", ".numbers"):
        with pytest.raises(NotImplementedError):
            files.read_any(None, "a" + suffix)


def test_schemas_check_types_and_nested_values(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a", ("x", 5), [1, 2], "2024"), (2, 2.5, "b", (None, 50), [1, 1, 99], None), (3, None, "abc", None, None, "x")],
        "id int, n double, s string, o struct<k:string,v:int>, xs array<int>, extra string",
    )
    rules = {
        "properties": {
            "id": {"type": "integer"}, "n": {"type": ["integer", "null"], "multipleOf": 2}, "s": {"anyOf": [{"const": "a"}, {"minLength": 3}], "not": {"const": "abc"}},
            "o": {"type": "object", "required": ["k"], "properties": {"v": {"maximum": 10}}}, "xs": {"items": {"maximum": 10}, "uniqueItems": True, "maxItems": 2},
        },
        "additionalProperties": False,
    }
    got = {r.id: set(r.errors) for r in flow.validated(df, rules).collect()}
    assert got[1] == {"'extra' is not expected"}
    assert got[2] == {
        "'n' breaks type ['integer', 'null']", "'n' breaks multipleOf 2", "'s' breaks anyOf", "'o.k' is a required property", "'o.v' breaks maximum 10",
        "'xs[]' breaks maximum 10", "'xs' breaks uniqueItems True", "'xs' breaks maxItems 2",
    }
    assert got[3] == {"'s' breaks not", "'extra' is not expected"}
    whole = {"oneOf": [{"required": ["n"]}, {"properties": {"id": {"minimum": 3}}}], "allOf": [{"properties": {"s": {"type": "number"}}}], "required": ["gone"]}
    got = {r.id: set(r.errors) for r in flow.validated(df, whole).collect()}
    other = {"'s' breaks type number", "'gone' is a required property"}
    assert got == {1: other, 2: other, 3: other}
    assert [r.v for r in df.select(flow.is_valid({"type": "object", "properties": {"s": {"type": "integer"}}}).alias("v")).collect()] == [True] * 3


def test_cleansing_builder(spark):
    df = spark.createDataFrame([("1020", "y"), ("123456789", "y"), ("12345-678", "y"), ("1", None)], "zip string, flag string")
    got = flow.cleansed(df, F.col("flag") == "y", zip=flow.zip_code(F.col("zip"))).collect()
    assert [r.zip for r in got] == ["01020", "123456789", "012345678"]


def test_cleansing_builder_of_keys_of_many_digits(spark, tmp_path):
    import duckdb

    from tessera import queries

    keys = [1, 3, 99_999, 100_000, 100_001, 100_002, 899_999, 900_000, 1_234_567, 123_456_789_012]
    spark.createDataFrame([(k, k % 2) for k in keys] + [(None, 1), (100_004, None)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["cleansing_builder"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        want = db.execute(queries.ORACLE_SQL["cleansing_builder"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == 7
    assert (100_001, "00001") in want and (899_999, "99999") in want


def test_files_of_two_layouts(spark, tmp_path):
    from tessera.sources.framing import read_records, write_records

    head, body = (Layout(s) for s in loaders.schemas_from_copybook("01 H. 05 N PIC 9(2). 05 W PIC X(4). 01 D. 05 K PIC X(3). 05 V PIC 9(3). ", free=True))
    for name in "ab":
        (tmp_path / name).write_bytes(("02" + name * 4 + "xyz001" + "uvw002").encode("cp037"))
    records = read_records(spark, f"file://{tmp_path}/[ab]", "F", 6)
    first, rest = flow.rebound(records, head, body)
    assert sorted(r.W for r in first.collect()) == ["aaaa", "bbbb"] and sorted((r.K, int(r.V)) for r in rest.collect()) == [("uvw", 2)] * 2 + [("xyz", 1)] * 2
    assert head == Layout(loaders.schemas_from_copybook("01 H. 05 N PIC 9(2). 05 W PIC X(4). ", free=True)[0]) and head != body
    out = f"file://{tmp_path}/out"
    write_records(records.repartition(3), "record", out)
    assert sorted(bytes(r.record) for r in read_records(spark, out, "F", 6).collect()) == sorted(bytes(r.record) for r in records.collect())
    with pytest.raises(FileExistsError):
        write_records(records, "record", out)
    write_records(records.limit(1), "record", out, mode="append")
    assert read_records(spark, out, "F", 6).count() == 7
    write_records(records.limit(2), "record", out, mode="overwrite")
    assert read_records(spark, out, "F", 6).count() == 2
