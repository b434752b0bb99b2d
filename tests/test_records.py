"""Pictures, copybooks, layouts, codecs and framing against byte-level vectors."""

from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from tessera.functions import picture, scalars
from tessera.operators.synth import assemble
from tessera.plans.copybook import clauses, json_schema, parse_copybook, reference_format
from tessera.plans.layout import Layout, compile_schema
from tessera.sources import framing
from tessera.sources.loaders import schema_from_copybook


def ebcdic(text):
    return text.encode("cp037")


def lay(copybook, **how):
    return Layout(schema_from_copybook(copybook, strict=how.get("strict", False), free=True), **how)


def read(spark, copybook, raw, *paths, **how):
    layout = lay(copybook, **how)
    df = spark.createDataFrame([(bytearray(raw),)], "record binary")
    return list(df.select(*[layout.col(p).alias(str(i)) for i, p in enumerate(paths)]).first())


@pytest.mark.parametrize(
    ("source", "size", "strict"),
    [
        ("PIC S9(5).99", 9, 9), ("PIC X(7)", 7, 7), ("PIC ZZ", 2, 2), ("PIC 9(5)V99", 7, 7), ("PIC S9(5)V99", 8, 7),
        ("PIC DB9(5).99", 10, 10), ("PIC SV9(05)", 6, 5), ("PIC $***9.99", 8, 8), ("PIC 999-99-9999", 11, 11),
        ("PIC $**,***,**9.99", 14, 14), ("COMP PIC 999", 2, 2), ("USAGE COMP PIC 9999", 2, 2), ("BINARY PIC 99999", 4, 4),
        ("COMP-1", 4, 4), ("COMP-2", 8, 8), ("COMP-3 PIC S9(7)V99", 5, 5), ("COMP-3 PIC 9999999", 4, 4),
        ("COMP PIC S9(4)", 4, 2), ("PACKED-DECIMAL PIC 9(6)", 3, 4), ("PIC s9(2)v9(3)", 6, 5),
    ],
)
def test_sizes(source, size, strict):
    assert picture.calcsize(source) == size and picture.calcsize(source, True) == strict


def test_picture_parts():
    f = picture.parse("PIC S9(5).99")
    assert f.groups == ("S", "99999", ".", "99") and f.pattern == r"[ +-]?\d\d\d\d\d\.\d\d"
    assert picture.parse("PIC SV9(5)").groups == ("S", "", "V", "99999")
    assert picture.parse("PIC $***9.99").groups == ("", "9999", ".", "99")
    with pytest.raises(ValueError, match="NOPE"):
        picture.parse("PIC S9(5)V99NOPE")
    with pytest.raises(ValueError):
        picture.parse("COMP-3")


@pytest.mark.parametrize(
    ("clause", "raw", "value"),
    [
        ("PIC S9(5)V99", ebcdic(" 1234567"), Decimal("12345.67")),
        ("PIC 999V99", bytes.fromhex("F1F2F3F4F5"), Decimal("123.45")),
        ("PIC 999.99", bytes.fromhex("F1F2F34BF4F5"), "123.45"),
        ("PIC 9", b"\xc4", Decimal(4)), ("PIC 9", b"\xd4", Decimal(-4)),
        ("PIC S9(7)V99 COMP-3", bytes.fromhex("123456799C"), Decimal("1234567.99")),
        ("PIC SV9(5) COMP-3", bytes.fromhex("12345C"), Decimal("0.12345")),
        ("PIC SV9(5) COMP-3", bytes.fromhex("98765D"), Decimal("-0.98765")),
        ("PIC S99 COMP", bytes.fromhex("1234"), 4660),
        ("PIC S9(11) COMP", bytes.fromhex("123456789ABCDEF0"), 0x123456789ABCDEF0),
        ("PIC 999.99", bytes.fromhex("F1D6F34BF4D6"), None),
        ("PIC 999V99", bytes.fromhex("F6F7F8D6F0"), Decimal("678.60")),
        ("PIC S9(8) COMP", bytes.fromhex("000012D6"), 4822),
        ("PIC S99V99 COMP-3", bytes.fromhex("000000"), Decimal(0)),
    ],
)
def test_codecs(spark, clause, raw, value):
    assert read(spark, f"01 R. 05 A {clause}. ", raw, "A") == [value]


def test_bad_text_can_raise(spark):
    with pytest.raises(Exception, match="doesn't match"):
        read(spark, "01 R. 05 A PIC 999.99. ", bytes.fromhex("F1D6F34BF4D6"), "A", on_error="raise")


def test_strict_binary_scales_and_separate_sign(spark):
    assert read(spark, "01 R. 05 A PIC S99V99 COMP. ", bytes.fromhex("FB2E"), "A", strict=True) == [Decimal("-12.34")]
    assert read(spark, "01 R. 05 A PIC S99V9 SIGN LEADING SEPARATE. 05 B PIC X. ", ebcdic("-123Q"), "A", "B", strict=True) == [Decimal("-12.3"), "Q"]


RECORD = "01 R. 05 W PIC XXX. 05 A PIC 999.99. 05 B PIC 999V99. 05 C PIC S9(8) COMP. 05 D PIC S999V99 COMP-3. "


def test_flat_record(spark):
    raw = bytes.fromhex("E9D6E2F1F2F34BF4F5F6F7F8F9F00000123498765D")
    assert lay(RECORD).size == 21 or lay(RECORD).find("D").at == 18
    assert read(spark, RECORD, raw, "W", "A", "B", "C", "D") == ["ZOS", "123.45", Decimal("678.90"), 4660, Decimal("-987.65")]


def test_arrays(spark):
    got = read(spark, "01 R. 05 FILLER PIC X(5). 05 REPEAT PIC XXX OCCURS 4 TIMES. ", ebcdic("12345ABCDEFGHIJKL"), "REPEAT", "REPEAT[3].REPEAT")
    assert [x[0] for x in got[0]] == ["ABC", "DEF", "GHI", "JKL"] and got[1] == "JKL"
    nested = "01 R. 05 FILLER PIC X(5). 05 REP OCCURS 5. 10 ITEM PIC XX OCCURS 4. "
    raw = ebcdic("12345ABCDEFGHabcdefghIJKLMNOPijklmnopQRSTUVWZ")
    assert read(spark, nested, raw, "REP[1].ITEM[0].ITEM", "REP[1].ITEM[1].ITEM", "REP[2].ITEM[0].ITEM", "REP[2].ITEM[1].ITEM") == ["ab", "cd", "IJ", "KL"]
    with pytest.raises(IndexError):
        lay(nested).find("REP[5]")
    with pytest.raises(KeyError):
        lay(nested).find("NOPE")
    with pytest.raises(TypeError):
        lay(nested).find("REP.ITEM")


def test_redefines(spark):
    raw = ebcdic("AB12345678")
    a, b, c = read(spark, "01 R. 05 A PIC X(6). 05 B REDEFINES A. 10 B-1 PIC XX. 10 B-2 PIC 9(4). 05 C PIC 99V99. ", raw, "A", "B", "C")
    assert (a, tuple(b), c) == ("AB1234", ("AB", Decimal(1234)), Decimal("56.78"))
    text = (
        "01 R. 05 REGULAR. 10 LOCATION PIC A(8). 10 GRADE PIC X(4). 10 PAY PIC 9999V99. 10 WPAY REDEFINES PAY PIC 999V999. "
        "05 TEMP REDEFINES REGULAR. 10 LOC2 PIC A(8). 10 FILLER PIC X(6). 10 HPAY PIC 99V99. "
    )
    raw = ebcdic("123456ABCDEFGHijkl")
    assert read(spark, text, raw, "REGULAR.PAY", "REGULAR.LOCATION") == [Decimal("1234.56"), "ABCDEFGH"]
    raw = ebcdic("ABCDEFGHijkl123456")
    assert read(spark, text, raw, "REGULAR.PAY", "REGULAR.LOCATION", "TEMP.HPAY", strict=True) == [Decimal("1234.56"), "ABCDEFGH", Decimal("34.56")]


ODO = "01 R. 05 F1 PIC 9. 05 F3 PIC 9. 05 F2 PIC X(5) OCCURS 1 TO 5 TIMES DEPENDING ON F1. 05 REC-2. 10 F4 PIC X(5) OCCURS 1 TO 5 TIMES DEPENDING ON F3. "


def test_depending(spark):
    raw = ebcdic("321111122222333334444455555")
    a, b = read(spark, ODO, raw, "F2", "REC-2.F4")
    assert [x[0] for x in a] == ["11111", "22222", "33333"] and [x[0] for x in b] == ["44444", "55555"]
    layout = lay(ODO)
    assert layout.size_in(raw + b"more") == 27
    with pytest.raises(ValueError, match="requires an instance"):
        _ = layout.size
    assert read(spark, ODO, ebcdic("02AAAAABBBBB"), "F2")[0] == []


def test_two_records_and_overlay(spark):
    text = "01 DETAIL. 05 A PIC 99. 05 B PIC 99. 01 SUMMARY REDEFINES DETAIL. 05 COUNT-1 PIC 99. "
    assert [e.name for e in parse_copybook(text, free=True)] == ["DETAIL", "SUMMARY"]
    outer = lay("01 R. 05 CODE PIC X(3). 05 GENERIC PIC X(17). ")
    inner = outer.overlay("GENERIC", schema_from_copybook("01 ABC. 05 X PIC X(10). 05 Y PIC X(7). ", free=True))
    df = spark.createDataFrame([(bytearray(ebcdic("ABC0123456789TUVWXYZ")),)], "record binary")
    assert list(df.select(inner.col("X"), inner.col("Y")).first()) == ["0123456789", "TUVWXYZ"]


def test_reference_format():
    lines = [
        "000100* comment", "       01  R.", "", "000200D    debug", "           05  A PIC X(3)", "      -    VALUE 'x'.", "EJECT",
        "           05  OLD PIC 9.                                               IDENT",
    ]
    got = reference_format("\n".join(lines), [("OLD", "NEW")])
    assert got[0].strip() == "01  R." and "VALUE" in got[1] and got[-1].strip() == "05  NEW PIC 9."
    with pytest.raises(ValueError, match="COPY"):
        reference_format("       COPY THIS.")


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("A PIC X(5)", {"name": "A", "picture": "X(5)"}),
        ("A PICTURE IS S9(4) USAGE IS COMPUTATIONAL-3", {"picture": "S9(4)", "usage": "COMP-3"}),
        ("A OCCURS 1 TO 5 TIMES DEPENDING ON N", {"occurs": "5", "depending": "N", "occurs_min": "1"}),
        ("A OCCURS 5 INDEXED BY I PIC X", {"name": "A", "occurs": "5", "picture": "X"}),
        ("B REDEFINES A PIC 9", {"redefines": "A"}),
        ("A PIC 9 VALUE ZEROES", {"name": "A", "value": "ZEROES"}),
        ("COMP-RATE PIC 9", {"name": "COMP-RATE", "picture": "9"}),
        ("PIC X(3)", {"picture": "X(3)"}),
    ],
)
def test_clauses(text, part):
    got = clauses(text)
    assert part.items() <= got.items()


def test_tree():
    roots = parse_copybook("01 R. 05 FILLER PIC X. 05 PIC X. 88 OK VALUE 'x'. 77 ODD PIC 9. 05 A PIC 9. ", free=True)
    assert [c.name for c in roots[0].children] == ["FILLER-1", "FILLER-2", "A"]
    with pytest.raises(ValueError):
        parse_copybook("01 R. 05 B REDEFINES NONE PIC X. ", free=True)


def test_json_schema():
    got = json_schema(parse_copybook("01 R. 05 A PIC 9999. 05 N PIC 9. 05 B OCCURS 1 TO 3 DEPENDING ON N. 10 C PIC S9(4) COMP. ", free=True)[0])
    assert got["properties"]["A"]["conversion"] == "decimal" and got["properties"]["A"]["maxLength"] == 4
    assert got["properties"]["B"]["maxItemsDependsOn"] == {"$ref": "#N"}
    with pytest.raises(ValueError):
        compile_schema({"type": "object", "properties": {"A": {"$ref": "#NOPE"}}})
    with pytest.raises(ValueError):
        compile_schema({"title": "nothing"})
    with pytest.raises(TypeError):
        compile_schema("text")


def test_framing(spark):
    recs = [bytes.fromhex(x) for x in ("01020304", "11121314", "21222324", "31323334")]
    v = b"".join(b"\x00\x08\x00\x00" + r for r in recs)
    assert [r for _, _, r in framing.frame_v(v)] == recs
    vb = b"".join(b"\x00\x14\x00\x00" + v[i : i + 16] for i in (0, 16))
    assert [(b.hex(), r) for _, b, r in framing.frame_vb(vb)] == [("00140000", r) for r in recs]
    assert [r for _, _, r in framing.frame_n(b"".join(recs), lambda raw: 4)] == recs
    with pytest.raises(RuntimeError):
        list(framing.frame_n(b"abc", lambda raw: 0))
    with pytest.raises(ValueError):
        list(framing.frame_v(b"\x00\x20\x00\x00ab"))
    files = spark.createDataFrame([("f", bytearray(b"".join(recs) + b"xy")), ("empty", bytearray())], "path string, content binary")
    rows = framing.frame(files, "F", 4).orderBy("rec_no").collect()
    assert [bytes(r.record) for r in rows] == [*recs, b"xy"] and bytes(rows[0].rdw).hex() == "00080000"
    with pytest.raises(TypeError):
        framing.frame(files, "F", 0)
    with pytest.raises(NotImplementedError):
        framing.frame(files, "U")
    assert [bytes(r.record) for r in framing.frame(files.where("path = 'f'"), "N", None, lambda raw: 4, skip=2).collect()][0] == bytes.fromhex("03041112")


def test_scalars(spark):
    df = spark.createDataFrame([(1020, Decimal("3.145"), "Not a 'good' name")], "a int, b decimal(6,3), c string")
    got = df.select(scalars.digits_5(F.col("a")), scalars.decimal_2(F.col("b")), scalars.name_clean(F.col("c"))).first()
    assert list(got) == ["01020", Decimal("3.14"), "Not_a_good_name"]
    assert [scalars.name_cleaner(x) for x in ("TYPICAL-COBOL", "common_python", "!@#$%^", "")] == ["TYPICAL-COBOL", "common_python", "_", ""]
    scalars.register_converter("twice", lambda c: c * 2)
    assert df.select(scalars.convert(F.col("a"), "twice")).first()[0] == 2040
    with pytest.raises(KeyError):
        scalars.convert(F.col("a"), "unknown", must_exist=True)


def test_unread_fields_are_not_decoded(spark):
    layout = lay("01 R. 05 A PIC XX. 05 B PIC 9(4). ", on_error="raise")
    df = spark.createDataFrame([(bytearray(ebcdic("okBAD!")),)], "record binary").select(*layout.values())
    assert df.select("A").first()[0] == "ok"


def test_round_trip(spark):
    layout = lay("01 R. 05 T PIC X(4). 05 Z PIC S9(4)V99. 05 P PIC S9(5)V9 COMP-3. 05 N PIC S9(8) COMP. 05 F COMP-2. ")
    df = spark.createDataFrame([("ab", Decimal("-12.34"), Decimal("7.5"), -99, 2.5), ("", Decimal(0), Decimal("-0.1"), 3, -1e300)], "t string, z decimal(6,2), p decimal(6,1), n int, f double")
    coded = df.select("*", assemble(layout, {k.upper(): F.col(k) for k in df.columns}).alias("record"))
    for r in coded.select("*", *[layout.col(k).alias(k) for k in "TZPNF"]).toDF(*df.columns, "record", *[f"x{k}" for k in df.columns]).collect():
        assert (r.xt.rstrip(), r.xz, r.xp, r.xn, r.xf) == (r.t, r.z, r.p, r.n, r.f)


def test_dump_and_explain(spark):
    layout = lay(ODO)
    df = spark.createDataFrame([(bytearray(ebcdic("321111122222333334444455555")),)], "record binary")
    rows = df.select(F.explode(layout.dump()).alias("x")).select("x.*").collect()
    assert next(r for r in rows if r.field == "REC-2").offset == 17
    assert "F1" in layout.explain()


def test_schemas_are_checked():
    from tessera.api import check_schema, schema_problems

    good = schema_from_copybook(ODO, free=True)
    assert not list(schema_problems(good))
    check_schema(good)
    for bad in (
        {"type": "text"}, {"type": "array"}, {"properties": []}, {"type": "string", "maxLength": -1}, {"$ref": "http://x"},
        {"type": "object", "properties": {"A": {"$ref": "#B"}}},
    ):
        with pytest.raises(ValueError):
            check_schema(bad)


def test_arrays_beyond_their_bound(spark):
    text = "01 R. 05 N PIC 9. 05 A PIC X OCCURS 0 TO 2 TIMES DEPENDING ON N. 05 Z PIC X. "
    df = spark.createDataFrame([(bytearray(ebcdic("4abcdz")),)], "record binary")
    loose = Layout(schema_from_copybook(text, free=True))
    got = df.select(loose.col("A").alias("a"), loose.col("Z").alias("z")).first()
    assert [x.A for x in got.a] == list("abcd") and got.z == "z"
    strict = Layout(schema_from_copybook(text, free=True, strict=True), strict=True)
    with pytest.raises(Exception, match="may have 2 items, not 4"):
        df.select(strict.col("A")).collect()


def test_replacing_reaches_the_loaders():
    fixed = "       01  R.\n           05  'TAG'-A PIC X.\n           05  'TAG'-B PIC 9.\n"
    got = schema_from_copybook(fixed, replacing=[("'TAG'", "NEW"), ("NEW-B", "OTHER")])
    assert list(got["properties"]) == ["NEW-A", "OTHER"]
    assert list(schema_from_copybook("01 R. 05 :T:-A PIC X. ", free=True, replacing=iter([(":T:", "X")]))["properties"]) == ["X-A"]


def test_ranges_of_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(framing, "RANGE", 1000)
    monkeypatch.setattr(framing, "WINDOW", 256)
    recs = [bytes([i % 251]) * (20 + i % 7) for i in range(900)]
    fixed = [r[:20] for r in recs]
    v = [b"%c%c\0\0" % divmod(len(r) + 4, 256) + r for r in recs]
    vb = [b"%c%c\0\0" % divmod(len(b) + 4, 256) + b for b in (b"".join(v[i : i + 7]) for i in range(0, 900, 7))]
    for name, raw in (("f", b"".join(fixed) + b"xy"), ("v", b"".join(v)), ("b", b"".join(vb)), ("empty", b"")):
        (tmp_path / name).write_bytes(b"head" + raw)
        (tmp_path / (name + "2")).write_bytes(b"head" + raw)
    read = lambda name, *how, **more: framing.read_records(spark, f"file://{tmp_path}/{name}", *how, skip=4, **more)
    for name, want, how in (("f", [*fixed, b"xy"], ("F", 20)), ("v", recs, ("V",)), ("b", recs, ("VB",)), ("f", [*fixed, b"xy"], ("N", None, lambda raw: 20)), ("empty", [], ("VB",)), ("empty", [], ("F", 9))):
        rows = read(name, *how).orderBy("rec_no").collect()
        assert [bytes(r.record) for r in rows] == want and len({r.rec_no for r in rows}) == len(want)
        assert read(name + "*", *how).count() == 2 * len(want)
        assert sorted(bytes(r.record) for r in read(name, *how, whole=True).collect()) == sorted(want)
    (tmp_path / "bad").write_bytes(b"head\x00\x20\x00\x00ab")
    for recfm in ("V", "VB"):
        with pytest.raises(Exception, match="says it has"):
            read("bad", recfm).collect()


def test_fixed_records_take_linear_time(spark, tmp_path):
    import time

    seconds = []
    for n in (20_000, 200_000):
        (tmp_path / str(n)).write_bytes(b"0123456789abcdefghij" * n)
        for _ in range(2):
            began = time.time()
            files = spark.read.format("binaryFile").load(f"file://{tmp_path}/{n}")
            assert framing.frame(files, "F", 20).count() == framing.read_records(spark, f"file://{tmp_path}/{n}", "F", 20).count() == n
            took = time.time() - began
        seconds.append(took)
    assert seconds[1] < 10 * seconds[0] + 3  # ten times the records; squared, it would be a hundred
