"""Workbooks and delimited files as DataFrames, by suffix or by name."""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.layout import Layout
from tessera.sources.framing import read_records
from tessera.sources.loaders import bind, columns, schema_from_heading

READERS: dict[str, Callable[..., DataFrame]] = {}


def file_suffix(*names: str):
    """Registers a reader for suffixes; a later registration replaces an earlier one."""

    def put(reader):
        for n in names:
            READERS[n.lower()] = reader
        return reader

    return put


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads by the path's suffix."""
    m = re.search(r"(\.[A-Za-z0-9]+)(?:/|\*)*$", path)
    reader = READERS.get(m[1].lower() if m else "")
    if reader is None:
        raise NotImplementedError(f"no reader is known for {path}")
    return reader(spark, path, **options)


@file_suffix(".csv")
def read_csv(
    spark: SparkSession,
    path: str,
    schema: dict | None = None,
    header: bool | None = None,
    converted: bool = False,
    sep: str = ",",
    multiline: bool | None = None,
    skip: int = 0,
    **options,
) -> DataFrame:
    """Cells are strings, empty ones ''. Without a schema the first row is the heading (of the
    first file by name); with one all rows are data, unless header says otherwise.

    multiline: whether cells may hold line feeds, which makes a file one task; None looks for
    a line that quotes don't close. skip: lines to leave out at each file's start.
    """
    header = (schema is None) if header is None else header
    options = {"sep": sep, "escape": '"', "inferSchema": False} | options
    if multiline is None and "multiLine" not in options:
        multiline = has_open_quotes(spark, path, options.get("quote", '"'))
    options["multiLine"] = bool(multiline) or options.get("multiLine", False)
    if skip:
        if options["multiLine"]:
            raise ValueError("lines can't be left out where cells hold line feeds")
        return _skipped_csv(spark, path, schema, header, converted, skip, options)
    names = sorted(spark.read.text(path).inputFiles())
    first = next((r for n in names if (r := spark.read.options(header=False, **options).csv(n).limit(1).first()) is not None), None)
    if first is None:
        if schema is None:
            raise ValueError(f"{path} has no heading row")
        first = [None] * len(schema["properties"])
    if schema is None:
        schema = schema_from_heading([n or "" for n in first])
    width = max(len(first), 1 + max((p for _, p, _ in columns(schema)), default=0))
    kind = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    cells = spark.read.options(header=header, enforceSchema=True, **options).schema(kind).csv(path).na.fill("")
    return bind(cells, schema, lambda i: F.col(f"_c{i}"), converted)


def has_open_quotes(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether a line has an odd number of quotes: a parallel scan that stops at the first."""
    odd = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return not spark.read.text(path).where(odd % 2 == 1).isEmpty()


def lines_after(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """file, value: the lines of all files but the first `skip` of each, which lie in its first
    split (of a file whose first split holds fewer lines, only those are left out)."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")

    def work(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            if not len(batch):
                continue
            names, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for name, start in zip(names, starts, strict=True):
                seen[name] = seen.get(name, 0) + 1
                keep.append(start > 0 or seen[name] > skip)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["file", "value"]).filter(pa.array(keep))

    return lines.mapInArrow(work, "file string, value string") if skip else lines.select(F.col("file_path").alias("file"), "value")


def _skipped_csv(spark: SparkSession, path: str, schema: dict | None, header: bool, converted: bool, skip: int, options: dict) -> DataFrame:
    texts = {k: str(v) for k, v in options.items() if k not in ("multiLine", "inferSchema")}
    if schema is None:
        one = lines_after(spark, path, skip).orderBy("file").limit(1).first()
        if one is None:
            raise ValueError(f"{path} has no heading row after {skip} lines")
        cells = spark.range(1).select(F.schema_of_csv(F.lit(one["value"]), texts).alias("s")).first()["s"]
        width = len(T._parse_datatype_string(re.sub(r"^STRUCT<(.*)>$", r"\1", cells)).fields)
        kind = ", ".join(f"_c{i} string" for i in range(width))
        heading = spark.range(1).select(F.from_csv(F.lit(one["value"]), kind, texts).alias("c")).first()["c"]
        schema = schema_from_heading([x or "" for x in heading])
    width = 1 + max((p for _, p, _ in columns(schema)), default=0)
    kind = ", ".join(f"_c{i} string" for i in range(width))
    rows = lines_after(spark, path, skip + bool(header)).where(F.col("value") != "")
    rows = rows.select(F.from_csv("value", kind, texts).alias("c")).select("c.*").na.fill("")
    return bind(rows, schema, lambda i: F.col(f"_c{i}"), converted)


@file_suffix(".tab", ".tsv")
def read_tab(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


@file_suffix(".json", ".ndjson", ".jsonnl")
def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None, mode: str = "FAILFAST", skip: int = 0, **options) -> DataFrame:
    """A document per line, typed by a Spark schema (or by inference); a bad line fails.
    skip: lines to leave out at each file's start, which needs a schema."""
    if skip:
        if schema is None:
            raise ValueError("a schema is needed where lines are left out")
        rows = lines_after(spark, path, skip).where(F.trim("value") != "")
        return rows.select(F.from_json("value", schema, {"mode": mode, **options}).alias("r")).select("r.*")
    reader = spark.read.options(mode=mode, **options)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_fixed_text(
    spark: SparkSession, path: str, schema: dict, converted: bool = True, paths: list[str] | None = None, skip: int = 0
) -> DataFrame:
    """Lines cut at running offsets. paths: fields to select, instead of all at the top. skip:
    lines to leave out at each file's start."""
    lines = lines_after(spark, path, skip)
    layout = Layout(schema, "value", text=True, convert_text=converted)
    return lines.select(*([layout.col(p).alias(p) for p in paths] if paths else layout.values()))


def read_ebcdic(
    spark: SparkSession, path: str, schema: dict, recfm: str = "N", lrecl: int | None = None, paths: list[str] | None = None, skip: int = 0, **how
) -> DataFrame:
    """Records of mainframe files, decoded. skip: bytes to leave out at each file's start;
    how: Layout's options."""
    layout = Layout(schema, **how)
    if recfm.upper() in ("F", "FB"):
        lrecl = lrecl or layout.size
    elif recfm.upper() == "N" and isinstance(layout.top.size, int):
        recfm, lrecl = "F", layout.size  # records of one size need no walk
    rows = read_records(spark, path, recfm, lrecl, None if recfm.upper() != "N" else layout.sizer, skip)
    return rows.select(*([layout.col(p).alias(p) for p in paths] if paths else layout.values()))


def read_native(spark: SparkSession, path: str, schema: dict, lrecl: int | None, **how) -> DataFrame:
    """Fixed records in the machine's own byte order; text stays bytes."""
    if not lrecl:
        raise TypeError("native records need their length")
    return read_ebcdic(spark, path, schema, "F", lrecl, charset=None, little=True, **how)


# Spreadsheets: archives of XML, read with the standard library in Arrow batches.

CELLS = "file string, sheet string, row_no int, cells array<struct<kind:string,value:string>>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def xlsx_sheets(raw: bytes):
    """(sheet, rows of (kind, text) cells); kinds: n, s, b, d, f (formula text), '' (empty)."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    dated = set()
    if "xl/styles.xml" in names:
        root = ElementTree.parse(z.open("xl/styles.xml")).getroot()
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(f"{{{_NS['m']}}}numFmt")}
        for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
            n = xf.get("numFmtId", "0")
            # the built-in date formats
            if int(n) in (*range(14, 23), *range(45, 48)) or re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")).lower()):
                dated.add(i)
    rel = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
    for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().findall("m:sheets/m:sheet", _NS):
        target = rel[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
        root = ElementTree.parse(z.open(target.lstrip("/") if target.startswith("/") else "xl/" + target)).getroot()
        rows = []
        for row in root.iter(f"{{{_NS['m']}}}row"):
            cells: list[tuple[str, str | None]] = []
            # rows that aren't there are empty ones
            rows += [[]] * (int(row.get("r", len(rows) + 1)) - 1 - len(rows))
            for c in row.findall("m:c", _NS):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                if letters:
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    cells += [("", None)] * (at - 1 - len(cells))
                v, f, t = c.find("m:v", _NS), c.find("m:f", _NS), c.get("t", "n")
                text = v.text if v is not None else None
                if f is not None:
                    cells.append(("f", "=" + (f.text or "")))
                elif t == "s":
                    cells.append(("s", shared[int(text)]))
                elif t == "inlineStr":
                    cells.append(("s", "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))))
                elif text is None:
                    cells.append(("", None))
                elif t == "b":
                    cells.append(("b", "true" if text == "1" else "false"))
                elif t == "n" and int(c.get("s", "0")) in dated:
                    cells.append(("d", str(datetime(1899, 12, 30) + timedelta(days=float(text)))))
                else:
                    cells.append(("n" if t == "n" else "s", text))
            rows.append(cells)
        yield s.get("name"), rows


def ods_sheets(raw: bytes):
    """The same of an OpenDocument spreadsheet."""
    o, t, x = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("office", "table", "text"))
    root = ElementTree.parse(zipfile.ZipFile(io.BytesIO(raw)).open("content.xml")).getroot()
    for table in root.iter(f"{t}table"):
        rows, blank_rows = [], 0
        for row in table.iter(f"{t}table-row"):
            cells: list[tuple[str, str | None]] = []
            blank_cells = 0
            for c in row:
                if c.tag not in (f"{t}table-cell", f"{t}covered-table-cell"):
                    continue
                kind = c.get(f"{o}value-type", "")
                text = "\n".join("".join(p.itertext()) for p in c.findall(f"{x}p"))
                if kind in ("float", "currency", "percentage"):
                    cell = ("n", c.get(f"{o}value"))
                elif kind == "date":
                    cell = ("d", c.get(f"{o}date-value"))
                elif kind == "boolean":
                    cell = ("b", c.get(f"{o}boolean-value"))
                else:
                    cell = ("s" if kind else "", text)
                times = int(c.get(f"{t}number-columns-repeated", "1"))
                if not cell[1]:  # counts where a cell follows; a sheet ends in thousands of these
                    blank_cells += times
                    continue
                cells += [("", None)] * blank_cells + [cell] * times
                blank_cells = 0
            times = int(row.get(f"{t}number-rows-repeated", "1"))
            if not cells:
                blank_rows += times
                continue
            rows += [[]] * blank_rows + [cells] * times
            blank_rows = 0
        yield table.get(f"{t}name"), rows


def spreadsheet_cells(spark: SparkSession, path: str, parse) -> DataFrame:
    """CELLS of all sheets of all files at path."""

    def work(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for sheet, rows in parse(raw.as_py()):
                    cells = [[{"kind": k, "value": v} for k, v in row] for row in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(rows), pa.string()),
                            pa.array([sheet] * len(rows), pa.string()),
                            pa.array(range(len(rows)), pa.int32()),
                            pa.array(cells, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))),
                        ],
                        names=["file", "sheet", "row_no", "cells"],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, CELLS)


def _sheet(spark: SparkSession, path: str, parse, sheet: str | None, schema: dict | None, converted: bool) -> DataFrame:
    """The rows of one sheet, or of all, which must then have one heading."""
    cells = spreadsheet_cells(spark, path, parse)
    if sheet is not None:
        cells = cells.where(F.col("sheet") == sheet)
    heading = schema is None
    if heading:
        found = cells.where("row_no = 0").select(F.col("cells.value").alias("names")).distinct().limit(2).collect()
        if not found:
            raise ValueError(f"{path} has no heading row")
        if len(found) > 1:
            raise ValueError(f"{path} has sheets with another heading than others: name one sheet, or give a schema")
        schema = schema_from_heading([n or "" for n in found[0]["names"]])
    rows = cells.where("row_no > 0") if heading else cells
    return bind(rows, schema, lambda i: F.get(F.col("cells.value"), F.lit(i)), converted)


@file_suffix(".xlsx", ".xlsm")
def read_xlsx(spark, path, sheet: str | None = None, schema: dict | None = None, converted: bool = False) -> DataFrame:
    return _sheet(spark, path, xlsx_sheets, sheet, schema, converted)


@file_suffix(".ods")
def read_ods(spark, path, sheet: str | None = None, schema: dict | None = None, converted: bool = False) -> DataFrame:
    return _sheet(spark, path, ods_sheets, sheet, schema, converted)


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    """Sheet names; delimited and record files have one sheet without a name."""
    parse = {".xlsx": xlsx_sheets, ".xlsm": xlsx_sheets, ".ods": ods_sheets}.get(re.search(r"\.\w+$", path)[0].lower())
    if parse is None:
        return [""]
    return [r.sheet for r in spreadsheet_cells(spark, path, parse).select("sheet").distinct().orderBy("sheet").collect()]


def xls_sheets(raw: bytes):
    """The same of an old binary spreadsheet, by the xlrd library. Error cells hold their text."""
    import xlrd

    book = xlrd.open_workbook(file_contents=raw)

    def cell(c) -> tuple[str, str | None]:
        # the library's numbers of cell types
        if c.ctype in (0, 6):
            return "", None
        if c.ctype == 3:
            return "d", str(xlrd.xldate_as_datetime(c.value, book.datemode))
        if c.ctype == 4:
            return "b", "true" if c.value else "false"
        if c.ctype == 5:
            return "e", xlrd.error_text_from_code.get(c.value, str(c.value))
        if c.ctype == 2:
            return "n", str(int(c.value)) if float(c.value).is_integer() else str(c.value)
        return "s", c.value

    for s in book.sheets():
        yield s.name, [[cell(c) for c in s.row(i)] for i in range(s.nrows)]


def numbers_sheets(raw: bytes):
    """The tables of a Numbers document, by the numbers_parser library: sheet::table."""
    import tempfile

    import numbers_parser

    with tempfile.NamedTemporaryFile(suffix=".numbers") as f:  # the library opens paths only
        f.write(raw)
        f.flush()
        for s in numbers_parser.Document(f.name).sheets:
            for t in s.tables:
                yield f"{s.name}::{t.name}", [[_number_cell(v) for v in row] for row in t.rows(values_only=True)]


def _number_cell(v) -> tuple[str, str | None]:
    if v is None:
        return "", None
    if isinstance(v, bool):
        return "b", "true" if v else "false"
    if isinstance(v, datetime):
        return "d", str(v)
    if isinstance(v, int | float):
        return "n", str(int(v)) if float(v).is_integer() else str(v)
    return "s", str(v)


if importlib.util.find_spec("xlrd"):  # without the library the format isn't registered

    @file_suffix(".xls")
    def read_xls(spark, path, sheet: str | None = None, schema: dict | None = None, converted: bool = False) -> DataFrame:
        return _sheet(spark, path, xls_sheets, sheet, schema, converted)


if importlib.util.find_spec("numbers_parser"):

    @file_suffix(".numbers")
    def read_numbers(spark, path, sheet: str | None = None, schema: dict | None = None, converted: bool = False) -> DataFrame:
        return _sheet(spark, path, numbers_sheets, sheet, schema, converted)
