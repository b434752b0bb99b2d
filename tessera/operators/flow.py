"""Patterns of record applications: switches, builders, validation, counts, profiles.

Each is one plan over a DataFrame; nothing is collected but what is a report by nature.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import digit_string
from tessera.plans.layout import Layout

Cases = list[tuple[str, Column]]


def switch_case(df: DataFrame, cases: Cases, tag: str = "tag", default: str = "rejected") -> DataFrame:
    """The first case that holds names the row."""
    out = F.lit(default)
    for name, test in reversed(cases):
        out = F.when(test, name).otherwise(out)
    return df.withColumn(tag, out)


def switch_overlap(df: DataFrame, cases: Cases, tag: str = "tag", default: str = "rejected") -> DataFrame:
    """A row for every case that holds."""
    tags = F.array_compact(F.array(*[F.when(test, name) for name, test in cases]))
    tags = F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(default)))
    return df.select("*", F.explode(tags).alias(tag))


def build(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


#: layout identifier -> builder; applications add theirs.
BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def builder(layout: str) -> Callable[[DataFrame], DataFrame]:
    return BUILDERS[layout]


Tests = list[tuple[Column, str]]


def schema_errors(schema: dict, kinds: T.StructType | None = None) -> Column:
    """An array of messages, one per rule of a JSON Schema (an object's) that a row breaks.

    Nested objects and arrays are checked through; an array's item rule counts once. A null
    is a property that isn't there. kinds: the row's Spark schema, by which `type`,
    `additionalProperties` and nested values are checked.
    """
    tests = _object_tests(schema, lambda n: F.col(f"`{n}`"), kinds, "")
    tests += _combined(schema, lambda s: _object_tests(s, lambda n: F.col(f"`{n}`"), kinds, ""), "the row")
    return F.array_compact(F.array(*[F.when(bad, F.lit(said)) for bad, said in tests], F.lit(None).cast("string")))


def _object_tests(schema: dict, get: Callable[[str], Column], kinds: T.StructType | None, path: str) -> Tests:
    needed = schema.get("required", [])
    known = None if kinds is None else {f.name: f.dataType for f in kinds.fields}
    tests: Tests = []
    for name in dict.fromkeys([*schema.get("properties", {}), *needed]):
        rules, full = schema.get("properties", {}).get(name, {}), f"{path}{name}"
        if known is not None and name not in known:
            if name in needed:
                tests.append((F.lit(True), f"'{full}' is a required property"))
            continue
        c = get(name)
        if name in needed:
            tests.append((c.isNull(), f"'{full}' is a required property"))
        tests += _value_tests(rules, c, known and known[name], full)
    if schema.get("additionalProperties") is False:
        tests += [(get(n).isNotNull(), f"'{path}{n}' is not expected") for n in known or {} if n not in schema.get("properties", {})]
    return tests


def _value_tests(rules: dict, c: Column, kind: T.DataType | None, path: str) -> Tests:
    """What a value breaks. Each test is false or null for a null."""
    tests: Tests = []
    if kind is not None and "type" in rules:
        names = [rules["type"]] if isinstance(rules["type"], str) else rules["type"]
        fits = [_has_type(c, kind, n) for n in names]
        bad = F.lit(True)
        for f in fits:
            bad = bad & ~f
        tests.append((c.isNotNull() & bad, f"'{path}' breaks type {rules['type']}"))
    # a pair: what fails, and what to say
    for key, fails in {
        "minimum": lambda v: c < F.lit(v),
        "maximum": lambda v: c > F.lit(v),
        "exclusiveMinimum": lambda v: c <= F.lit(v),
        "exclusiveMaximum": lambda v: c >= F.lit(v),
        "multipleOf": lambda v: F.abs(c / F.lit(v) - F.round(c / F.lit(v))) > 1e-9,
        "minLength": lambda v: F.length(c) < F.lit(v),
        "maxLength": lambda v: F.length(c) > F.lit(v),
        "pattern": lambda v: ~c.rlike(v),
        "enum": lambda v: ~c.isin(*v),
        "const": lambda v: c != F.lit(v),
        "minItems": lambda v: c.isNotNull() & (F.size(c) < v),
        "maxItems": lambda v: c.isNotNull() & (F.size(c) > v),
        "uniqueItems": lambda v: F.size(F.array_distinct(c)) < F.size(c) if v else F.lit(False),
    }.items():
        if key in rules:
            tests.append((fails(rules[key]), f"'{path}' breaks {key} {rules[key]}"))
    if isinstance(kind, T.StructType):
        inner = _object_tests(rules, lambda n: c.getField(n), kind, f"{path}.")
        tests += [(c.isNotNull() & bad, said) for bad, said in inner]
    if isinstance(kind, T.ArrayType) and "items" in rules:
        of = lambda x: _value_tests(rules["items"], x, kind.elementType, f"{path}[]")
        said = [m for _, m in of(F.lit(None).cast(kind.elementType))]
        some = lambda i: F.exists(c, lambda x: F.coalesce(of(x)[i][0], F.lit(False)))
        tests += [(some(i), m) for i, m in enumerate(said)]
    return tests + _combined(rules, lambda s: _value_tests(s, c, kind, path), f"'{path}'", c)


def _combined(rules: dict, of: Callable[[dict], Tests], what: str, value: Column | None = None) -> Tests:
    """allOf, anyOf, oneOf and not."""

    def broken(s: dict) -> Column:
        bad = F.lit(False)
        for b, _ in of(s):
            bad = bad | F.coalesce(b, F.lit(False))
        return bad

    there = F.lit(True) if value is None else value.isNotNull()
    tests: Tests = [t for s in rules.get("allOf", []) for t in of(s)]
    if "anyOf" in rules:
        tests.append((there & functools.reduce(lambda a, b: a & b, [broken(s) for s in rules["anyOf"]]), f"{what} breaks anyOf"))
    if "oneOf" in rules:
        met = functools.reduce(lambda a, b: a + b, [(~broken(s)).cast("int") for s in rules["oneOf"]])
        tests.append((there & (met != 1), f"{what} breaks oneOf"))
    if "not" in rules:
        tests.append((there & ~broken(rules["not"]), f"{what} breaks not"))
    return tests


def _has_type(c: Column, kind: T.DataType, name: str) -> Column:
    """Whether a value that isn't null has a type of JSON Schema; whole numbers are integers."""
    if name == "integer" and isinstance(kind, T.FractionalType):
        return c == F.floor(c)
    text = T.StringType | T.BinaryType | T.DateType | T.TimestampType | T.TimestampNTZType
    own = {
        "integer": T.IntegralType, "number": T.NumericType, "string": text, "boolean": T.BooleanType,
        "array": T.ArrayType, "object": T.StructType | T.MapType, "null": T.NullType,
    }
    return F.lit(name in own and isinstance(kind, own[name]))


def is_valid(schema: dict, kinds: T.StructType | None = None) -> Column:
    return F.size(schema_errors(schema, kinds)) == 0


def validated(df: DataFrame, schema: dict, fail_fast: bool = False, errors: str = "errors") -> DataFrame:
    """df with its errors; fail_fast stops the job at the first row that has any."""
    out = df.withColumn(errors, schema_errors(schema, df.schema))
    if not fail_fast:
        return out
    stop = F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(errors, "; ")))
    return out.where(F.when(F.size(errors) == 0, True).otherwise(stop.cast("boolean")))


def outcomes(df: DataFrame, accepted: Column, schema: dict, outcome: str = "outcome") -> DataFrame:
    """reject (no case takes it), invalid (breaks the schema) or process."""
    return df.withColumn(
        outcome, F.when(~F.coalesce(accepted, F.lit(False)), "reject").when(~is_valid(schema, df.schema), "invalid").otherwise("process")
    )


def zip_code(text: Column) -> Column:
    """A postal code of 5 digits, or of 9 where it has a hyphen or more than 5; padded with zeros."""
    bare = F.regexp_replace(text, "-", "")
    return F.when(text.contains("-") | (F.length(text) > 5), digit_string(9, bare)).otherwise(digit_string(5, bare))


def cleansed(df: DataFrame, keep: Column, **columns: Column) -> DataFrame:
    """A builder that drops rows: those that meet keep, with the cleaned columns."""
    return build(df.where(F.coalesce(keep, F.lit(False))), **columns)


def audit_counts(df: DataFrame, **tests: Column) -> DataFrame:
    """One row: rows read, and rows that meet each test; one pass for all."""
    return df.agg(F.count(F.lit(1)).alias("read"), *[F.count_if(t).alias(n) for n, t in tests.items()])


def error_counts(df: DataFrame, errors: str = "errors") -> DataFrame:
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value, n: how often each column holds each value (as text; null counts)."""
    columns = columns or df.columns
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = texts.unpivot([], columns, "column", "value") if len(columns) > 1 else texts.select(F.lit(columns[0]).alias("column"), F.col(f"`{columns[0]}`").alias("value"))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def key_frequency(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def profile_report(counts: DataFrame, most: int = 20) -> str:
    """Text tables of the most frequent values per column: a report, so `most` values each."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    rows = counts.withColumn("_r", rank).where(F.col("_r") <= most).orderBy("column", "_r").collect()
    out, last = [], None
    for r in rows:
        if r["column"] != last:
            last = r["column"]
            out += ["", last, "=" * len(last), ""]
        out.append(f"{r['n']:>12}  {r['value']!r}")
    return "\n".join(out[1:]) + "\n" if out else ""


def control_total(details: DataFrame, amount: Column, trailer: DataFrame, count: str, total: str) -> DataFrame:
    """One row: the details' count and total, the trailer's, and whether they agree."""
    own = details.agg(F.count(F.lit(1)).alias("rows"), F.sum(amount).alias("sum"))
    said = trailer.agg(F.max(count).alias("said_rows"), F.max(total).alias("said_sum"))
    return own.join(F.broadcast(said), F.lit(True)).withColumn("agree", (F.col("rows") == F.col("said_rows")) & (F.col("sum") == F.col("said_sum")))


def process(df: DataFrame, schema: dict, sink: Callable[[DataFrame], None] | None) -> DataFrame:
    """Validates, writes the valid rows unless sink is None (a dry run), and counts."""
    checked = validated(df, schema)
    if sink is not None:
        sink(checked.where(F.size("errors") == 0).drop("errors"))
    return audit_counts(checked, processed=F.size("errors") == 0, invalid=F.size("errors") > 0)


def by_sheet(cells: DataFrame, pattern: str) -> DataFrame:
    """Sheets whose whole name matches a regular expression."""
    return cells.where(F.col("sheet").rlike(f"^(?:{pattern})$"))


def header_detail(records: DataFrame, per: str = "file") -> tuple[DataFrame, DataFrame]:
    """The first record of each file, and the others."""
    return records.where("rec_no = 0"), records.where("rec_no > 0")


def rebound(records: DataFrame, header: Layout, detail: Layout, first: int = 1) -> tuple[DataFrame, DataFrame]:
    """Mid-file change of schema: the first records of each file by one layout, the rest by another.

    Both read the same scan, and carry file and rec_no.
    """
    own = ["file", "rec_no"]
    return records.where(F.col("rec_no") < first).select(*own, *header.values()), records.where(F.col("rec_no") >= first).select(*own, *detail.values())
