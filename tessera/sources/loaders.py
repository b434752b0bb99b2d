"""Where schemas come from: heading rows, metadata sheets, copybooks, inline JSON Schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import convert
from tessera.plans.copybook import json_schema, parse_copybook


def schema_from_heading(names: list[str]) -> dict:
    """All strings; position is the column's; of names that repeat the last column counts."""
    return {
        "type": "object",
        "properties": {n: {"title": n, "$anchor": n, "type": "string", "position": i} for i, n in enumerate(names)},
    }


def schema_from_metadata(sheet: DataFrame, name: str = "name", description: str = "description", kind: str = "dataType") -> dict:
    """A sheet with a row per field; a metadata sheet is small by nature, and is collected."""
    rows = sheet.select(name, description, kind).collect()
    return {
        "type": "object",
        "properties": {
            r[0]: {"title": r[0], "$anchor": r[0], "description": r[1], "type": "string", "conversion": r[2], "position": i}
            for i, r in enumerate(rows)
        },
    }


def schema_from_copybook(
    text: str, strict: bool = False, extended: bool = False, free: bool = False, replacing: Iterable[tuple[str, str]] = ()
) -> dict:
    """The first record description's schema."""
    return schemas_from_copybook(text, strict, extended, free, replacing)[0]


def schemas_from_copybook(
    text: str, strict: bool = False, extended: bool = False, free: bool = False, replacing: Iterable[tuple[str, str]] = ()
) -> list[dict]:
    """All record descriptions' schemas. replacing: pairs of texts, as COPY ... REPLACING has them."""
    return [json_schema(e, strict, extended) for e in parse_copybook(text, free, replacing)]


def read_copybook(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def columns(schema: dict) -> list[tuple[str, int, str | None]]:
    """(name, position, conversion) of a flat schema's properties."""
    return [
        (name, int(p.get("position", i)), p.get("conversion", p.get("type")))
        for i, (name, p) in enumerate(schema["properties"].items())
    ]


def bind(cells: DataFrame, schema: dict, cell, converted: bool = False) -> DataFrame:
    """A flat schema over cells: cell(position) is a Column; missing cells are null.

    converted=False gives the cells as they are; True applies each property's conversion.
    """
    out: list[Column] = []
    for name, position, kind in columns(schema):
        c = cell(position)
        out.append((convert(c, kind) if converted else c).alias(name))
    return cells.select(*out)


def expects(df: DataFrame, schema: dict) -> bool:
    """Whether df has all of a schema's properties (it may have more)."""
    return set(schema["properties"]) <= set(df.columns)


def body(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """Rows of the body; blank ones go, and those that don't meet keep."""
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
    out = df.where(~blank)
    return out if keep is None else out.where(keep)
