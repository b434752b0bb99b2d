"""Small functions on values, and the registry of named conversions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> Column function; users add their own with register_converter().
CONVERTERS: dict[str | None, Callable[[Column], Column]] = {
    None: lambda c: c,
    "null": lambda c: F.lit(None).cast("string"),
    "bool": lambda c: c.cast("boolean"),
    "integer": lambda c: F.trim(c.cast("string")).cast("long"),
    "number": lambda c: F.trim(c.cast("string")).cast("double"),
    "string": lambda c: c.cast("string"),
    "decimal": lambda c: F.trim(c.cast("string")).cast("decimal(38,10)"),
}


def register_converter(name: str, function: Callable[[Column], Column]) -> None:
    CONVERTERS[name] = function


def convert(column: Column, name: str | None, must_exist: bool = False) -> Column:
    """The named conversion; an unknown name leaves the value alone, or is a KeyError."""
    if must_exist:
        return CONVERTERS[name](column)
    return CONVERTERS.get(name, CONVERTERS[None])(column)


def digit_string(size: int, value: Column) -> Column:
    """The right-most `size` characters, padded with zeros."""
    return F.right(F.concat(F.lit("0" * size), value.cast("string")), F.lit(size))


def digits_5(value: Column) -> Column:
    return digit_string(5, value)


def decimal_places(digits: int, value: Column) -> Column:
    """Rounded half to even."""
    exact = value.cast("decimal(38,18)")
    return F.bround(exact, digits).cast(f"decimal(38,{digits})")


def decimal_2(value: Column) -> Column:
    return decimal_places(2, value)


_LEGAL = r"^[A-Za-z_][A-Za-z0-9_.-]*$|^$"


def name_cleaner(name: str) -> str:
    """A name fit for an anchor: what isn't legal becomes one underscore; legal names stay."""
    if re.search(_LEGAL, name):
        return name
    return re.sub("_+", "_", re.sub(r"[^A-Za-z0-9_.-]", "_", re.sub(r"^[^A-Za-z_]", "_", name)))


def name_clean(column: Column) -> Column:
    """name_cleaner() as an expression."""
    out = F.regexp_replace(column, r"^[^A-Za-z_]", "_")
    out = F.regexp_replace(F.regexp_replace(out, r"[^A-Za-z0-9_.-]", "_"), "_+", "_")
    return F.when(column.rlike(_LEGAL), column).otherwise(out)
