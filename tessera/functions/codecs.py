"""Columns that decode slices of records: EBCDIC text, zoned, packed and binary numbers.

All but floats are built-in expressions, so unread fields are never decoded and what is
read stays within generated code. on_error: "null" or "raise" where bytes don't fit.
"""

from __future__ import annotations

import codecs as _codecs
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.picture import Field


@lru_cache
def _table(charset: str) -> tuple[str, str]:
    """Characters that differ between Latin-1 and the charset's reading of the same byte."""
    pairs = [(chr(b), _codecs.decode(bytes([b]), charset)) for b in range(256)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def decode_text(raw: Column, charset: str = "cp037") -> Column:
    text = F.decode(raw, "ISO-8859-1")
    if charset.lower() in ("latin-1", "iso-8859-1"):
        return text
    return F.translate(text, *_table(charset))


def _checked(text: Column, pattern: str, on_error: str) -> Column:
    ok = text.rlike("(?s)^" + pattern)
    if on_error == "raise":
        return F.when(ok | text.isNull(), text).otherwise(F.raise_error(F.concat(F.lit(f"text doesn't match {pattern}: "), text)).cast("string"))
    return F.when(ok, text)


def _decimal(negative: Column, digits: Column, scale: int, most: int, on_error: str) -> Column:
    """Digit string to decimal; `most` digits at most."""
    kind = T.DecimalType(min(38, max(most, scale)), scale)
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(scale + 1)), F.lit("0"))
    point = F.length(padded) - scale
    text = F.concat(F.substring(padded, F.lit(1), point), F.lit("."), F.substring(padded, point + 1, F.lit(max(scale, 1)))) if scale else padded
    text = F.concat(F.when(negative, "-").otherwise(""), text)
    return text.cast(kind) if on_error == "raise" else text.try_cast(kind)


def decode_zoned(raw: Column, scale: int, size: int, on_error: str = "null") -> Column:
    """Low nibbles are digits; B or D in the last byte's zone is a minus."""
    h = F.hex(raw)
    digits = F.regexp_replace(h, "(.)(.)", "$2")
    return _decimal(F.substring(h, -2, 1).isin("B", "D"), digits, scale, size, on_error)


def decode_packed(raw: Column, scale: int, size: int, on_error: str = "null") -> Column:
    """Nibbles but the last are digits; a last nibble of B or D is a minus."""
    h = F.hex(raw)
    return _decimal(F.substring(h, -1, 1).isin("B", "D"), F.substring(h, F.lit(1), F.length(h) - 1), scale, 2 * size - 1, on_error)


def decode_binary(raw: Column, size: int, little: bool = False) -> Column:
    """Two's complement of 1 to 8 bytes, as a long."""
    h = F.hex(raw)
    if little:
        h = F.regexp_replace(F.reverse(h), "(.)(.)", "$2$1")
    if size == 8:
        return F.conv(h, 16, -10).cast("long")
    n = F.conv(h, 16, 10).cast("long")
    return F.when(n >= 1 << (8 * size - 1), n - (1 << (8 * size))).otherwise(n)


def decode_float(raw: Column, size: int, little: bool = False) -> Column:
    """IEEE floats, an extension; the one codec that runs in Python, on Arrow batches."""
    kind = ("<" if little else ">") + f"f{size}"

    @F.pandas_udf(T.FloatType() if size == 4 else T.DoubleType())
    def floats(column):
        import numpy as np
        import pandas as pd

        fits = np.array([b is not None and len(b) == size for b in column], bool)
        out = np.full(len(column), None, object)
        out[fits] = np.frombuffer(b"".join(column[fits]), kind).tolist()
        return pd.Series(out, dtype=object)

    return floats(raw)


def decode(raw: Column, field: Field, charset: str | None = "cp037", little: bool = False, on_error: str = "null") -> Column:
    """The value of a field's slice. charset None leaves text as bytes."""
    if field.kind == "text":
        if charset is None:
            return raw
        return _checked(decode_text(raw, charset), field.pattern, on_error)
    if field.kind == "zoned":
        return raw if charset is None else decode_zoned(raw, field.scale, field.size, on_error)
    if field.kind == "packed":
        if charset is None:
            raise ValueError("packed decimals have no native form")
        return decode_packed(raw, field.scale, field.size, on_error)
    if field.kind == "binary":
        if field.whole_digits >= 18:
            raise ValueError(f"{field.picture} has too many digits for a binary number")
        n = decode_binary(raw, field.size, little)
        if field.strict and field.scale:
            text = F.lpad(F.abs(n).cast("string"), 19, "0")
            return _decimal(n < 0, text, field.scale, 19, on_error)
        return n.cast({2: "smallint", 4: "int"}.get(field.size, "bigint"))
    return decode_float(raw, field.size, little)


def decode_fixed_text(text: Column, field: Field | None, to: str | None = None) -> Column:
    """A slice of a character record, converted if a type is asked for."""
    from tessera.functions.scalars import convert

    return convert(text, to) if to else text
