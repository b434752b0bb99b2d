"""The codecs' inverse: values to the bytes of a field, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.codecs import _table
from tessera.functions.picture import Field


def encode_text(value: Column, size: int, charset: str = "cp037") -> Column:
    """Padded with blanks, or cut, to size."""
    dst, src = _table(charset)
    text = F.rpad(F.substring(F.coalesce(value.cast("string"), F.lit("")), 1, size), size, " ")
    return F.encode(F.translate(text, src, dst), "ISO-8859-1")


def _digits(value: Column, scale: int, size: int) -> Column:
    """Absolute value as `size` digits, without its point."""
    n = F.abs(value.cast(f"decimal(38,{scale})")).cast("string")
    return F.lpad(F.regexp_replace(n, r"\.", ""), size, "0")


def encode_zoned(value: Column, scale: int, size: int, signed: bool = True) -> Column:
    d = F.regexp_replace(_digits(value, scale, size), "(.)", "F$1")
    zone = F.when(value < 0, "D").otherwise("C" if signed else "F")
    return F.unhex(F.concat(F.substring(d, 1, 2 * size - 2), zone, F.substring(d, -1, 1)))


def encode_packed(value: Column, scale: int, size: int, signed: bool = True) -> Column:
    sign = F.when(value < 0, "D").otherwise("C" if signed else "F")
    return F.unhex(F.concat(_digits(value, scale, 2 * size - 1), sign))


def encode_binary(value: Column, size: int, little: bool = False) -> Column:
    h = F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)
    if little:
        h = F.regexp_replace(F.reverse(h), "(.)(.)", "$2$1")
    return F.unhex(h)


def encode_float(value: Column, size: int, little: bool = False) -> Column:
    kind = ("<" if little else ">") + f"f{size}"

    @F.pandas_udf("binary")
    def raw(column):
        import numpy as np

        return column.map(lambda x: np.array(x, kind).tobytes())

    return raw(value.cast("double"))


def encode(value: Column, field: Field, charset: str = "cp037", little: bool = False) -> Column:
    if field.kind == "text":
        if field.groups[2] == "." and set(field.symbols) <= {"S", "9", "."}:  # an edited number
            n = field.size - field.signed
            sign = F.when(value < 0, "-").otherwise(" ") if field.signed else F.lit("")
            text = F.lpad(F.abs(value.cast(f"decimal(38,{field.scale})")).cast("string"), n, "0")
            return encode_text(F.concat(sign, text), field.size, charset)
        return encode_text(value, field.size, charset)
    if field.kind == "zoned":
        return encode_zoned(value, field.scale, field.size, field.signed)
    if field.kind == "packed":
        return encode_packed(value, field.scale, field.size, field.signed)
    if field.kind == "binary":
        return encode_binary(value, field.size, little)
    return encode_float(value, field.size, little)


def record(*parts: Column) -> Column:
    """Binary columns one after another."""
    return F.concat(*parts)
