"""Column functions: conversion, formatting and tests of records' values.

All are compositions of built-in functions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"
# fixed values: parts of the reference-date layout and their date patterns, longest first
_LAYOUT = [("2006", "yyyy"), ("January", "MMMM"), ("Jan", "MMM"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("Z07:00", "XXX"), ("-0700", "xx"), ("MST", "zzz"), ("PM", "a")]


def layout_pattern(layout: str) -> str:
    """A reference-date layout (2006-01-02T15:04:05Z07:00) as a date pattern; other letters are quoted."""
    out, at = "", 0
    while at < len(layout):
        for part, pattern in _LAYOUT:
            if layout.startswith(part, at):
                out, at = out + pattern, at + len(part)
                break
        else:
            c = layout[at]
            out, at = out + (f"'{c}'" if c.isalpha() else c), at + 1
    return out


def zero_of(kind: T.DataType) -> Column:
    """The zero value of a type; null for types without one."""
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None).cast(kind)


def is_zero(c: Column, kind: T.DataType) -> Column:
    """True for null and for the zero value, which identities and defaults treat alike."""
    return c.isNull() | F.coalesce(c == zero_of(kind), F.lit(False))


def nullify_empty(c: Column, kind: T.DataType) -> Column:
    return F.when(~is_zero(c, kind), c)


def to_value(c: Column, kind: T.DataType, layout: str = "2006-01-02T15:04:05Z07:00") -> Column:
    """Text as a value: empty numbers are 0, text that doesn't parse is null, times follow the
    layout, structs, arrays and maps are JSON."""
    if isinstance(kind, T.NumericType):
        return F.when(F.trim(c) == "", F.lit(0).cast(kind)).otherwise(c.try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(F.trim(c)).isin("1", "t", "true"), True).when(F.lower(F.trim(c)).isin("0", "f", "false"), False)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(c, F.lit(layout_pattern(layout)))
    if isinstance(kind, T.DateType):
        return c.try_cast(kind)
    if isinstance(kind, T.BinaryType):
        return c.cast(kind)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.when(F.trim(c) != "", F.from_json(c, kind))
    return c


def float_text(c: Column, precision: int | None = None) -> Column:
    """Without exponent; integral values without a fraction; or a fixed number of digits."""
    if precision is not None:
        return F.format_string(f"%.{precision}f", c.cast("double"))
    text = c.cast("string")
    whole = F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text)
    # the shortest text may carry an exponent: the point is moved in the text, so no digit is lost
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"[-.]", "")
    digits = F.regexp_replace(digits, r"(?<=.)0+$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(F.rpad(digits.substr(F.lit(1), power + 1), power + 1, "0"), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), digits.substr(power + 2, F.length(digits)))).otherwise(""))
    return F.when(text.contains("E"), F.concat(sign, F.when(power < 0, small).otherwise(large))).otherwise(whole)


def to_text(c: Column, kind: T.DataType, precision: int | None = None, layout: str | None = None) -> Column:
    """A value as text, null as null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float_text(c, precision)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, layout_pattern(layout) if layout else RFC3339)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return encode_json(c)
    return c.cast("string")


def encode_json(c: Column) -> Column:
    """A value as JSON with its nulls; a null value is null."""
    return F.when(c.isNotNull(), F.to_json(c, {"ignoreNullFields": "false"}))


def decode_json(c: Column, schema: T.DataType | str) -> Column:
    """JSON as a value; empty text is null."""
    return F.from_json(F.when(F.trim(c) != "", c), schema)


def bit_to_bool(c: Column, kind: T.DataType) -> Column:
    """BIT(1) as a boolean: the byte 1 or the text 1."""
    if isinstance(kind, T.BinaryType):
        return F.hex(c).isin("01", "31")
    return c.cast("string").isin("1", "true")


def normal_key(c: Column, kind: T.DataType) -> Column:
    """Keys of different widths in one form: numbers as long (fractions are cut), bytes as text."""
    return c.cast("long") if isinstance(kind, T.NumericType) else c.cast("string")


def row_hash(*columns: str | Column) -> Column:
    """A 64-bit hash of key columns, for dealing rows out; never in place of the key itself."""
    return F.xxhash64(*columns)


def message(template: str, value: Column) -> Column:
    """An error message with ``$value`` and ``$coma`` filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("$value"), F.coalesce(value.cast("string"), F.lit("null"))), F.lit("$coma"), F.lit(","))
