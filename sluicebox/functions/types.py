"""Declared type names of database products as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# fixed values: type names by what they hold
_NAMES = {
    T.LongType(): "int integer bigint smallint tinyint mediumint int2 int4 int8 int16 int32 int64 uint8 uint16 uint32 serial bigserial",
    T.DoubleType(): "float double real float4 float8 float32 float64",
    T.BooleanType(): "bool boolean bit bitbool",
    T.StringType(): "char varchar nvarchar nchar text tinytext mediumtext longtext clob string uuid guid json jsonb enum",
    T.DateType(): "date",
    T.TimestampType(): "time timestamp datetime timestamptz datetime2",
    T.BinaryType(): "binary varbinary blob tinyblob mediumblob longblob bytes rawbytes bytea",
}
_BY_NAME = {name: kind for kind, names in _NAMES.items() for name in names.split()}


def spark_type(declared: str) -> T.DataType:
    """The Spark type of a declared name such as ``varchar(20)`` or ``decimal(7,2)``.

    Decimals keep precision and scale where both are declared, else they are doubles. Unsigned
    64-bit integers need twenty digits. Unknown names are matched by the longest known name
    they contain, else they are strings.
    """
    name = declared.strip().lower()
    m = re.fullmatch(r"([a-z0-9_ ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?(\s+unsigned)?", name)
    base, p, s, unsigned = m.groups() if m else (name, None, None, None)
    if base in ("decimal", "numeric", "number", "dec"):
        return T.DecimalType(int(p), int(s or 0)) if p else T.DoubleType()
    if base == "uint64" or base == "bigint" and unsigned:
        return T.DecimalType(20, 0)
    if base in _BY_NAME:
        return _BY_NAME[base]
    parts = sorted((n for n in _BY_NAME if n in base), key=len)
    return _BY_NAME[parts[-1]] if parts else T.StringType()


def widened(kind: T.DataType) -> T.DataType:
    """Integers as long, floats as double, decimals and the rest unchanged."""
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    return T.DoubleType() if isinstance(kind, T.FloatType) else kind
