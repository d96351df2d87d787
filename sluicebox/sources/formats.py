"""Record formats: separated text with exact quoting, nested records, JSON lines and parquet."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import is_zero, to_text, to_value
from ..spec import in_case


@dataclass(frozen=True)
class TextFormat:
    """Separators, quote, escape and the text of null. Only text and times are quoted."""

    field: str = ","
    record: str = "\n"
    quote: str = '"'
    escape: str = "\\"
    null: str = "null"
    precision: int | None = None
    layout: str | None = None
    nullify_empty: frozenset[str] = frozenset()
    case: str | None = None

    def escaped(self, c: Column) -> Column:
        """Escape character first, then field separator, record separator and quote."""
        for x in dict.fromkeys(x for x in (self.escape, self.field, self.record, self.quote) if x):
            c = F.replace(c, F.lit(x), F.lit(self.escape + x))
        return c

    def cell(self, c: Column, kind: T.DataType, nullify: bool = False) -> Column:
        text = to_text(c, kind, self.precision, self.layout)
        if isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.StructType, T.ArrayType, T.MapType)):
            text = F.concat(F.lit(self.quote), self.escaped(text), F.lit(self.quote))
        if nullify:
            text = F.when(~is_zero(c, kind), text)
        return F.coalesce(text, F.lit(self.null))

    def line(self, df: DataFrame, columns: list[str] | None = None) -> Column:
        """One record as text: a single expression, in generated code."""
        columns = columns or df.columns
        return F.concat_ws(self.field, *[self.cell(F.col(f"`{c}`"), df.schema[c].dataType, c in self.nullify_empty) for c in columns])

    def header(self, columns: list[str]) -> str:
        named = [in_case(c, self.case) if self.case else c for c in columns]
        return self.field.join(f"{self.quote}{c}{self.quote}" for c in named)


def text_lines(df: DataFrame, fmt: TextFormat | None = None, columns: list[str] | None = None, name: str = "line") -> DataFrame:
    return df.select((fmt or TextFormat()).line(df, columns).alias(name))


def write_text(df: DataFrame, path: str, fmt: TextFormat | None = None, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Partitioned text files; the record separator ends each record."""
    fmt = fmt or TextFormat()
    text_lines(df, fmt, columns).write.mode(mode).option("lineSep", fmt.record).text(path)


def _records(spark: SparkSession, path: str, fmt: TextFormat) -> DataFrame:
    """``cells, first``: the fields of each record as they stand, and whether it begins a file.

    Separators within quotes, or that the escape precedes, belong to a value, so records are found
    in whole files; a file is as large as the partition that wrote it.
    """
    e, f, r, q = (re.escape(x) for x in (fmt.escape, fmt.field, fmt.record, fmt.quote))

    def until(end: str) -> str:
        quoted = f"{q}(?:[^{e}{q}]++|{e}[\\s\\S])*+{q}|{q}|" if q else ""
        return f"((?:{quoted}[^{e}{q}{end}]++|{e}[\\s\\S])*+){end}"

    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    end = F.when(F.col("text").endswith(fmt.record) | (F.col("text") == ""), F.col("text")).otherwise(F.concat("text", F.lit(fmt.record)))
    rows = text.select(F.posexplode(F.regexp_extract_all(end, F.lit(until(r)), F.lit(1))).alias("at", "record"))
    cells = F.regexp_extract_all(F.concat("record", F.lit(fmt.field)), F.lit(until(f)), F.lit(1))
    return rows.select(cells.alias("cells"), (F.col("at") == 0).alias("first"))


def _plain(cell: Column, fmt: TextFormat) -> Column:
    """A cell without quotes and escapes; the text of null is null."""
    n = len(fmt.quote)
    quoted = cell.startswith(fmt.quote) & cell.endswith(fmt.quote) & (F.length(cell) >= 2 * n) if n else F.lit(False)
    inner = F.when(quoted, F.substring(cell, n + 1, F.length(cell) - 2 * n)).otherwise(cell)
    return F.when(cell == fmt.null, None).otherwise(F.regexp_replace(inner, re.escape(fmt.escape) + r"([\s\S])", "$1"))


def _own_dialect(fmt: TextFormat) -> bool:
    return len(fmt.field) == len(fmt.record) == len(fmt.escape) == 1 and fmt.escape != fmt.quote


def read_text(spark: SparkSession, path: str, schema: T.StructType, fmt: TextFormat | None = None, header: bool = True, layout: str | None = None) -> DataFrame:
    """Separated text by the names of its header, with the conversions of ``to_value``.

    Reads what ``write_text`` writes, escaped separators and line breaks included. A header name
    without a field is an error. The text of null is null. Where the escape is the quote itself,
    as in common CSV, Spark's CSV reader is used.
    """
    fmt = fmt or TextFormat()
    if _own_dialect(fmt):
        names = headers(spark, path, fmt) if header else schema.names
        rows = _records(spark, path, fmt)
        rows = rows.where("not first") if header else rows
        raw = rows.select(*[_plain(F.get("cells", F.lit(i)), fmt).alias(n) for i, n in enumerate(names)])
    else:
        raw = spark.read.options(header=header, sep=fmt.field, quote=fmt.quote, escape=fmt.escape, nullValue=fmt.null, multiLine=True).csv(path, inferSchema=False)
        raw = raw if header else raw.toDF(*schema.names)
    by_name = {n.lower(): n for n in raw.columns}
    unknown = [n for n in raw.columns if n.lower() not in {f.name.lower() for f in schema}]
    if unknown:
        raise KeyError(f"no field for {', '.join(unknown)}")
    return raw.select(*[to_value(F.col(f"`{by_name[f.name.lower()]}`"), f.dataType, layout or fmt.layout or "2006-01-02T15:04:05Z07:00").alias(f.name) if f.name.lower() in by_name else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def headers(spark: SparkSession, path: str, fmt: TextFormat | None = None) -> list[str]:
    fmt = fmt or TextFormat()
    if not _own_dialect(fmt):
        return spark.read.options(header=True, sep=fmt.field, quote=fmt.quote, escape=fmt.escape).csv(path).columns
    first = _records(spark, path, fmt).where("first").select(F.transform("cells", lambda c: _plain(c, fmt)).alias("names")).first()
    return list(first.names) if first else []


def flattened(df: DataFrame) -> DataFrame:
    """Nested records as rows of plain columns named by path.

    Structs inline; each array of structs gives a row per element, and a row of nulls where it
    has none. Arrays side by side give all combinations.
    """
    while True:
        nested = next((f for f in df.schema if isinstance(f.dataType, T.StructType) or isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)
        if nested is None:
            return df
        if isinstance(nested.dataType, T.ArrayType):
            df = df.withColumn(nested.name, F.explode_outer(F.col(f"`{nested.name}`")))
            continue
        columns = []
        for f in df.schema:
            if f.name == nested.name:
                columns += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}.{g}") for g in f.dataType.names]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)


def _element(fmt: TextFormat, fields: list[T.StructField]):
    def text(x: Column) -> Column:
        return F.concat_ws(fmt.field, *[fmt.cell(x[g.name], g.dataType) for g in fields])

    return text


def depth_lines(df: DataFrame, outer: TextFormat, inner: dict[str, TextFormat], name: str = "line") -> DataFrame:
    """One line per record, with arrays of structs in a format of their own: a header record and
    one record per element, joined by the inner record separator."""
    cells = []
    for f in df.schema:
        if f.name not in inner:
            cells.append(outer.cell(F.col(f.name), f.dataType))
            continue
        fmt, fields = inner[f.name], f.dataType.elementType.fields
        head = fmt.field.join(f"{fmt.quote}{f.name}.{g.name}{fmt.quote}" for g in fields)
        body = F.transform(F.col(f.name), _element(fmt, fields))
        text = F.concat_ws(fmt.record, F.lit(head), F.array_join(body, fmt.record))
        cells.append(F.when(F.col(f.name).isNotNull(), text).otherwise(F.lit(outer.null)))
    return df.select(F.concat_ws(outer.field, *cells).alias(name))


def nested(df: DataFrame, one: dict[str, list[str]] | None = None, many: dict[str, list[str]] | None = None, by: list[str] | None = None) -> DataFrame:
    """Columns named ``Name.field`` as nested records: structs for ``one``, arrays for ``many``.

    Each row gives an array of one element, or null where all its columns are null. With ``by``
    rows of one parent become one record; elements keep their column order as sort order.
    """
    one, many = one or {}, many or {}
    used = {f"{n}.{f}" for n, fs in (one | many).items() for f in fs}
    plain = [F.col(f"`{c}`") for c in df.columns if c not in used]

    def struct(n: str, fs: list[str]) -> Column:
        present = F.coalesce(*[F.col(f"`{n}.{f}`").cast("string") for f in fs]).isNotNull()
        return F.when(present, F.struct(*[F.col(f"`{n}.{f}`").alias(f) for f in fs]))

    out = df.select(*plain, *[struct(n, fs).alias(n) for n, fs in one.items()], *[struct(n, fs).alias(n) for n, fs in many.items()])
    if by:
        rest = [c for c in out.columns if c not in by and c not in many]
        return out.groupBy(*by).agg(*[F.first(c, True).alias(c) for c in rest], *[F.array_sort(F.collect_list(n)).alias(n) for n in many])
    return out.select(*[F.when(F.col(c).isNotNull(), F.array(c)).alias(c) if c in many else F.col(f"`{c}`") for c in out.columns])


def json_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """One JSON object per record, nulls included."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def load(df: DataFrame, target: str, product: str = "parquet", columns: list[str] | None = None, options: dict[str, str] | None = None, mode: str = "append") -> int:
    """Bulk load, by product: parquet, json and csv write files; a JDBC product gets batched
    inserts from all partitions at once. Columns that the target lacks are left out where
    ``columns`` names its own. Returns how many records were given."""
    if columns is not None:
        own = {c.lower(): c for c in df.columns}
        df = df.select(*[own[c.lower()] for c in columns if c.lower() in own])
    # counted while it is written
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("n"))
    options = options or {}
    if product == "jdbc":
        df.write.format("jdbc").options(dbtable=target, **({"batchsize": "1000"} | options)).mode(mode).save()
    elif product == "json":
        df.write.mode(mode).options(**({"ignoreNullFields": "false"} | options)).json(target)
    elif product == "csv":
        df.write.mode(mode).options(**({"header": "true", "nullValue": "null"} | options)).csv(target)
    elif product == "parquet":
        df.write.mode(mode).options(**({"compression": "zstd"} | options)).parquet(target)
    else:
        raise ValueError(f"no loader for {product!r}")
    return seen.get["n"]
