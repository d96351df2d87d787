"""Parameterised reads: SQL or DataFrames to records, pages per key, columns of any query."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import TableSpec, project

# fixed values: products whose placeholders have numbers, and their prefixes
NUMBERED = {"postgresql": "$", "sqlserver": "@p"}
#: Up to so many keys are a literal list; more are joined as a table.
INLINE_KEYS = 1000


def _literals(sql: str) -> Iterator[tuple[bool, str]]:
    """(is a literal or comment, text) pieces of a statement."""
    at = 0
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", sql, re.S):
        yield False, sql[at : m.start()]
        yield True, m[0]
        at = m.end()
    yield False, sql[at:]


def native_placeholders(sql: str, product: str) -> str:
    """``$1`` or ``@p1`` as Spark's ``:p1``, outside literals and comments."""
    prefix = NUMBERED.get(product)
    if not prefix:
        return sql
    return "".join(text if literal else re.sub(re.escape(prefix) + r"(\d+)", r":p\1", text) for literal, text in _literals(sql))


def vendor_placeholders(sql: str, product: str) -> str:
    """``?`` in a product's own form, outside literals and comments."""
    prefix, n, out = NUMBERED.get(product), 0, []
    if not prefix:
        return sql
    for literal, text in _literals(sql):
        parts = [text] if literal else text.split("?")
        for i, part in enumerate(parts):
            n += i > 0
            out.append((f"{prefix}{n}" if i else "") + part)
    return "".join(out)


@dataclass
class Query:
    """SQL text and its arguments. The text is bound again for each read, never pasted together."""

    sql: str
    args: list[Any] | dict[str, Any] = field(default_factory=list)

    def on(self, spark: SparkSession) -> DataFrame:
        return spark.sql(self.sql, args=self.args or None)


@dataclass
class Page:
    """Rows offset < place <= offset + limit of each value of ``by`` among ``keys``.

    No limit is limit 0. ``order`` says what place means; without it, all other columns in turn,
    so that pages never depend on partitions.
    """

    by: str
    keys: list[Any] | DataFrame | None = None
    offset: int = 0
    limit: int = 0
    order: list[str | Column] | None = None
    legacy_single_key: bool = False


def column_named(df: DataFrame, name: str) -> str:
    """A column's own spelling, ignoring case."""
    found = next((c for c in df.columns if c == name), None) or next((c for c in df.columns if c.lower() == name.lower()), None)
    if found is None:
        raise KeyError(name)
    return found


def among(df: DataFrame, columns: list[str], keys: list[Any] | DataFrame) -> DataFrame:
    """Rows whose columns, one or several, are among the keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(*[F.col(k).alias(c) for k, c in zip(keys.columns, columns)]).distinct(), columns, "left_semi")
    if not keys:
        return df.where(F.lit(False))
    rows = [k if isinstance(k, (tuple, list)) else (k,) for k in keys]
    if len(rows) > INLINE_KEYS:
        schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])
        return among(df, columns, df.sparkSession.createDataFrame(rows, schema))
    if len(columns) == 1:
        kind = df.schema[columns[0]].dataType
        values = [r[0] for r in rows]
        if isinstance(kind, T.IntegralType):  # a fraction equals no integer, and a plain literal reaches the scan
            values = [int(v) if isinstance(v, (int, float)) else v for v in values if not isinstance(v, float) or v.is_integer()]
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            values = [float(v) if isinstance(v, (int, float)) else v for v in values]
        return df.where(F.col(columns[0]).isin(values) if values else F.lit(False))
    return df.where(F.struct(*columns).isin([F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows]))


def equal_to(df: DataFrame, **criteria: Any) -> DataFrame:
    """Rows that equal all criteria; empty ones are skipped, as a catalog's callers expect."""
    for name, value in criteria.items():
        if value is not None and value != "":
            df = df.where(F.col(column_named(df, name)) == F.lit(value))
    return df


def paged(df: DataFrame, page: Page) -> DataFrame:
    """One window; its literal upper bound lets Spark drop rows before the shuffle."""
    by = column_named(df, page.by)
    if page.keys is not None:
        if page.legacy_single_key and not isinstance(page.keys, DataFrame) and len(page.keys) < 2:
            return among(df, [by], page.keys)
        df = among(df, [by], page.keys)
    if not page.offset and not page.limit:
        return df
    order = page.order or [F.col(c) for c in df.columns if c != by]
    ranked = df.withColumn("__place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    if page.limit:
        ranked = ranked.where(F.col("__place") <= page.offset + page.limit)
    return ranked.where(F.col("__place") > page.offset).drop("__place")




class Reader:
    """Reads of one statement, re-usable with other arguments.

    ``source`` is SQL, a Query or a DataFrame; ``spec`` maps its columns to record fields;
    ``residual`` collects columns without a field; ``keep`` drops rows; ``cache`` answers
    repeated reads.
    """

    def __init__(self, spark: SparkSession, source: str | Query | DataFrame, spec: TableSpec | None = None, *, residual: str | None = None, keep: str | Column | None = None, cache=None, show_sql: Callable[[str], None] | None = None):
        self.spark, self.spec, self.residual, self.keep, self.cache, self.show_sql = spark, spec, residual, keep, cache, show_sql
        self.source = Query(source) if isinstance(source, str) else source

    def rows(self, args: list[Any] | dict[str, Any] | None = None, page: Page | None = None, refresh: bool = False) -> DataFrame:
        if isinstance(self.source, DataFrame):
            df = self.source
        else:
            query = Query(self.source.sql, args if args is not None else self.source.args)
            if self.show_sql:
                self.show_sql(query.sql)
            df = self.cache.read(query, refresh=refresh, by=page.by if page else None) if self.cache else query.on(self.spark)
        if page:
            df = paged(df, page)
        if self.keep is not None:
            df = df.where(self.keep)
        return project(df, self.spec, self.residual) if self.spec else df

    def first(self, args=None) -> Row | None:
        """At most one row, never through the cache."""
        plain = Reader(self.spark, self.source, self.spec, residual=self.residual, keep=self.keep)
        return plain.rows(args).first()

    def stream(self, args=None, page: Page | None = None) -> Iterator[Row]:
        """Rows one after another, a partition at a time in the driver."""
        yield from self.rows(args, page).toLocalIterator(prefetchPartitions=True)

    def maps(self, args=None) -> Iterator[dict[str, Any]]:
        return (r.asDict(True) for r in self.stream(args))

    def tuples(self, args=None) -> Iterator[tuple]:
        return (tuple(r) for r in self.stream(args))

    def columns(self, args=None) -> T.StructType:
        """Names and types, by analysis alone."""
        return self.rows(args).schema


def records(spark: SparkSession, data: DataFrame | Iterable[Any] | Any, spec: TableSpec) -> DataFrame:
    """Records held by the driver, one or many (dicts, tuples, objects), as a DataFrame."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, (dict, Row)) or not isinstance(data, Iterable):
        data = [data]
    fields = [c for c in spec if not c.transient]

    def values(r: Any) -> tuple:
        if isinstance(r, (tuple, list)) and not isinstance(r, Row):
            return tuple(r)
        get = r.get if isinstance(r, dict) else r.asDict().get if isinstance(r, Row) else lambda k, d=None: getattr(r, k, d)
        return tuple(get(c.field, get(c.column)) for c in fields)

    return spark.createDataFrame([values(r) for r in data], T.StructType([T.StructField(c.column, c.type) for c in fields]))
