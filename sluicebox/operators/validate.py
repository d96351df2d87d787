"""Validation of records: uniqueness, references and required values, as violations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation
from ..functions.scalar import message
from ..spec import ColumnSpec, TableSpec

VIOLATION = "Location string, Field string, Value string, Message string, Check string"


@dataclass
class Options:
    unique: bool = True
    reference: bool = True
    required: bool = True
    shallow: bool = False
    location: str = ""
    present: str | None = None
    within_batch: bool = False


@dataclass
class Validation:
    violations: DataFrame
    spec: TableSpec | None = None
    extra: dict = field(default_factory=dict)

    @property
    def failed(self) -> bool:
        return not self.violations.isEmpty()

    def text(self) -> str:
        """All violations in one text, by location."""
        row = self.violations.select(F.concat_ws(" ", "Location", "Message").alias("m"), "Location").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Location", "m"))), lambda x: x["m"]), ",").alias("t")).first()
        return row.t or ""

    def raise_if_failed(self) -> None:
        if self.failed:
            raise ConstraintViolation(self.text(), self.violations)


def _violation(df: DataFrame, at: str, c: ColumnSpec, check: str, default: str) -> DataFrame:
    value = F.col(c.column)
    return df.select(F.concat(F.col(at), F.lit(f".{c.field}")).alias("Location"), F.lit(c.field).alias("Field"), value.cast("string").alias("Value"), message(c.error or default, value).alias("Message"), F.lit(check).alias("Check"))


def _given(df: DataFrame, c: ColumnSpec, present: str | None) -> DataFrame:
    if present and c.column in df.schema[present].dataType.names:
        return df.where(F.coalesce(F.col(f"{present}.{c.column}"), F.lit(False)))
    return df


def unique_violations(df: DataFrame, rows: DataFrame, value: str, identity: list[str], within: str | None = None) -> DataFrame:
    """Records whose value a row with another identity has, in the same scope."""
    # of a value's rows the least and the greatest identity tell: one of them differs from any that
    # is not alone. So copies of a value are reduced to one row before they are shuffled.
    key = F.struct(*identity) if identity else F.lit(1)
    by = [F.col(value).alias("__v"), *([F.col(within).alias("__w")] if within else [])]
    other = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(key).alias("__least"), F.max(key).alias("__most"))
    condition = F.col(value) == F.col("__v")
    if within:
        condition = condition & (F.col(within) == F.col("__w"))
    if identity:
        condition = condition & (~key.eqNullSafe(F.col("__least")) | ~key.eqNullSafe(F.col("__most")))
    return df.where(F.col(value).isNotNull()).join(other, condition, "left_semi")


def missing_references(df: DataFrame, reference: DataFrame, column: str, ref_column: str) -> DataFrame:
    """Records whose non-null reference has no row. Spark broadcasts the keys when they are few."""
    return df.where(F.col(column).isNotNull()).join(reference.select(F.col(ref_column).alias(column)).distinct(), column, "left_anti")


def validate(df: DataFrame, spec: TableSpec, tables: dict[str, DataFrame], options: Options | None = None, at: str | None = None, children: dict[str, TableSpec] | None = None) -> Validation:
    """Violations of the spec's constraints.

    ``tables`` are what records are held against. ``at`` names a column with each record's
    location; without it, records are numbered by their identity. ``children`` are specs of array
    columns of records, whose violations are located as ``record.Field[j]``.
    """
    options = options or Options()
    if at is None:
        place = F.concat(F.lit(f"{options.location}["), F.concat_ws(",", *[F.col(i).cast("string") for i in spec.identities]), F.lit("]")) if spec.identities else F.lit(options.location)
        df, at = df.withColumn("__at", place), "__at"
    found: list[DataFrame] = []
    for c in spec:
        if c.transient or c.column not in df.columns:
            continue
        given = _given(df, c, options.present)
        if options.required and c.required:
            found.append(_violation(given.where(F.col(c.column).isNull()), at, c, "notnull", "is null"))
        if options.unique and c.unique:
            rows = tables[c.table or spec.name]
            hit = unique_violations(given, rows, c.column, [i for i in spec.identities if i in df.columns], c.unique_within)
            found.append(_violation(hit, at, c, "unique", "value '$value' is not unique"))
            if options.within_batch:
                again = given.join(given.groupBy(c.column).count().where("count > 1").select(c.column), c.column, "left_semi")
                found.append(_violation(again, at, c, "unique", "value '$value' is not unique"))
        if options.reference and c.ref_table:
            hit = missing_references(given, tables[c.ref_table], c.column, c.ref_column or "id")
            found.append(_violation(hit, at, c, "refKey", "ref key '$value' does not exist"))
    if not options.shallow:
        for name, child in (children or {}).items():
            inner = df.select(F.col(at).alias("__up"), F.posexplode(name).alias("__j", "__child")).select(F.format_string(f"%s.{name}[%d]", "__up", "__j").alias("__at"), "__child.*")
            found.append(validate(inner, child, tables, Options(**{**vars(options), "present": None}), "__at").violations)
    spark = df.sparkSession
    out = spark.createDataFrame([], VIOLATION)
    for f in found:
        out = out.unionByName(f)
    return Validation(out.distinct(), spec)
