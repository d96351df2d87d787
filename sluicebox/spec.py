"""Declared record schemas: names, identities, constraints and presence of columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import UnmatchedColumns
from .functions.types import spark_type


@dataclass(frozen=True)
class ColumnSpec:
    """One field of a record. ``names``: columns that feed it, the first is canonical."""

    field: str
    type: T.DataType | str = "string"
    names: tuple[str, ...] = ()
    namespace: str = ""
    primary_key: bool = False
    autoincrement: bool = False
    sequence: str | None = None
    unique: bool = False
    unique_within: str | None = None
    table: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None
    required: bool = False
    transient: bool = False
    json: bool = False
    bit: bool = False
    nullify_empty: bool = False
    default: str | None = None
    time_layout: str | None = None
    error: str | None = None

    def __post_init__(self):
        if isinstance(self.type, str):
            object.__setattr__(self, "type", spark_type(self.type))
        if self.sequence and not self.identity:
            raise ValueError(f"{self.field}: a sequence needs an identity column")

    @property
    def column(self) -> str:
        return self.namespace + (self.names[0] if self.names else self.field)

    @property
    def identity(self) -> bool:
        return self.primary_key or self.autoincrement or (self.names[0] if self.names else self.field).lower() == "id"

    def to_field(self) -> T.StructField:
        """With all that a StructType can't say in its metadata."""
        said = {k: v for k, v in vars(self).items() if k not in ("field", "type") and v not in (None, False, "", ())}
        return T.StructField(self.column, self.type, not (self.required or self.primary_key), said | ({"names": list(self.names)} if self.names else {}))


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]

    def __iter__(self):
        return iter(self.columns)

    @property
    def identities(self) -> list[str]:
        return [c.column for c in self if c.identity and not c.transient]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.to_field() for c in self if not c.transient])

    @classmethod
    def from_schema(cls, name: str, schema: T.StructType) -> TableSpec:
        known = ColumnSpec.__dataclass_fields__
        return cls(name, tuple(ColumnSpec(f.name, f.dataType, **{k: tuple(v) if isinstance(v, list) else v for k, v in f.metadata.items() if k in known and k != "namespace"}) for f in schema))

    def declared(self, df: DataFrame) -> DataFrame:
        """Columns in declared order, for loaders that go by place."""
        return df.select(*[c.column for c in self if not c.transient and c.column in df.columns])

    def write_columns(self, df: DataFrame, only: list[str] | None = None) -> DataFrame:
        """Columns to write, identities last. ``only`` restricts them, ignoring case; identities stay."""
        wanted = {x.lower() for x in only} if only is not None else None
        own = [c for c in self if not c.transient and c.column in df.columns]
        plain = [c.column for c in own if not c.identity and (wanted is None or c.column.lower() in wanted)]
        return df.select(*plain, *[c.column for c in own if c.identity])

    def keys_only(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in self.identities if c in df.columns])


def folded(name: str) -> str:
    return name.lower().replace("_", "")


def field_case(names: list[str]) -> str:
    """The case format of a set of column names: upper_, lower_, upper, lower or camel."""
    text = "".join(names)
    if "_" in text:
        return "upper_" if text == text.upper() else "lower_"
    return "upper" if text == text.upper() else "lower" if text == text.lower() else "camel"


def in_case(name: str, case: str) -> str:
    """A field name in another case format."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+", name)
    if case.endswith("_"):
        out = "_".join(words)
        return out.upper() if case == "upper_" else out.lower()
    return {"upper": name.upper(), "lower": name.lower()}.get(case, "".join(w.capitalize() for w in words))


@dataclass
class Match:
    """Which column feeds which field, and which columns are left."""

    fields: dict[str, str] = field(default_factory=dict)
    unmatched: list[str] = field(default_factory=list)


def match(columns: list[str], spec: TableSpec) -> Match:
    """By exact name, then ignoring case, then ignoring case and underscores; the first field to
    claim a column keeps it, and a field takes the first column that it matches."""
    out = Match()
    for column in columns:
        for same in (lambda a, b: a == b, lambda a, b: a.lower() == b.lower(), lambda a, b: folded(a) == folded(b)):
            found = next((c for c in spec if not c.transient and any(same(c.namespace + n, column) for n in (c.names or (c.field,)))), None)
            if found:
                break
        if found and found.field not in out.fields:
            out.fields[found.field] = column
        elif not found:
            out.unmatched.append(column)
    return out


def project(df: DataFrame, spec: TableSpec, residual: str | None = None) -> DataFrame:
    """``df`` as records of the spec: one select, pushed into the scan by Spark.

    Columns without a field are an error, or go to the map column ``residual`` (name to text).
    JSON columns are decoded and bit columns become booleans.
    """
    from .functions.scalar import bit_to_bool, decode_json

    found = match(df.columns, spec)
    if found.unmatched and residual is None:
        raise UnmatchedColumns(found.unmatched)
    out: list[Column] = []
    for c in spec:
        if c.field not in found.fields:
            continue
        source = F.col(f"`{found.fields[c.field]}`")
        if c.json:
            source = decode_json(source, c.type)
        elif c.bit:
            source = bit_to_bool(source, df.schema[found.fields[c.field]].dataType)
        out.append(source.alias(c.field))
    if residual is not None:
        pairs = [x for name in found.unmatched for x in (F.lit(name), F.col(f"`{name}`").cast("string"))]
        out.append((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias(residual))
    return df.select(*out)


def nest(df: DataFrame, prefix: str, name: str, fields: list[str] | None = None) -> DataFrame:
    """Columns that begin with a namespace as one struct column without it."""
    own = [c for c in df.columns if c.startswith(prefix) and (fields is None or c[len(prefix) :] in fields)]
    return df.select(*[c for c in df.columns if c not in own], F.struct(*[F.col(c).alias(c[len(prefix) :]) for c in own]).alias(name))


def flatten(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """A struct column as columns with a namespace."""
    kind = df.schema[name].dataType
    return df.select(*[c for c in df.columns if c != name], *[F.col(f"{name}.{f}").alias(prefix + f) for f in kind.names])


def with_identity(spec: TableSpec, *columns: str) -> TableSpec:
    """The spec with these columns as its primary key."""
    return replace(spec, columns=tuple(replace(c, primary_key=c.column in columns) for c in spec))
