"""A dictionary service: products, dialects and what the catalog holds, as DataFrames.

Spark's catalog says what it knows; keys, references and sequences, which it has
no place for, are declared here.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedKind
from ..operators.sequences import Registry
from ..spec import TableSpec


class Kind(str, Enum):
    """Dictionary kinds; the value names the criteria that a query of it takes, in order."""

    VERSION = "version"
    CATALOGS = "catalogs"
    CATALOG = "catalog"
    CURRENT_SCHEMA = "current_schema"
    SCHEMAS = "schemas"
    SCHEMA = "schema"
    TABLES = "tables"
    TABLE = "table"
    VIEWS = "views"
    VIEW = "view"
    PRIMARY_KEYS = "primary_keys"
    FOREIGN_KEYS = "foreign_keys"
    CONSTRAINTS = "constraints"
    INDEXES = "indexes"
    INDEX = "index"
    SEQUENCES = "sequences"
    FUNCTIONS = "functions"
    SESSION = "session"
    FOREIGN_KEYS_CHECK_ON = "foreign_keys_check_on"
    FOREIGN_KEYS_CHECK_OFF = "foreign_keys_check_off"
    SEQUENCE_NEXT_VALUE = "sequence_next_value"
    LOCK_GET = "lock_get"
    LOCK_RELEASE = "lock_release"


# fixed values: the record shapes of the dictionary
TABLE = "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, TABLE_COMMENT string, TABLE_TYPE string, AUTO_INCREMENT string, CREATE_TIME string, UPDATE_TIME string, TABLE_ROWS int, VERSION string, ENGINE string, DDL string"
COLUMN = "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, COLUMN_COMMENT string, DATA_TYPE string, CHARACTER_MAXIMUM_LENGTH bigint, NUMERIC_PRECISION bigint, NUMERIC_SCALE bigint, IS_NULLABLE string, COLUMN_DEFAULT string, COLUMN_KEY string, DESCENDING string, INDEX_NAME string, INDEX_POSITION int, COLLATION string, IS_AUTOINCREMENT boolean"
KEY = "CONSTRAINT_NAME string, CONSTRAINT_TYPE string, CONSTRAINT_CATALOG string, CONSTRAINT_SCHEMA string, TABLE_NAME string, ORDINAL_POSITION int, COLUMN_NAME string, REFERENCED_TABLE_NAME string, REFERENCED_COLUMN_NAME string, REFERENCED_TABLE_SCHEMA string, POSITION_IN_UNIQUE_CONSTRAINT int, ON_UPDATE string, ON_DELETE string, ON_MATCH string"
INDEX = "TABLE_CATALOG string, TABLE_NAME string, INDEX_TYPE string, TABLE_SCHEMA string, INDEX_SCHEMA string, INDEX_POSITION int, INDEX_NAME string, INDEX_UNIQUE string, INDEX_COLUMNS string, INDEX_ORIGIN string, INDEX_PARTIAL string"
SCHEMA = "CATALOG_NAME string, SCHEMA_NAME string, DEFAULT_CHARACTER_SET_NAME string, DEFAULT_COLLATION_NAME string, SQL_PATH string, SCHEMA_POS bigint, REGION string"
SEQUENCE = "SEQUENCE_CATALOG string, SEQUENCE_SCHEMA string, SEQUENCE_NAME string, SEQUENCE_VALUE bigint, INCREMENT_BY bigint, DATA_TYPE string, START_VALUE bigint, MAX_VALUE bigint"
FUNCTION = "ROUTINE_CATALOG string, ROUTINE_SCHEMA string, ROUTINE_NAME string, ROUTINE_BODY string, DATA_TYPE string, ROUTINE_TYPE string, CHARACTER_SET_NAME string, IS_DETERMINISTIC string"
SESSION = "PID string, USER_NAME string, REGION string, CATALOG_NAME string, SCHEMA_NAME string, APP_NAME string"
LOCK = "LOCK_CATALOG string, LOCK_SCHEMA string, LOCK_TABLE string, LOCK_NAME string, SUCCESS int"


@dataclass(frozen=True)
class Product:
    name: str
    major: int = 0
    minor: int = 0
    release: int = 0

    @classmethod
    def parse(cls, text: str, name: str | None = None) -> Product:
        """From a banner such as ``PostgreSQL 13.4`` or ``8.0.26-log``."""
        m = re.search(r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", text)
        word = name or re.sub(r"[^A-Za-z ].*", "", text).strip() or "unknown"
        return cls(word, *(int(x or 0) for x in m.groups())) if m else cls(word)


@dataclass(frozen=True)
class Dialect:
    """What a product can do. ``upsert``: none, insert or merge; ``load``: none or a loader."""

    product: str
    placeholder: str = "?"
    transactional: bool = True
    upsert: str = "none"
    load: str = "none"
    returning: bool = False
    last_id: bool = False
    preset: str = "undefined"
    quote: str = "'"


# fixed values: capabilities by product
DIALECTS = {
    d.product: d
    for d in (
        Dialect("ansi"),
        Dialect("sqlite", upsert="insert or replace", last_id=True),
        Dialect("mysql", upsert="insert", load="csv", last_id=True, preset="transient"),
        Dialect("postgresql", "$", upsert="merge", load="copy", returning=True),
        Dialect("sqlserver", "@p", upsert="merge", load="bulk"),
        Dialect("oracle", upsert="merge"),
        Dialect("bigquery", transactional=False, upsert="merge", load="parquet"),
        Dialect("vertica", upsert="merge", load="copy", last_id=True),
        Dialect("aerospike", upsert="insert", last_id=True),
        Dialect("spark", transactional=False, upsert="merge", load="parquet"),
    )
}


def best_version(candidates: dict[tuple[int, int], object], product: Product):
    """Of versioned entries the first that is at least the product's version, else the latest."""
    for version in sorted(candidates):
        if version[0] >= product.major and version[1] >= product.minor:
            return candidates[version]
    return candidates[max(candidates)]


def detect(spark: SparkSession, jdbc_url: str | None = None) -> Product:
    """Spark itself, or the product of a JDBC URL."""
    if jdbc_url:
        return Product(re.match(r"jdbc:([a-z0-9]+)", jdbc_url)[1])
    return Product.parse(spark.version, "spark")


@dataclass
class Dictionary:
    """``info(kind, catalog=, schema=, name=)`` gives a DataFrame; declared specs say what Spark
    doesn't. ``before`` and ``after`` are handlers per kind."""

    spark: SparkSession
    specs: dict[str, TableSpec] = field(default_factory=dict)
    sequences: Registry = field(default_factory=Registry)
    before: dict[Kind, list[Callable]] = field(default_factory=dict)
    after: dict[Kind, list[Callable]] = field(default_factory=dict)
    check_references: bool = True
    _locks: dict[str, bool] = field(default_factory=dict)
    _guard: threading.Lock = field(default_factory=threading.Lock)
    _sessions: dict[str, DataFrame] = field(default_factory=dict)

    def declare(self, spec: TableSpec) -> None:
        self.specs[spec.name] = spec

    def info(self, kind: Kind | str, catalog: str | None = None, schema: str | None = None, name: str | None = None) -> DataFrame:
        try:
            kind = Kind(kind)
        except ValueError:
            raise UnsupportedKind(f"unsupported info kind: {kind}") from None
        for handler in self.before.get(kind, []):
            handler(self, kind)
        out = getattr(self, f"_{kind.value}")(catalog or self.spark.catalog.currentCatalog(), schema, name)
        for handler in self.after.get(kind, []):
            out = handler(out)
        return out

    def session(self, key: str) -> DataFrame:
        """The session's record, kept by a caller's key."""
        if key not in self._sessions:
            self._sessions[key] = self.info(Kind.SESSION)
        return self._sessions[key]

    def _rows(self, rows: list[dict], shape: str) -> DataFrame:
        names = [x.split()[0] for x in shape.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], shape)

    def _version(self, *_):
        return self._rows([{"VERSION": self.spark.version}], "VERSION string")

    def _catalogs(self, *_):
        return self._rows([{"CATALOG_NAME": c.name} for c in self.spark.catalog.listCatalogs()], SCHEMA)

    def _catalog(self, catalog, schema, name):
        return self._catalogs().where(F.col("CATALOG_NAME") == (name or catalog))

    def _current_schema(self, catalog, *_):
        return self._rows([{"CATALOG_NAME": catalog, "SCHEMA_NAME": self.spark.catalog.currentDatabase()}], SCHEMA)

    def _schemas(self, catalog, *_):
        return self._rows([{"CATALOG_NAME": catalog, "SCHEMA_NAME": d.name, "SCHEMA_POS": i} for i, d in enumerate(self.spark.catalog.listDatabases())], SCHEMA)

    def _schema(self, catalog, schema, name):
        return self._schemas(catalog).where(F.col("SCHEMA_NAME") == (name or schema))

    def _list(self, schema, views: bool):
        return [t for t in self.spark.catalog.listTables(schema or self.spark.catalog.currentDatabase()) if (t.tableType in ("VIEW", "TEMPORARY")) == views]

    def _table_rows(self, catalog, schema, views):
        auto = {n: next((c.column for c in s if c.autoincrement), None) for n, s in self.specs.items()}
        return self._rows([{"TABLE_CATALOG": catalog, "TABLE_SCHEMA": t.namespace[0] if t.namespace else None, "TABLE_NAME": t.name, "TABLE_COMMENT": t.description, "TABLE_TYPE": t.tableType, "AUTO_INCREMENT": auto.get(t.name), "ENGINE": "spark"} for t in self._list(schema, views)], TABLE)

    def _tables(self, catalog, schema, name):
        return self._table_rows(catalog, schema, False)

    def _views(self, catalog, schema, name):
        return self._table_rows(catalog, schema, True)

    def _table(self, catalog, schema, name):
        spec = self.specs.get(name)
        declared = {c.column: c for c in spec} if spec else {}
        full = f"{schema}.{name}" if schema else name
        kinds = {f.name: f.dataType for f in self.spark.table(full).schema}
        rows = []
        for i, c in enumerate(self.spark.catalog.listColumns(full), 1):
            d, kind = declared.get(c.name), kinds[c.name]
            precision = getattr(kind, "precision", None)
            rows.append({"TABLE_CATALOG": catalog, "TABLE_SCHEMA": schema, "TABLE_NAME": name, "COLUMN_NAME": c.name, "ORDINAL_POSITION": i, "COLUMN_COMMENT": c.description, "DATA_TYPE": c.dataType, "NUMERIC_PRECISION": precision, "NUMERIC_SCALE": getattr(kind, "scale", None), "IS_NULLABLE": "YES" if c.nullable and not (d and (d.required or d.primary_key)) else "NO", "COLUMN_DEFAULT": d.default if d else None, "COLUMN_KEY": "PRI" if d and d.identity else "UNI" if d and d.unique else None, "IS_AUTOINCREMENT": bool(d and d.autoincrement)})
        return self._rows(rows, COLUMN)

    _view = _table

    def _keys(self, catalog, schema, name, kinds):
        rows = []
        for table, spec in self.specs.items():
            if name and table != name:
                continue
            same = {"CONSTRAINT_CATALOG": catalog, "CONSTRAINT_SCHEMA": schema, "TABLE_NAME": table}
            for i, c in enumerate(spec.identities if "PRIMARY KEY" in kinds else [], 1):
                rows.append(same | {"CONSTRAINT_NAME": f"pk_{table}", "CONSTRAINT_TYPE": "PRIMARY KEY", "ORDINAL_POSITION": i, "COLUMN_NAME": c})
            for c in spec:
                if c.ref_table and "FOREIGN KEY" in kinds:
                    rows.append(same | {"CONSTRAINT_NAME": f"fk_{table}_{c.column}", "CONSTRAINT_TYPE": "FOREIGN KEY", "ORDINAL_POSITION": 1, "COLUMN_NAME": c.column, "REFERENCED_TABLE_NAME": c.ref_table, "REFERENCED_COLUMN_NAME": c.ref_column or "id", "REFERENCED_TABLE_SCHEMA": schema})
                if c.unique and "UNIQUE" in kinds:
                    rows.append(same | {"CONSTRAINT_NAME": f"uq_{table}_{c.column}", "CONSTRAINT_TYPE": "UNIQUE", "ORDINAL_POSITION": 1, "COLUMN_NAME": c.column})
        return self._rows(rows, KEY)

    def _primary_keys(self, catalog, schema, name):
        return self._keys(catalog, schema, name, ("PRIMARY KEY",))

    def _foreign_keys(self, catalog, schema, name):
        return self._keys(catalog, schema, name, ("FOREIGN KEY",))

    def _constraints(self, catalog, schema, name):
        return self._keys(catalog, schema, name, ("PRIMARY KEY", "FOREIGN KEY", "UNIQUE"))

    def _indexes(self, *_):
        return self._rows([], INDEX)

    _index = _indexes

    def _sequences(self, catalog, schema, name):
        return self._rows([{"SEQUENCE_CATALOG": catalog, "SEQUENCE_SCHEMA": schema, "SEQUENCE_NAME": n, "SEQUENCE_VALUE": s.value, "INCREMENT_BY": s.increment, "DATA_TYPE": "bigint", "START_VALUE": s.start} for n, s in self.sequences.sequences.items() if not name or n == name], SEQUENCE)

    def _sequence_next_value(self, catalog, schema, name):
        first = self.sequences.reserve(name, 1)
        return self._rows([{"SEQUENCE_CATALOG": catalog, "SEQUENCE_SCHEMA": schema, "SEQUENCE_NAME": name, "SEQUENCE_VALUE": first.value, "INCREMENT_BY": first.increment, "DATA_TYPE": "bigint", "START_VALUE": first.start}], SEQUENCE)

    def _functions(self, catalog, schema, name):
        return self._rows([{"ROUTINE_CATALOG": catalog, "ROUTINE_NAME": f.name, "ROUTINE_BODY": f.className, "ROUTINE_TYPE": "FUNCTION"} for f in self.spark.catalog.listFunctions() if not name or f.name == name], FUNCTION)

    def _session(self, catalog, *_):
        context = self.spark.sparkContext
        user = self.spark.sql("select current_user() as u").first().u
        return self._rows([{"PID": context.applicationId, "USER_NAME": user, "CATALOG_NAME": catalog, "SCHEMA_NAME": self.spark.catalog.currentDatabase(), "APP_NAME": context.appName}], SESSION)

    def _foreign_keys_check_on(self, *_):
        self.check_references = True
        return self._rows([], "ENABLED boolean")

    def _foreign_keys_check_off(self, *_):
        self.check_references = False
        return self._rows([], "ENABLED boolean")

    def _lock(self, catalog, schema, name, take: bool):
        with self._guard:
            ok = self._locks.get(name, False) != take
            if ok:
                self._locks[name] = take
        return self._rows([{"LOCK_CATALOG": catalog, "LOCK_SCHEMA": schema, "LOCK_NAME": name, "SUCCESS": int(ok)}], LOCK)

    def _lock_get(self, catalog, schema, name):
        return self._lock(catalog, schema, name, True)

    def _lock_release(self, catalog, schema, name):
        return self._lock(catalog, schema, name, False)
