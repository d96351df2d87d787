"""Insert, update and delete as functions of a table's rows and a change set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateKey, MissingIdentity
from ..functions.scalar import is_zero
from ..spec import TableSpec
from .sequences import Registry, max_id, preset
from .tables import Table


def same_key(a: str, b: str, keys: list[str]) -> Column:
    """Null keys equal each other, as keys of a record map do."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return condition


def last_by_key(df: DataFrame, keys: list[str], position: str | Column) -> DataFrame:
    """The last record of each key. Aggregates before it shuffles, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    at = F.col(position) if isinstance(position, str) else position
    # ties of the position go by the other values, so the choice is the same in every run
    pick = F.max_by(F.struct(*rest), F.struct(at, F.xxhash64(*rest))) if rest else F.lit(None)
    return df.groupBy(*keys).agg(pick.alias("__last")).select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in df.columns])


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Null and zero values replaced by a column's default expression."""
    return df.withColumns({c: F.when(is_zero(F.col(c), df.schema[c].dataType), F.expr(e).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, e in defaults.items() if c in df.columns})


def updated(old: DataFrame, changes: DataFrame, keys: list[str], present: str | None = None, position: str | Column | None = None) -> DataFrame:
    """Old rows with the values of the records that share their key.

    ``present`` names a struct of booleans: only columns that it flags change, and a record that
    flags none changes nothing. Of several changes of one key the last by ``position`` counts;
    without it, one that the values choose, the same in every run.
    """
    if not keys:
        raise MissingIdentity("no identity columns")
    changes = last_by_key(changes, keys, position if position is not None else F.xxhash64(*keys))
    columns = [c for c in old.columns if c not in keys and c in changes.columns]
    flags = set(changes.schema[present].dataType.names) if present else set()
    change = changes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__new_{c}") for c in columns], *([F.col(present).alias("__has")] if present else []), F.lit(True).alias("__hit"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__k_{k}"))

    def value(c: str) -> Column:
        use = F.col("__hit").isNotNull()
        if present:
            use = use & (F.coalesce(F.col(f"__has.{c}"), F.lit(False)) if c in flags else F.lit(False))
        return F.when(use, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)

    return old.join(change, condition, "left").select(*[value(c) if c in columns else F.col(c) for c in old.columns])


def flagged(changes: DataFrame, present: str, keys: list[str]) -> DataFrame:
    """Records that flag at least one column besides their keys."""
    names = [n for n in changes.schema[present].dataType.names if n not in keys]
    any_flag = F.lit(False)
    for n in names:
        any_flag = any_flag | F.coalesce(F.col(f"{present}.{n}"), F.lit(False))
    return changes.where(any_flag)


def deleted(old: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those that share a key with a record."""
    if not keys:
        raise MissingIdentity("no identity columns")
    return old.join(doomed.select(*keys).distinct(), keys, "left_anti")


def upserted(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those that share their key; the others are added."""
    return deleted(old, rows, keys).unionByName(rows.select(*old.columns), allowMissingColumns=True)


@dataclass
class Written:
    """What a change did: rows affected, the largest id assigned, and the records as written."""

    affected: int
    last_id: int | None = None
    records: DataFrame | None = None


class Writer:
    """Inserts, updates and deletes of one table.

    ``before`` are hooks on the records (DataFrame -> DataFrame), ``batch`` says how many rows a
    file of an insert holds. Spark writes one atomic version per call, so there are no partial
    batches to repair.
    """

    def __init__(self, table: Table, spec: TableSpec, *, preset_id: str = "maxid", registry: Registry | None = None, defaults: dict[str, str] | None = None, before: list[Callable[[DataFrame], DataFrame]] | None = None, batch: int | None = None):
        self.table, self.spec, self.preset_id, self.batch = table, spec, preset_id, batch
        self.registry, self.defaults, self.before = registry or Registry(), defaults or {}, before or []

    @property
    def _auto(self) -> str | None:
        return next((c.column for c in self.spec if c.autoincrement), None)

    def _prepared(self, rows: DataFrame) -> DataFrame:
        for hook in self.before:
            rows = rows.transform(hook)
        return with_defaults(rows, self.defaults | {c.column: c.default for c in self.spec if c.default})

    def insert(self, rows: DataFrame, on_duplicate: str = "error", once: str | None = None) -> Written:
        """``on_duplicate``: error, update (an upsert) or ignore (no check). ``once`` names the
        insert: repeated under its name, it does nothing."""
        if once is not None and self.table.landed(once):
            return Written(0)
        rows, auto = self._prepared(rows), self._auto
        if auto:
            rows = preset(rows, auto, self.preset_id, self.registry, self.spec.name, lambda: max_id(self.table.read(), auto))
        rows = rows.persist()
        n, keys = rows.count(), [k for k in self.spec.identities if k in rows.columns]
        last = rows.agg(F.max(auto)).first()[0] if auto and n else None
        if n and keys and on_duplicate == "error":
            again = rows.groupBy(*keys).count().where("count > 1").select(*keys).unionByName(rows.select(*keys).join(self.table.read().select(*keys), keys, "left_semi"))
            found = again.head(1)
            if found:
                raise DuplicateKey(f"{self.spec.name}: {found[0].asDict()}")
        if on_duplicate == "update":
            self.table.change(lambda old: upserted(old, rows, keys))
        elif n:
            options = rows.select(*self.table.read().columns)
            options = options.repartition(-(-n // self.batch)) if self.batch and n > self.batch else options
            if once is None:
                self.table.append(options)
            else:
                self.table.append_once(options, once)
        return Written(n, last, rows)

    def update(self, rows: DataFrame, present: str | None = None) -> Written:
        keys = self._keys(rows)
        rows = self._prepared(rows) if not present else flagged(rows, present, keys)
        again = rows.groupBy(*keys).count().where("count > 1").head(1)
        if again:
            raise DuplicateKey(f"{self.spec.name}: {again[0].asDict()}")
        affected = self.table.read().join(rows.select(*keys).distinct(), keys, "left_semi").count()
        if affected:
            self.table.change(lambda old: updated(old, rows, keys, present))
        return Written(affected)

    def delete(self, rows: DataFrame) -> Written:
        keys = self._keys(rows)
        affected = self.table.read().join(rows.select(*keys).distinct(), keys, "left_semi").count()
        if affected:
            self.table.change(lambda old: deleted(old, rows, keys))
        return Written(affected)

    def _keys(self, rows: DataFrame) -> list[str]:
        keys = self.spec.identities
        if not keys or not set(keys) <= set(rows.columns):
            raise MissingIdentity(f"{self.spec.name}: needs {keys or 'an identity column'}")
        return keys
