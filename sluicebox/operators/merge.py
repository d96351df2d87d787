"""Merge: make a table hold what a source says, keyed by a match key.

The match key decides what is kept; an identity, where both sides have it,
turns a leftover pair into an update. Joins are on the key columns themselves,
null equal to null; Spark picks the strategy.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateKey
from ..functions.scalar import is_zero
from ..shared import settled
from .sequences import assign_ids, max_id
from .tables import Table

ORDER = ("delete", "update", "insert")


@dataclass
class MergeConfig:
    """``match``: key columns, or expressions by name. ``identity``: the id column. ``position``:
    what makes a later source record win. ``strategy``: insert+delete, insert+update+delete or
    upsert+delete. A merge writes one new version, so operations have no order or way of their
    own; ``order`` is that of the report."""

    match: list[str] | dict[str, Column]
    identity: str = "id"
    position: str | None = None
    strategy: str = "insert+delete"
    order: tuple[str, ...] = ORDER
    preset: bool = True

    def __post_init__(self):
        if not self.match:
            raise ValueError("a merge needs a match key")
        if self.strategy not in ("insert+delete", "insert+update+delete", "upsert+delete"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if sorted(self.order) != sorted(ORDER):
            raise ValueError("the order names delete, update and insert once each")


@dataclass
class MergeResult:
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    kept: int = 0
    seconds: dict[str, float] = field(default_factory=dict)
    order: tuple[str, ...] = ORDER

    @property
    def affected(self) -> int:
        return self.inserted + self.updated + self.deleted

    def report(self) -> str:
        count = {"insert": self.inserted, "update": self.updated, "delete": self.deleted}
        return "\n".join([*(f"{op}: {count[op]}" for op in self.order), f"kept: {self.kept}", *(f"{k}: {v:.3f} s" for k, v in self.seconds.items())])


def _key(config: MergeConfig) -> Column:
    """The match key as one struct."""
    parts = config.match.items() if isinstance(config.match, dict) else [(c, F.col(c)) for c in config.match]
    return F.struct(*[c.alias(n) for n, c in parts])


def _others(rows: DataFrame, chosen: DataFrame, by: str, row: str) -> DataFrame:
    """Rows of keys that hold several, without the chosen one (a column ``first``). Equal rows are
    counted, so each copy beyond the chosen one comes out."""
    same = F.col(f"r.{by}").eqNullSafe(F.col(f"c.{by}"))
    found = rows.alias("r").join(chosen.alias("c"), same).groupBy(F.col(f"r.{by}").alias(by), F.col(f"r.{row}").alias(row), F.col("c.first").alias("first")).agg(F.count("*").alias("n"))
    left = F.col("n") - F.when(F.col(row).eqNullSafe(F.col("first")), 1).otherwise(0)
    return found.select(by, F.explode(F.array_repeat(row, left.cast("int"))).alias(row))


def classify(source: DataFrame, target: DataFrame, config: MergeConfig) -> DataFrame:
    """``action, src, dst``: every record of either side once.

    Of source records of one key the last by position counts. Of target rows of one key the one
    with the smallest identity is the match, the rest are deletions, equal copies included. Under
    insert+update+delete and upsert+delete, leftovers that share an identity are updates; of
    several such source records the last counts and the others are insertions.

    Both sides go through one aggregation by the key, leftovers through one by the identity; only
    rows of keys that the target holds several times are read again.
    """
    ident = config.identity
    at = F.col(config.position) if config.position else F.xxhash64(*source.columns)
    given = source.select(_key(config).alias("key"), F.struct(*source.columns).alias("src"), F.struct(at, F.xxhash64(*source.columns)).alias("place"))
    held = target.select(_key(config).alias("key"), F.struct(*target.columns).alias("dst"))
    kind_src, kind_dst = given.schema["src"].dataType, held.schema["dst"].dataType
    both = given.unionByName(held, allowMissingColumns=True)
    first = F.min_by("dst", F.when(F.col("dst").isNotNull(), F.struct(F.col(f"dst.{ident}"), F.xxhash64("dst"))))
    by_key = both.groupBy("key").agg(F.max_by("src", "place").alias("src"), first.alias("dst"), F.count("dst").alias("n"))
    action = F.when(F.col("src").isNull(), "delete").when(F.col("dst").isNull(), "insert").otherwise("keep")
    several = _others(held, by_key.where("n > 1").select("key", F.col("dst").alias("first")), "key", "dst")
    found = by_key.select(action.alias("action"), "src", "dst").unionByName(several.select(F.lit("delete").alias("action"), F.lit(None).cast(kind_src).alias("src"), "dst"))
    if config.strategy == "insert+delete":
        return found
    id_type = source.schema[ident].dataType
    paired = F.when(F.col("action") == "insert", ~is_zero(F.col(f"src.{ident}"), id_type)).otherwise(F.col("action") == "delete")
    # leftovers are written once: three steps read them
    left = settled(found.where(paired).select(F.coalesce(F.col(f"src.{ident}"), F.col(f"dst.{ident}")).alias("id"), "src", "dst"))
    place = F.struct(F.col(f"src.{config.position}") if config.position else F.xxhash64("src"), F.xxhash64("src"))
    by_id = left.groupBy("id").agg(
        F.max_by("src", F.when(F.col("src").isNotNull(), place)).alias("src"), F.min_by("dst", F.when(F.col("dst").isNotNull(), F.xxhash64("dst"))).alias("dst"), F.count("src").alias("n_src"), F.count("dst").alias("n_dst")
    )
    outcome = F.when(F.col("src").isNull(), "delete").when(F.col("dst").isNull(), "insert").otherwise("update")
    more_src = _others(left.where("src is not null").select("id", "src"), by_id.where("n_src > 1").select("id", F.col("src").alias("first")), "id", "src")
    more_dst = _others(left.where("dst is not null").select("id", "dst"), by_id.where("n_dst > 1").select("id", F.col("dst").alias("first")), "id", "dst")
    return (
        found.where(~paired)
        .unionByName(by_id.select(outcome.alias("action"), "src", "dst"))
        .unionByName(more_src.select(F.lit("insert").alias("action"), "src", F.lit(None).cast(kind_dst).alias("dst")))
        .unionByName(more_dst.select(F.lit("delete").alias("action"), F.lit(None).cast(kind_src).alias("src"), "dst"))
    )


def merged(classified: DataFrame, columns: list[str], config: MergeConfig) -> DataFrame:
    """The table after the merge, from the classified records: kept rows as they were, updated
    ones with the source's values, new ones; ids of new ones as the source has them."""
    out = classified.where("action <> 'delete'")
    has = set(out.schema["src"].dataType.names)

    def value(c: str) -> Column:
        if c not in has:
            return F.col(f"dst.{c}")
        return F.when(F.col("action") == "keep", F.col(f"dst.{c}")).otherwise(F.col(f"src.{c}"))

    return out.select(*[value(c).alias(c) for c in columns])


class Merge:
    """Merges into a table: ``Merge(table, config).run(source)``."""

    def __init__(self, table: Table, config: MergeConfig):
        self.table, self.config = table, config

    def run(self, source: DataFrame) -> MergeResult:
        clock, result, config = time.monotonic(), MergeResult(order=self.config.order), self.config
        target = self.table.read()
        ident = config.identity
        if config.strategy != "insert+delete":
            again = source.where(~is_zero(F.col(ident), source.schema[ident].dataType)).groupBy(ident).count().where("count > 1").head(1)
            if again:
                raise DuplicateKey(f"source repeats {ident} {again[0][0]}")
        found = classify(source, target, config).persist()
        counts = {r.action: r["count"] for r in found.groupBy("action").count().collect()}
        result.inserted, result.updated, result.deleted, result.kept = (counts.get(k, 0) for k in ("insert", "update", "delete", "keep"))
        result.seconds["classify"] = time.monotonic() - clock
        clock = time.monotonic()
        if result.affected:
            rows = merged(found, target.columns, config)
            if config.preset and ident in target.columns and result.inserted:
                rows = assign_ids(rows, ident, max_id(target, ident) + 1)
            self.table.replace(rows)
        result.seconds["write"] = time.monotonic() - clock
        found.unpersist()
        return result
