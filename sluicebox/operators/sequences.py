"""Identities: sequence arithmetic, reservations, and ids for records without one."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_zero
from ..shared import settled


@dataclass
class Sequence:
    """The next value to hand out; values are congruent to start modulo increment."""

    value: int = 1
    increment: int = 1
    start: int = 1

    def aligned(self) -> int:
        """The least value of the sequence that is not below the current one, nor below start."""
        if self.value <= self.start:
            return self.start
        return self.value + -(self.value - self.start) % self.increment

    def next_value(self, n: int) -> int:
        """The value after n more have been handed out."""
        return self.aligned() + n * self.increment

    def min_value(self, n: int) -> int:
        """The value n steps back from the current one, which counts as the last of the sequence
        that it reaches; at least start."""
        if self.value <= self.start:
            return self.start
        return max(self.start, self.value - (self.value - self.start) % self.increment - n * self.increment)


@dataclass
class Registry:
    """Sequences by name, for one driver. Reservation is one locked step."""

    sequences: dict[str, Sequence] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def reserve(self, name: str, n: int, seed: Callable[[], int] | None = None) -> Sequence:
        """n values of a sequence: the first is ``value`` of what comes back. ``seed`` gives the
        largest id in use when the sequence is met for the first time."""
        with self.lock:
            if name not in self.sequences:
                self.sequences[name] = Sequence(value=(seed() if seed else 0) + 1)
            s = self.sequences[name]
            first = Sequence(s.aligned(), s.increment, s.start)
            s.value = s.next_value(n)
            return first


def max_id(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def numbered(df: DataFrame, column: str, order: list[str] | None = None) -> DataFrame:
    """Rows with consecutive numbers from 0, in the order given or as they come.

    Not by one global window: rows are range-sorted in partitions, partitions are counted (one
    row each to the driver) and a number is the count of earlier partitions plus the place in
    the own one. The sorted rows are written in between, so that both passes, and a third after a
    lost executor, see the same partitions.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    # one row per partition: bounded by the partitions of the input
    offsets = df.sparkSession.createDataFrame(before, "__p long, __before long")
    out = placed.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.withColumn(column, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__p", "__before")


def assign_ids(df: DataFrame, column: str, first: int, increment: int = 1, order: list[str] | None = None) -> DataFrame:
    """Ids for records whose own is null or zero, in one block; others keep theirs."""
    kind = df.schema[column].dataType
    empty = is_zero(F.col(column), kind)
    fresh = numbered(df.where(empty), "__n", order)
    fresh = fresh.withColumn(column, (F.lit(first) + F.col("__n") * increment).cast(kind)).drop("__n")
    return df.where(~empty).unionByName(fresh.select(*df.columns))


def preset(df: DataFrame, column: str, strategy: str, registry: Registry, table: str, current: Callable[[], int], order: list[str] | None = None) -> DataFrame:
    """Presets by strategy: ``maxid`` goes on from the largest id in use, ``transient`` and
    ``udf`` reserve from the registry, ``ignore`` and ``undefined`` leave records as they are."""
    if strategy in ("ignore", "undefined"):
        return df
    n = df.where(is_zero(F.col(column), df.schema[column].dataType)).count()
    if not n:
        return df
    if strategy == "maxid":
        return assign_ids(df, column, current() + 1, order=order)
    if strategy not in ("transient", "udf"):
        raise ValueError(f"unknown preset strategy {strategy!r}")
    block = registry.reserve(f"{table}.{column}", n, current)
    return assign_ids(df, column, block.value, block.increment, order)
