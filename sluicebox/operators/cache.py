"""A cache of query results as parquet, with time to live, checks of what was asked, and buckets
per key."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sql(sql: str) -> str:
    """White space as one space and lower case, outside literals."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\")", sql.strip())
    return "".join(p if i % 2 else re.sub(r"\s+", " ", p).lower() for i, p in enumerate(parts))


def fingerprint(sql: str, args: Any = None) -> str:
    return hashlib.sha256(json.dumps([normal_sql(sql), args], default=str, sort_keys=True).encode()).hexdigest()


@dataclass
class Stats:
    """How a read was answered: warm (by key), lazy (a whole entry), write or none."""

    kind: str = "none"
    key: str = ""
    hits: int = 0
    misses: int = 0
    expires: float = 0.0
    error: str | None = None


@dataclass
class Breaker:
    """Stops use of the cache after ``limit`` failures, for a while."""

    limit: int = 5
    reset_after: float = 60.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    since: float = 0.0

    @property
    def closed(self) -> bool:
        if self.failures >= self.limit and self.clock() - self.since > self.reset_after:
            self.failures = 0
        return self.failures < self.limit

    def failed(self) -> None:
        self.failures, self.since = self.failures + 1, self.clock()


@dataclass
class QueryCache:
    """Entries live in ``folder/<fingerprint>``: a parquet data folder and a header that says
    SQL, arguments, schema, signature and when it expires. An entry counts only if all agree."""

    spark: SparkSession
    folder: str
    ttl: float = 60.0
    signature: str = ""
    clock: Callable[[], float] = time.time
    breaker: Breaker = field(default_factory=Breaker)
    stats: Stats = field(default_factory=Stats)
    _busy: set = field(default_factory=set)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _header(self, entry: str) -> dict | None:
        p, fs = self._fs(f"{entry}/header")
        if not fs.exists(p):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{entry}/header", wholetext=True).collect()))

    def _valid(self, header: dict | None, sql: str, args: Any, schema: T.StructType | None) -> bool:
        return bool(header) and header["expires"] > self.clock() and header["signature"] == self.signature and header["sql"] == normal_sql(sql) and header["args"] == json.dumps(args, default=str) and (schema is None or header["schema"] == schema.json())

    def delete(self, entry: str) -> None:
        p, fs = self._fs(entry)
        fs.delete(p, True)

    def _store(self, entry: str, sql: str, args: Any, df: DataFrame, by: str | None) -> dict:
        """Data and header go to a new folder, which is then renamed into place."""
        staged = f"{entry}-{uuid.uuid4().hex}"
        header = {"sql": normal_sql(sql), "args": json.dumps(args, default=str), "schema": df.schema.json(), "signature": self.signature, "expires": self.clock() + self.ttl, "by": by}
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(f"{staged}/data")
        self.spark.createDataFrame([(json.dumps(header),)], "v string").coalesce(1).write.text(f"{staged}/header")
        self.delete(entry)
        source, fs = self._fs(staged)
        fs.rename(source, self._fs(entry)[0])
        return header

    def _open(self, entry: str, header: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(header["schema"]))
        return self.spark.read.schema(schema).parquet(f"{entry}/data").select(*[f"`{n}`" for n in schema.names])

    def read(self, query, refresh: bool = False, by: str | None = None) -> DataFrame:
        """The query's rows, from its entry if that is valid; else they are computed and stored.

        A second reader of an entry that is being written goes past the cache. Where the cache
        itself fails, the rows come from the query, and the breaker counts.
        """
        sql, args = query.sql, query.args
        key = fingerprint(sql, args)
        entry = f"{self.folder.rstrip('/')}/{key}"
        self.stats = Stats(key=key)
        fresh = query.on(self.spark)
        if not self.breaker.closed:
            return fresh
        with self._lock:
            if key in self._busy:
                return fresh
            self._busy.add(key)
        try:
            header = None if refresh else self._header(entry)
            if self._valid(header, sql, args, fresh.schema):
                self.stats = Stats("warm" if header["by"] else "lazy", key, hits=1, expires=header["expires"])
            else:
                header = self._store(entry, sql, args, fresh, by if by in fresh.columns else None)
                self.stats = Stats("write", key, misses=1, expires=header["expires"])
            return self._open(entry, header)
        except Exception as e:  # noqa: BLE001 - a broken cache must not break the read
            self.breaker.failed()
            self.stats = Stats(key=key, error=type(e).__name__)
            return fresh
        finally:
            with self._lock:
                self._busy.discard(key)

    def warm(self, query, by: str) -> int:
        """Stores the query's rows partitioned by a column, so that reads of some keys prune to
        their partitions; rows without a key are left out. Returns how many keys there are."""
        df = query.on(self.spark)
        name = next((c for c in df.columns if c.lower() == by.lower()), by)
        df = df.where(F.col(name).isNotNull())
        self._store(f"{self.folder.rstrip('/')}/{fingerprint(query.sql, query.args)}", query.sql, query.args, df, name)
        return df.select(name).distinct().count()


def index_by(df: DataFrame, column: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows in one bucket per key, sorted; rows without a key are skipped. Without a column all
    rows are one bucket, which is only for results that one task can hold."""
    rest = [c for c in df.columns if c != column]
    bucket = F.array_sort(F.collect_list(F.struct(*(order or []), *[c for c in rest if c not in (order or [])]))).alias("bucket")
    if column is None:
        return df.agg(bucket, F.count("*").alias("n"))
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(bucket, F.count("*").alias("n"))
