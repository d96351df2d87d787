"""Inserts in micro-batches: a stream of records lands by size or by age."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import Writer


@dataclass
class BatchConfig:
    """A batch ends after ``max_age``; ``batch`` rows go to one file. How many records a batch
    may hold is an option of the source (maxFilesPerTrigger, maxOffsetsPerTrigger, rowsPerSecond)."""

    max_age: str = "40 milliseconds"
    batch: int | None = None
    once: bool = False


def batched_insert(stream: DataFrame, writer: Writer, checkpoint: str, config: BatchConfig | None = None, done: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch is one insert, with ids assigned; ``done`` (batch, rows) follows it.

    ``await`` the query or process all that is there (``once``) to know that records landed.
    """
    config = config or BatchConfig()
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    if config.batch:
        writer.batch = config.batch

    def land(rows: DataFrame, batch: int) -> None:
        # a batch that is replayed after a failure has the same number and lands once
        written = writer.insert(rows, once=f"{name}-{batch}")
        if done:
            done(batch, written.affected)
        if written.records is not None:
            written.records.unpersist()

    out = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if config.once else out.trigger(processingTime=config.max_age)).start()
