"""Exact duplicates by deterministic block naming.

A text is cut into blocks of BLOCK bytes. The distinct blocks are sorted and
numbered; a document becomes a sequence of numbers. Adjacent pairs of numbers
are sorted and numbered in turn, until each document is one number. Two
documents of one level carry the same number exactly when their texts agree.

No number rests on a hash. The content of a block crosses the network once, to
be numbered, after copies within a task are merged. The numbers go back to the
documents by a 128-bit locator, whose uniqueness among the distinct blocks is
verified; blocks whose locators clash (none, in practice) go back by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import lowered

BLOCK = 8192
_BLOCKS = "doc_id long, sha binary, at long, n long, spot binary, block binary"


def _cut(block: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = lowered(text)
                    sha = hashlib.sha256(data).digest()
                    n = max(1, -(-len(data) // block))
                    for at in range(n):
                        piece = data[at * block : (at + 1) * block]
                        rows.append((doc_id, sha, at, n, hashlib.blake2b(piece, digest_size=16).digest(), piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    names=["doc_id", "sha", "at", "n", "spot", "block"],
                )

    return cut


def _numbered(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows with consecutive numbers in sorted order within each partition: the
    number's high bits are the partition, so it is unique without a global sort."""
    return keys.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, text: str = "text", id_column: str = "doc_id", block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, sha, n_rows, level, name``: one row per distinct (id, text).

    (level, name) is equal for two rows exactly when their texts are, after lower-casing A-Z.
    Null texts count as empty. Null ids are ids like any other. Rows that repeat an id and its
    text are one row with ``n_rows`` counting them; rows that share an id only stay apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "blocks")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = source.mapInArrow(_cut(block), _BLOCKS)

    named = scratch.keep(_numbered(cut.select("spot", "block"), ["spot", "block"]).select("spot", "name"), "named")
    clashing = scratch.keep(named.groupBy("spot").count().where("count > 1").select("spot"), "clashing")
    level = cut.drop("block").join(named.join(clashing, "spot", "left_anti"), "spot")
    if not clashing.isEmpty():
        blocks = cut.join(clashing, "spot", "left_semi")
        apart = scratch.keep(_numbered(blocks.select("spot", "block"), ["spot", "block"]).withColumn("name", -1 - F.col("name")), "apart")
        level = level.unionByName(blocks.join(apart, ["spot", "block"]).drop("block"))
    level = scratch.keep(level.groupBy("doc_id", "sha", "at", "n").agg(F.max("name").alias("name"), F.count("*").alias("n_rows")), "level0")
    done = level.where("n = 1").select("doc_id", "sha", "n_rows", F.lit(0).alias("level"), "name")
    most = level.agg(F.max("n")).first()[0] or 1

    depth = 0
    level = level.where("n > 1")
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        # an absent right half is null: names may be any number
        pairs = level.groupBy("doc_id", "sha", F.expr("at div 2").alias("at"), F.expr("(n + 1) div 2").alias("n")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("b"),
            F.max("n_rows").alias("n_rows"),
        )
        pairs = scratch.keep(pairs, f"pairs{depth}")
        names = scratch.keep(_numbered(pairs.select("a", "b"), ["a", "b"]), f"names{depth}")
        level = scratch.keep(pairs.alias("p").join(names.alias("q"), F.expr("p.a = q.a and p.b <=> q.b")).select("doc_id", "sha", "at", "n", "name", "n_rows"), f"level{depth}")
        done = done.unionByName(level.where("n = 1").select("doc_id", "sha", "n_rows", F.lit(depth).alias("level"), "name"))
        level = level.where("n > 1")
    return done


def exact_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Of equal texts the largest id stays (nulls count as smallest). Of rows that repeat an id and
    its text, one is kept. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    ids = identities(docs, text, id_column, block, scratch)
    # written first, so that the join below has two plain exchanges and Spark may split a large group
    groups = scratch.keep(ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size")), "groups")
    out = ids.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op8_block_naming(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op8_block_naming": """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
"""
}
