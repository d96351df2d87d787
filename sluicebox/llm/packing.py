"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut where a full window fits; what remains of each
is one piece. The pieces of a batch go to k windows: every piece begins as a
partial partition (one window holds it, k-1 are empty); the two partial
partitions whose sums differ most are merged again and again, the fullest
window of one with the emptiest of the other, until one is left. Where a window
then exceeds its capacity, k rises and the batch is partitioned again.

Batches follow the order of the input within a Spark partition, so nothing is
shuffled and no task holds more than one batch.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
BATCH = 768
LARGEST = 512
END = 1
VOCABULARY = "byte_bpe_50k.json"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


@lru_cache(2)
def encoder(vocabulary: str):
    """text -> ids of the byte-level BPE in a tokenizers file.

    The file's own vocabulary drives tiktoken's merge loop, which gives the same ids several
    times faster; a probe compares the two before use. Texts that hold the string of an added
    token go to the tokenizer itself, which gives that token's id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    own = Tokenizer.from_file(path)
    # bytes as the printable characters of a byte-level vocabulary
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = own.get_added_tokens_decoder()
    ranks = {bytes(char[c] for c in token): i for token, i in own.get_vocab().items() if i not in added}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    marks = [t.content for t in added.values() if t.content]

    def exact(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    probe = "It's  a pr\u00fcbe,\n\n\twith 12345 mixed_TOKENS \u2014 \r\n   \u00f1and\u00fa \u6771\u4eac \U0001f600!  "
    if fast.encode_ordinary(probe) != exact(probe):
        return exact
    return lambda text: exact(text) if any(m in text for m in marks) else fast.encode_ordinary(text)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of positions in ``sizes`` with near-equal sums."""
    # a partial partition: windows by falling sum, each (sum, members); ties go by age
    heap = [(-size, age, [(size, [age])]) for age, size in enumerate(sizes)]
    heapq.heapify(heap)
    age = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # windows that are empty in a take b's fullest, and so on; lists hold filled windows only
        a = a + [(0, [])] * (k - len(a))
        b = [(0, [])] * (k - len(b)) + b[::-1]
        merged = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, b, strict=True)), key=lambda w: -w[0])
        low = merged[-1][0]
        while merged and not merged[-1][0]:
            merged.pop()
        heapq.heappush(heap, (low - merged[0][0] if merged else 0, age, merged))
        age += 1
    return [m for _, m in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing can fill without exceeding the capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


def cut(length: int, capacity: int, largest: int) -> list[tuple[int, int]]:
    """(start, length): full windows first, then the remainder in parts of ``largest`` and one
    shorter, which is what lets differencing even windows out."""
    full = length // capacity * capacity
    edges = [*range(0, full, capacity), *range(full, length, largest), length]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _packer(vocabulary: str, capacity: int, batch_size: int, largest: int, end: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        waiting: list[tuple] = []

        def settle():
            nonlocal sequence
            for members in windows([p[2] for p in waiting], capacity):
                total, offset = sum(waiting[i][2] for i in members), 0
                for i in members:
                    out.append((*waiting[i], sequence, offset, total))
                    offset += waiting[i][2]
                sequence += 1
            waiting.clear()

        def flush():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                for start, length in cut(len(ids), capacity, largest):
                    piece = (doc_id.as_py(), start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids))
                    if length == capacity:
                        out.append((*piece, sequence, 0, capacity))
                        sequence += 1
                    else:
                        waiting.append(piece)
                if len(waiting) >= batch_size:
                    settle()
                if len(out) >= 20_000:
                    yield flush()
        settle()
        if out:
            yield flush()

    return pack


def pack(docs: DataFrame, text: str = "text", id_column: str = "doc_id", capacity: int = WINDOW, vocabulary: str = VOCABULARY, batch: int = BATCH, largest: int = LARGEST, end: int = END) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens``.

    One row per piece. Every id of every document, with one end id, lies in exactly one piece;
    sequences hold at most ``capacity`` ids. Null and empty texts are the end id alone. Null ids
    and repeated rows are documents like any other, each row packed by itself. An empty table
    gives no rows; other columns are not read.
    """
    if capacity < 1 or not 1 <= largest <= capacity:
        raise ValueError("capacity and largest must be positive, largest at most capacity")
    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(_packer(vocabulary, capacity, batch, largest, end), _PIECES)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
