"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into segments of SEGMENT bytes, half overlapping. A
segment of m bytes that occurs in a text with at most e edits shares at least
m + 1 - q (e + 1) q-grams with it, on diagonals that differ by at most e. Shared
q-grams are counted in overlapping bands of diagonals; bands that reach the
bound are regions, and a banded alignment decides each of them.

The benchmark is a stated query set. It is used in blocks of bounded size, each
of which is broadcast; documents are read once and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PIECE, powers, prefix_sums

Q = 10
SEGMENT = 100
EDITS = 0.08
SHORTEST = 24
BLOCK_BYTES = 4 << 20
_FOUND = "array<struct<item_id:long,start:int,end:int>>"


def normalise(text: str | None) -> bytes:
    """A-Z in lower case, runs of white space as one space, ends trimmed; UTF-8."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def allowed(m: int, q: int = Q, rate: float = EDITS) -> int:
    """The most edits up to the rate for which the lemma still demands a shared q-gram."""
    return max(0, min(int(rate * m), m // q - 1))


@dataclass
class Index:
    """Segments of one block of the benchmark, and where each q-gram stands in them."""

    items: np.ndarray
    segments: list[bytes]
    grams: np.ndarray
    offsets: np.ndarray
    places: np.ndarray
    sieve: np.ndarray


def gram_prints(data: np.ndarray, q: int) -> np.ndarray:
    if len(data) < q:
        return np.empty(0, np.uint64)
    sums = prefix_sums(data)
    return (sums[q:] - sums[:-q]) * powers(len(sums) - q, inverse=True)


def build(rows: list[tuple[int, str]], q: int = Q, segment: int = SEGMENT, shortest: int = SHORTEST) -> Index:
    """Items under ``shortest`` normalised bytes say too little to look for."""
    items, segments = [], []
    for item, text in rows:
        data = normalise(text)
        if len(data) < shortest:
            continue
        starts = list(range(0, max(1, len(data) - segment + 1), segment // 2))
        if len(data) > segment and starts[-1] + segment < len(data):
            starts.append(len(data) - segment)
        for a in starts:
            items.append(item)
            segments.append(data[a : a + segment])
    prints, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k, s in enumerate(segments):
        p = gram_prints(np.frombuffer(s, np.uint8), q)
        prints.append(p)
        places.append((k << 16) + np.arange(len(p)))
    prints, places = np.concatenate(prints), np.concatenate(places)
    order = np.argsort(prints, kind="stable")
    grams, offsets = np.unique(prints[order], return_index=True)
    sieve = np.zeros(1 << 22, bool)
    sieve[(grams >> np.uint64(42)).astype(np.int64)] = True
    return Index(np.array(items, np.int64), segments, grams, np.append(offsets, len(order)), places[order], sieve)


def banded_distance(pattern: bytes, text: bytes, edits: int) -> tuple[int, int]:
    """Least edits between the pattern and a part of the text, and where that part ends.

    The text is one region: diagonals 0..len(text)-len(pattern). Only those and ``edits`` on
    either side are computed, a row of the band at a time; more than ``edits`` means no match.
    """
    m, n = len(pattern), len(text)
    at = text.find(pattern)
    if at >= 0:
        return 0, at + m
    width = max(0, n - m) + 2 * edits + 1
    p, far = np.frombuffer(pattern, np.uint8), edits + 1
    t = np.full(n + 2 * (m + width) + 2, 0, np.int16) - 1
    pad = edits
    t[pad : pad + n] = np.frombuffer(text, np.uint8)
    band = np.arange(width)
    # cell k of row i is the text prefix of length i + k - edits
    row = np.where((band >= edits) & (band - edits <= n), 0, far)
    for i in range(1, m + 1):
        ends = i + band - edits
        match = t[i - 1 : i - 1 + width] == p[i - 1]
        new = np.where(match, row, row + 1)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((ends >= 0) & (ends <= n), new, far)
        new = np.minimum.accumulate(new - band) + band
        row = np.minimum(np.where((ends >= 0) & (ends <= n), new, far), far)
        if row.min() >= far:
            return far, -1
    best = int(row.argmin())
    return int(row[best]), m + best - edits


def search(texts: list[str | None], index: Index, q: int = Q, rate: float = EDITS) -> list[list[tuple[int, int, int]]]:
    """Per text: (item, start, end) of verified regions, in bytes of the normalised text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not index.segments:
        return found
    data = [normalise(t) for t in texts]
    first = 0
    while first < len(data):
        last, size = first, 0
        while last < len(data) and (size == 0 or size + len(data[last]) < PIECE):
            size += len(data[last]) + 1
            last += 1
        starts = np.cumsum([0] + [len(d) + 1 for d in data[first:last]])
        joined = b"\n".join(data[first:last])
        # long texts in overlapping pieces, so that arrays stay small
        step, overlap = 2 * PIECE, 4 * SEGMENT
        for begin in range(0, max(1, len(joined)), step):
            _search_piece(joined[begin : begin + step + overlap], begin, starts, first, index, q, rate, found)
        first = last
    return [sorted(set(f)) for f in found]


def _search_piece(joined: bytes, begin: int, starts: np.ndarray, first: int, index: Index, q: int, rate: float, found: list) -> None:
    prints = gram_prints(np.frombuffer(joined, np.uint8), q)
    at = np.flatnonzero(index.sieve[(prints >> np.uint64(42)).astype(np.int64)])
    if not len(at):
        return
    g = np.minimum(np.searchsorted(index.grams, prints[at]), len(index.grams) - 1)
    sure = index.grams[g] == prints[at]
    at, g = at[sure], g[sure]
    n = index.offsets[g + 1] - index.offsets[g]
    where = np.repeat(index.offsets[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = index.places[where]
    segment, diagonal = place >> 16, np.repeat(at, n) - (place & 0xFFFF)
    lengths = np.array([len(s) for s in index.segments])
    edits = np.array([allowed(m, q, rate) for m in lengths])
    e = edits[segment]
    # bands of 2(e+1) diagonals, every e+1: each diagonal lies in two
    band = (diagonal + (1 << 20)) // (e + 1)
    keys = np.concatenate([segment << 40 | band, segment << 40 | (band - 1)])
    keys, counts = np.unique(keys, return_counts=True)
    seg = keys >> 40
    enough = counts >= np.maximum(1, lengths[seg] + 1 - q * (edits[seg] + 1))
    for k, s in zip(keys[enough] & ((1 << 40) - 1), seg[enough], strict=True):
        e, m = int(edits[s]), int(lengths[s])
        low = int(k) * (e + 1) - (1 << 20)
        doc = int(np.searchsorted(starts, begin + max(0, low + e + 1), side="right")) - 1
        for d in {doc, max(0, doc - 1), min(len(starts) - 2, doc + 1)}:
            a = max(low - e, int(starts[d]) - begin, 0)
            b = min(low + 2 * (e + 1) + m + e, int(starts[d + 1]) - 1 - begin, len(joined))
            if b - a < m - e:
                continue
            distance, end = banded_distance(index.segments[s], joined[a:b], e)
            if distance <= e:
                stop = begin + a + end - int(starts[d])
                found[first + d].append((int(index.items[s]), max(0, stop - m), stop))


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Index]:
    """One index per block of about ``block_bytes`` of benchmark text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [build(sorted((r.item_id, r.text) for r in dealt.where(F.col("block") == b).collect())) for b in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with an array of (item_id, start, end), in bytes of the normalised text.

    A text leaks an item when a segment of SEGMENT bytes of it, or the whole of a shorter one,
    occurs with at most EDITS edits a byte. Null, empty and blank texts leak nothing; items
    that are null or shorter than SHORTEST are not looked for; an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    parts = []
    for index in blocks_of(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf(_FOUND)
        def leaks(texts, shared=shared):
            import pandas as pd

            values, out = texts.tolist(), []
            for i in range(0, len(values), 1000):
                out += search(values[i : i + 1000], shared.value)
            return pd.Series([[{"item_id": a, "start": b, "end": c} for a, b, c in f] for f in out], index=texts.index, dtype=object)

        parts.append(leaks(F.col(text).cast("string")))
    return docs.withColumn(into, parts[0] if len(parts) == 1 else F.array_sort(F.flatten(F.array(*parts))))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns."""
    mark = "__leaks"
    return find_leaks(docs, benchmark, into=mark).where(F.size(mark) == 0).drop(mark)


def op2_qgram_lemma(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_regions"), F.array_join(items, ",").alias("items"))
