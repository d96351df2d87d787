"""Links among the entries of a sparse matrix's columns, without all pairs of a column.

Shared by the operators that look for similar sets or lines: both deal entries
(column, node, size) to blocks, multiply the blocks out, and settle which nodes
belong together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch

FILTER_BITS = 26
PRODUCT = "kind int, a long, b long, size_a long, size_b long, overlap long"


def split(keys: np.ndarray, blocks: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array by block; blocks are equal parts of the hash range."""
    block = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(keys) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(block[a]), slice(int(a), int(b))


def multiply(longest: int):
    """One block of the product. kind 0: a pair of nodes with its overlap here; kind 1: an entry
    (a: column, b: node) of a column too long to multiply out, its overlap 1 where it is marked
    early (the top bit of its size)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(block["keys"]), np.uint64)
        nodes = np.frombuffer(b"".join(block["nodes"]), np.int64)
        sizes = np.frombuffer(b"".join(block["sizes"]), np.uint32)
        early, sizes = sizes >> 31 > 0, (sizes & np.uint32(0x7FFFFFFF)).astype(np.int64)
        order = np.lexsort((nodes, keys))
        keys, nodes, sizes, early = keys[order], nodes[order], sizes[order], early[order]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes, sizes, early = keys[first], nodes[first], sizes[first], early[first]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.concatenate([start, [len(keys)]]))
        hot = bool(block["block"].iloc[0] < 0)
        out = []
        long = np.repeat(length > (0 if hot else longest), length)
        if long.any():
            out.append(pd.DataFrame({"kind": 1, "a": keys[long].view(np.int64), "b": nodes[long], "size_a": sizes[long], "size_b": 0, "overlap": early[long].astype(np.int64)}))
        left, right = [], []
        for n in range(2, longest + 1) if not hot else ():
            rows = start[length == n]
            if len(rows):
                i, j = np.triu_indices(n, 1)
                left.append((rows[:, None] + i).ravel())
                right.append((rows[:, None] + j).ravel())
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            near = 10 * np.minimum(sizes[i], sizes[j]) >= 8 * np.maximum(sizes[i], sizes[j])
            i, j = i[near], j[near]
            if len(i):
                order = np.lexsort((nodes[j], nodes[i]))
                i, j = i[order], j[order]
                edge = np.flatnonzero(np.concatenate([[True], (nodes[i][1:] != nodes[i][:-1]) | (nodes[j][1:] != nodes[j][:-1])]))
                times = np.diff(np.concatenate([edge, [len(i)]]))
                i, j = i[edge], j[edge]
                out.append(pd.DataFrame({"kind": 0, "a": nodes[i], "b": nodes[j], "size_a": sizes[i], "size_b": sizes[j], "overlap": times}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in PRODUCT.split(", ")})

    return run


def filter_of(nodes: DataFrame, bits: int = FILTER_BITS, column: str = "node") -> np.ndarray:
    """A Bloom filter of fixed size (2**bits bits) of a column of mixed 64-bit numbers.

    Spark builds it in pieces of 4 KB, one per row that comes to the driver.
    """
    mask = (1 << bits) - 1
    spots = nodes.select(F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(mask)))).alias("spot"))

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << 15, bool)
        own[rows["spot"].to_numpy(np.int64) & 0x7FFF] = True
        return pd.DataFrame({"at": rows["spot"].iloc[:1].to_numpy(np.int64) >> 15, "bits": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in spots.distinct().groupBy(F.shiftright("spot", 15)).applyInPandas(piece, "at long, bits binary").collect():
        out[row.at << 12 : row.at + 1 << 12] = np.frombuffer(row.bits, np.uint8)
    return out.view(np.uint64)


def maybe_in(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which numbers may be in a filter; those that are not surely are not."""
    mask = np.uint64(len(bits) * 64 - 1)
    ok = np.ones(len(spots), bool)
    for x in (spots & mask, (spots >> np.uint64(32)) & mask):
        ok &= (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) == 1
    return ok


def of_roots(roots: DataFrame, column: str, name: str) -> DataFrame:
    return roots.select(F.col("node").alias(column), F.col("root").alias(name))


def first_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """One pair for each node: with the partner that it overlaps most, and with the node that
    most of its long columns name."""
    both = pairs.select("a", "b", "overlap").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "overlap"))
    some = both.groupBy("a").agg(F.max_by("b", F.struct("overlap", "b")).alias("b"))
    named = entries.where("centre.node <> node and 10 * least(centre.size, size) >= 8 * greatest(centre.size, size)").groupBy(F.col("node").alias("a"), F.col("centre.node").alias("b")).agg(F.count("*").alias("n"))
    named = named.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    return some.unionByName(named).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def crossing_pairs(entries: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs between components that share long columns. Only nodes outside a column's main
    component are joined with its others."""
    owned = entries.join(of_roots(roots, "node", "root"), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    shares = owned.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = shares.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
    split_ = scratch.keep(owned.join(main.select("key", "main"), "key"), "split")
    minor = split_.where("root <> main").select("key", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"))
    other = split_.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), (F.col("root") == F.col("main")).alias("major"))
    found = minor.join(other, "key").where("root_a <> root_b and (major or a < b) and 10 * least(size_a, size_b) >= 8 * greatest(size_a, size_b)")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unequal_pairs(entries: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs between components whose sizes differ by more than a tenth and that share a long
    column which stands early in the smaller one."""
    owned = entries.join(of_roots(roots, "node", "root"), "node", "left").select("key", "node", "size", "early", F.coalesce("root", "node").alias("root"))
    owned = scratch.keep(owned, "owned_entries")
    less = owned.where("early").select("key", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"))
    more = owned.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"))
    found = less.join(more, "key").where("root_a <> root_b and 10 * size_a < 9 * size_b and 10 * size_a >= 8 * size_b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


TILE = 1024


def tiles(groups: DataFrame, columns: list[str]) -> DataFrame:
    """``c, i, j, left, node, root`` and columns: nodes of groups dealt to tiles: every node outside its group's main component meets every
    other node of the group in one tile of at most about TILE x TILE.

    ``groups``: c, node, root, main, members and ``columns``. A group of m nodes sends a node to
    m / TILE tiles, and no tile grows with its group.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("members") / TILE)).cast("int")
    dealt = groups.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    every = F.explode(F.expr("sequence(0, n - 1)"))
    left = dealt.where("root <> main").withColumn("j", every).select("c", F.col("own").alias("i"), "j", F.lit(True).alias("left"), "node", "root", *columns)
    right = dealt.withColumn("i", every).select("c", "i", F.col("own").alias("j"), F.lit(False).alias("left"), "node", "root", *columns)
    return left.unionByName(right)


def settle(product: DataFrame, enough: str, verify: Callable[[DataFrame, str], DataFrame], scratch: Scratch, close: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node, root`` of the components of verified links, from the product of all blocks.

    ``enough`` is SQL with a place for the overlap of a pair: whether size_a and size_b allow a
    link. ``verify`` (pairs, name) returns the pairs that link; it sees one pair for each node
    first, then only pairs that this leaves in different components. ``close`` (entries, roots)
    gives the links that long columns hold between nodes of nearly one size; then only pairs of
    unequal sizes are listed and verified. Without it all pairs between components are.
    """
    entries = product.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("size_a").alias("size"), (F.col("overlap") > 0).alias("early")).distinct()
    lengths = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("size", "node")).alias("centre")).where("n > 1")
    entries = scratch.keep(entries.join(scratch.keep(lengths.select("key", "centre"), "lengths"), "key"), "entries")
    in_long = entries.groupBy("node").agg(F.count("*").alias("in_long"))

    pairs = product.where("kind = 0").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    pairs = pairs.join(in_long.select(F.col("node").alias("a"), F.col("in_long").alias("long_a")), "a", "left").join(in_long.select(F.col("node").alias("b"), F.col("in_long").alias("long_b")), "b", "left")
    # overlaps within long columns are not counted yet: at most so many
    pairs = scratch.keep(pairs.where(enough.format("overlap + least(coalesce(long_a, 0), coalesce(long_b, 0))")).select("a", "b", "overlap"), "pairs")

    first = scratch.keep(first_pairs(pairs, entries), "first")
    links = verify(first, "links1")
    roots = scratch.keep(connected(links, scratch, "roots1"), "roots_first")
    if close:
        links = links.unionByName(scratch.keep(close(entries, roots), "close"))
        roots = scratch.keep(connected(links, scratch, "roots2"), "roots_close")

    open_pairs = pairs.join(of_roots(roots, "a", "root_a"), "a", "left").join(of_roots(roots, "b", "root_b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    crossing = unequal_pairs(entries, roots, scratch) if close else crossing_pairs(entries, roots, scratch)
    second = scratch.keep(open_pairs.unionByName(crossing).distinct().join(first, ["a", "b"], "left_anti"), "second")
    if not second.isEmpty():
        links = links.unionByName(verify(second, "links2"))
        roots = scratch.keep(connected(links, scratch, "roots3"), "roots_last")
    return roots.select("node", "root")
