"""Documents with similar sets of word n-grams: a blocked sparse matrix product.

Rows of the incidence matrix are distinct shingle sets ("nodes": exact copies are
one), columns are shingles. Columns are dealt to blocks by hash; a block
multiplies its slice of the matrix with its transpose, which counts overlaps of
pairs of nodes, and the counts of all blocks are added up.

Only a set's prefix enters the product: of n shingles the first
n - ceil(0.8 n) + 1 in one fixed order, frequent ones last. Sets with a Jaccard
index of 0.8 share an element there, and a bound that follows from both sizes
says how many; pairs with fewer are discarded, the others are verified on the
whole sets. Nothing is approximate.

Columns with very many nodes (one group of thousands of near copies) are not
multiplied out column by column. Their nodes are first linked through one of
them. Nodes that this leaves in different components are then compared group by
group, in tiles of bounded size whose product counts whole intersections at
once; a tile returns only as many links as connect its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import fresh, slices
from .pairs import PRODUCT, filter_of, maybe_in, multiply, of_roots, settle, split, tiles
from .scratch import Scratch
from .words import batch_words, lowered, mix, shingles

WIDTH = 5
#: Columns with more nodes are linked through one node first.
LONG = 24
#: Columns found in so many documents are frequent; the FREQUENT most frequent come last in the
#: order. Both only steer the order, never the result.
OFTEN, FREQUENT = 24, 1_000_000
#: Share of the hash range over which columns are counted: what prefixes draw on.
_RANGE = int(0.24 * 2**64)
_CHUNK, _BYTES = 1000, 4 << 20


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    """Per chunk of documents: the chunk and its sets."""
    for part in slices(batches, rows=_CHUNK, size=_BYTES):
        texts = [lowered(t) for t in part.column(1).to_pylist()]
        sets: list[np.ndarray] = []
        for _, _, words, counts in batch_words(texts):
            at = 0
            for n in counts:
                sets.append(shingles(words[at : at + n], width))
                at += n
        yield part, sets


def node_of(s: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


def prefix_length(n: int) -> int:
    return n - (8 * n + 9) // 10 + 1


def early_length(n: int) -> int:
    """How much of a set's order must meet a set that is larger by more than a ninth of it: such
    a set holds more than 0.938 of the smaller one."""
    return n - -(-938 * n // 1000) + 1


def _count_columns(width: int, blocks: int):
    """Rows of documents (block null) and of counted columns (block set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for part, sets in _sets(batches, width):
            out = [(i, mark, node_of(s), len(s), None, None, None) for i, mark, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets, strict=True)]
            low = [s[: np.searchsorted(s, np.uint64(_RANGE))] for s in sets]
            keys, counts = np.unique(np.concatenate(low) if low else np.empty(0, np.uint64), return_counts=True)
            # blocks of the counted range only
            for block, at in split(keys * np.uint64(4), blocks):
                out.append((None, None, None, None, block, keys[at].tobytes(), counts[at].astype(np.uint32).tobytes() if counts[at].max() > 1 else b""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _frequent(often: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(block["keys"]), np.uint64)
        counts = np.concatenate([np.frombuffer(c, np.uint32) if c else np.ones(len(k) // 8, np.uint32) for k, c in zip(block["keys"], block["counts"], strict=True)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts.astype(np.int64), start)
        keep = total >= often
        return pd.DataFrame({"key": keys[start][keep].view(np.int64), "df": total[keep]})

    return run


def _postings(width: int, blocks: int, frequent: np.ndarray):
    """Prefixes, dealt to blocks. Frequent columns get blocks of their own (negative), salted."""
    schema = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        for turn, (_, sets) in enumerate(_sets(batches, width)):
            parts: list[list[np.ndarray]] = [[], []]
            owners: list[list[tuple[int, int, int, int]]] = [[], []]
            seen = set()
            for s in sets:
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                p = prefix_length(len(s))
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    hot = frequent[at] == s
                    rare = s[~hot][:p]
                    both = (rare, s[hot][: p - len(rare)])
                else:
                    both = (s[:p], s[:0])
                soon = early_length(len(s))
                for k in (0, 1):
                    if len(both[k]):
                        parts[k].append(both[k])
                        owners[k].append((node, len(s), len(both[k]), min(soon, len(both[k]))))
                        soon -= min(soon, len(both[k]))
            out = []
            for k in (0, 1):
                if not parts[k]:
                    continue
                keys = np.concatenate(parts[k])
                node, size, times, soon = np.array(owners[k], np.int64).T
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                marked = np.repeat(size, times) | (place < np.repeat(soon, times)).astype(np.int64) << 31
                order = np.argsort(keys, kind="stable")
                keys, nodes, sizes = keys[order], np.repeat(node, times)[order], marked[order].astype(np.uint32)
                if k:
                    block = -1 - ((keys % np.uint64(blocks)).astype(np.int64) + turn % 7) % blocks
                    order = np.argsort(block, kind="stable")
                    keys, nodes, sizes, block = keys[order], nodes[order], sizes[order], block[order]
                    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
                    cuts = [(int(block[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                else:
                    cuts = split(keys, blocks)
                out += [(b, keys[at].tobytes(), nodes[at].tobytes(), sizes[at].tobytes()) for b, at in cuts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


#: Whether the overlap of two prefixes allows a Jaccard index of 0.8.
_ENOUGH = "{} >= ((size_a + size_b) * 4 + 8) div 9 - (greatest(size_a, size_b) * 8 + 9) div 10 + 1"


def _whole_sets(width: int, bits):
    schema = pa.schema([("node", pa.int64()), ("s", pa.binary())])

    def run(batches):
        own = bits.value
        for _, sets in _sets(batches, width):
            nodes = np.array([node_of(s) for s in sets], np.int64)
            ok = maybe_in(own, nodes.view(np.uint64))
            found = {int(nodes[k]): sets[k] for k in np.flatnonzero(ok) if len(sets[k])}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], schema=schema)

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = int((y[at] == x).sum())
            keep.append(100 * same >= 80 * (len(x) + len(y) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(source: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, s``: the whole sets of some nodes, computed anew from the texts."""
    bits = source.sparkSession.sparkContext.broadcast(filter_of(nodes))
    return source.mapInArrow(_whole_sets(width, bits), "node long, s binary").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("s").alias("s"))


def _verify(source: DataFrame, pairs: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are similar."""
    ends = scratch.keep(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("node")), f"{name}_ends")
    sets = scratch.keep(_sets_of(source, ends, width), f"{name}_sets")
    out = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    links = scratch.keep(out.mapInArrow(_linked, "a long, b long"), name)
    scratch.drop(f"{name}_sets", f"{name}_ends")
    return links


def forest(n: int, links: np.ndarray) -> np.ndarray:
    """Places of the links that connect what earlier ones leave apart."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k, (a, b) in enumerate(links.tolist()):
        a, b = top(a), top(b)
        if a != b:
            up[b] = a
            keep.append(k)
    return np.array(keep, np.int64)


def multiply_sets(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections: a product of two incidence matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    rows = np.repeat(np.arange(len(left)), [len(s) for s in left])
    cols = np.repeat(np.arange(len(right)), [len(s) for s in right])
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    at_a, at_b = np.minimum(np.searchsorted(common, a), len(common) - 1), np.minimum(np.searchsorted(common, b), len(common) - 1)
    in_a, in_b = common[at_a] == a, common[at_b] == b
    rows, at_a, cols, at_b = rows[in_a], at_a[in_a], cols[in_b], at_b[in_b]
    for begin in range(0, len(common), chunk):
        width = min(chunk, len(common) - begin)
        m, n = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        here = (at_a >= begin) & (at_a < begin + width)
        m[rows[here], at_a[here] - begin] = 1
        here = (at_b >= begin) & (at_b < begin + width)
        n[cols[here], at_b[here] - begin] = 1
        out += m @ n.T
    return out


def _tile(tile: pd.DataFrame) -> pd.DataFrame:
    """Links between the nodes of a tile, as many as it takes to connect what they connect."""
    left, right = tile[tile["left"]], tile[~tile["left"]]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    x, y = ([np.frombuffer(s, np.uint64) for s in t["s"]] for t in (left, right))
    n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    same = multiply_sets(x, y)
    ok = 100 * same >= 80 * (n[:, None] + m[None, :] - same)
    ok &= left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
    i, j = np.nonzero(ok)
    nodes, index = np.unique(np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()]), return_inverse=True)
    keep = forest(len(nodes), np.stack([index[: len(left)][i], index[len(left) :][j]], 1)) if len(i) else np.empty(0, np.int64)
    return pd.DataFrame({"a": left["node"].to_numpy()[i[keep]], "b": right["node"].to_numpy()[j[keep]]})


def _close(source: DataFrame, width: int, scratch: Scratch):
    """Links between nodes that share long columns and differ by at most a tenth in size.

    Such nodes share more than 0.04 of their size in prefix columns, so each node may leave out
    the last of its columns' centres that hold no more than that together. Nodes with a centre
    in common form a group, and groups are multiplied out in tiles, on whole sets.
    """

    def run(entries: DataFrame, roots: DataFrame) -> DataFrame:
        weights = entries.groupBy("node", F.col("centre.node").alias("c")).agg(F.count("*").alias("weight"), F.first("size").alias("size"))
        weights = scratch.keep(weights, "weights")
        popular = scratch.keep(weights.groupBy("c").agg(F.count("*").alias("popular")), "popular")
        # a node has at most as many centres as prefix columns
        tail = Window.partitionBy("node").orderBy("popular", F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        needed = weights.join(popular, "c").withColumn("rest", F.sum("weight").over(tail)).where("rest > floor(size * 19 * 4 / 90D - size * 8 / 10D)")
        owned = scratch.keep(needed.join(of_roots(roots, "node", "root"), "node", "left").select("c", "node", F.coalesce("root", "node").alias("root")), "owned")
        shares = owned.groupBy("c", "root").agg(F.count("*").alias("n"))
        main = shares.groupBy("c").agg(F.count("*").alias("roots"), F.sum("n").alias("members"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
        groups = scratch.keep(owned.join(scratch.keep(main.drop("roots"), "mains"), "c"), "groups")
        nodes = scratch.keep(groups.select("node").distinct(), "group_nodes")
        sets = scratch.keep(_sets_of(source, nodes, width), "group_sets")
        return tiles(groups.join(sets, "node"), ["s"]).groupBy("c", "i", "j").applyInPandas(_tile, "a long, b long").distinct()

    return run


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", width: int = WIDTH, longest: int = LONG, often: int = OFTEN) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, root``, one row per row of ``docs``.

    Two documents link when their sets of ``width``-word shingles have a Jaccard index of 0.8 or
    more; component_id is the smallest id that links reach. Fewer words than ``width`` make one
    shingle; null, empty and blank texts have none, link with nothing and are alone. Repeated
    rows are linked like any equal texts. Null ids count as no id in the smallest; a component
    of null ids only has a null component_id. Other columns are not read. ``mark`` is a
    hash of the text, ``root`` a number of the component (null where there are no words).
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # a block for every 13 MB of text, so that blocks have one size whatever the documents' lengths
    blocks = int(max(64, (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (13 << 20)))

    counted = scratch.keep(source.withColumn("mark", F.xxhash64("text")).mapInArrow(_count_columns(width, blocks), "doc_id long, mark long, node long, n long, block int, keys binary, counts binary"), "counted")
    documents = scratch.keep(counted.where("block is null").select("doc_id", "mark", "node", "n"), "documents")
    often_found = counted.where("block is not null").groupBy("block").applyInPandas(_frequent(often), "key long, df long")
    # at most FREQUENT numbers
    frequent = np.sort(often_found.orderBy(F.desc("df"), "key").limit(FREQUENT).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    scratch.drop("counted")

    postings = source.select("doc_id", "text").mapInArrow(_postings(width, blocks, frequent), "block int, keys binary, nodes binary, sizes binary")
    product = scratch.keep(postings.groupBy("block").applyInPandas(multiply(longest), PRODUCT), "product")

    roots = settle(product, _ENOUGH, lambda pairs, name: _verify(source, pairs, width, scratch, name), scratch, _close(source, width, scratch))
    whole = documents.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return whole.join(least, "root", "left").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("root"))


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the smallest id (null ids
    come last; ties go by a hash of the text). Of rows that repeat an id and its text one
    stays. Rows without words are alone in their components and stay, repeats apart."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = scratch.keep(near_duplicates(docs, text, id_column), "found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")
    keep = found.where("root is not null").groupBy("root").agg(first).select("first.doc_id", "first.mark")
    keep = scratch.keep(keep.unionByName(found.where("root is null").select("doc_id", "mark").distinct()), "keep")

    mark, doc, other = fresh(docs.columns, "mark", "doc", "other")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    kept = marked.join(keep.withColumnsRenamed({"doc_id": doc, "mark": other}), F.col(id_column).cast("long").eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(other)), "left_semi")
    if not found.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_column, mark])
    return kept.drop(mark)


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = {
    "op9_ngram_jaccard": """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
links as (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
from sets s left join reach r on r.a = s.doc_id group by s.doc_id, s.s
"""
}
