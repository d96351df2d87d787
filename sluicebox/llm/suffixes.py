"""Repeated byte strings by sorting sampled suffixes.

Sorting every suffix of the corpus would move each byte many times over. Here
suffixes are sampled by content: in every WIDTH-byte string the suffix with the
least fingerprint of its first LEAD bytes is an anchor, so equal strings have
equal anchors at equal places. Anchors are range-partitioned by the fingerprint
of their leading bytes and each range is sorted by several keys in turn: the
leading bytes, then all that surrounds the anchor within reach of a string that
holds it, then document and place. Neighbours in that order are compared.

An anchor whose whole surroundings occurred before makes all its strings
repeats. Where only part of the surroundings repeats (the edges of a repeat),
the strings themselves are compared, partitioned by range and sorted likewise.
All copies within a chunk of a task are settled there, so a passage that very
many documents hold sends one row per chunk.

Which anchors have a lead that occurs again, and which need their strings
compared, is sent back to the documents that hold them: both are dealt to
buckets, and a bucket of documents is read with its own anchors only. Nothing
is broadcast, and what is sent grows with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import split
from .scratch import Scratch
from .words import fingerprints, mix, powers, prefix_sums

WIDTH = 100
LEAD = 40
_REACH = WIDTH - LEAD
#: Strings are told apart by how far before the anchor they start: four ranges of starts.
_RANGES = [(0, 14), (15, 29), (30, 44), (45, 60)]
_PLACE = 20
#: Texts are put one after another up to so many bytes.
_PIECE = 1 << 17
_FIRST = -(1 << 63)


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` keys in a row, from those of ever twice as many."""
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = span - width
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def _spots(mark: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Numbers for anchors (and a range of starts), the document's part on top. They only choose what
    is compared, so it does no harm if two agree."""
    return (mark.view(np.uint64) >> np.uint64(32) << np.uint64(32)) | (at.astype(np.uint64) << np.uint64(2) | np.uint64(k)) & np.uint64(0xFFFFFFFF)


class _Texts:
    """Documents' bytes one after another. Fingerprints do not depend on where bytes stand."""

    def __init__(self, docs: list[int | None], marks: list[int], texts: list[bytes]):
        self.bytes = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.docs = np.array([_FIRST if d is None else d for d in docs], np.int64)
        self.marks = np.array(marks, np.int64)
        self.sums = prefix_sums(np.frombuffer(self.bytes, np.uint8))

    def anchored(self) -> _Texts:
        """Finds the anchors ``at`` and their leads, documents, marks and documents' bounds."""
        self.at = self._anchors()
        own = np.searchsorted(self.ends, self.at, side="right")
        self.doc, self.mark, self.low, self.high = self.docs[own], self.marks[own], self.starts[own], self.ends[own]
        self.lead = fingerprints(self.sums, self.at, self.at + LEAD)
        return self

    def _anchors(self) -> np.ndarray:
        n = len(self.bytes)
        if n < WIDTH:
            return np.empty(0, np.int64)
        # a string starts where its document has WIDTH more bytes
        inside = np.ones(n, bool)
        for start, end in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            inside[max(start, end - WIDTH + 1) : end] = False
        count, span = n - LEAD + 1, _REACH + 1
        lead = (self.sums[LEAD:] - self.sums[:-LEAD]) * powers(count, inverse=True)
        lead ^= lead >> np.uint64(29)
        lead *= np.uint64(0xBF58476D1CE4E5B9)
        found, step = [], (1 << _PLACE) - span
        for begin in range(0, count - span + 1, step):
            part = lead[begin : begin + step + span - 1]
            # the least fingerprint wins, then the first place
            key = (part >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(part), dtype=np.uint64)
            least = _least(key, span)
            least = least[inside[begin : begin + len(least)]]
            if len(least):
                change = np.concatenate([[True], least[1:] != least[:-1]])
                found.append((least[change] & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + begin)
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def only(self, ok: np.ndarray) -> _Texts:
        """Some of the anchors, in place."""
        for name in ("at", "doc", "mark", "low", "high", "lead"):
            setattr(self, name, getattr(self, name)[ok])
        return self

    def spots(self, k: int = 0) -> np.ndarray:
        return _spots(self.mark, self.at - self.low, k)

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of what surrounds the anchors, and its fingerprints (which know the place)."""
        a = np.maximum(self.at - _REACH, self.low)
        b = np.minimum(self.at + LEAD + _REACH, self.high)
        whole = mix(fingerprints(self.sums, a, b) + (self.at - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return a, b, whole

    def parts(self) -> np.ndarray:
        """(4, anchors): fingerprints of what all strings of a range of starts share; 0: beyond the text."""
        out = np.zeros((len(_RANGES), len(self.at)), np.uint64)
        for k, (low, high) in enumerate(_RANGES):
            ok = (self.at - low >= self.low) & (self.at + WIDTH - high <= self.high)
            out[k, ok] = fingerprints(self.sums, self.at[ok] - low, self.at[ok] + WIDTH - high)
        return out


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _texts(batches: Iterator[pa.RecordBatch], n: int = 1000, size: int = 1 << 23) -> Iterator[list[_Texts]]:
    """Chunks of at most n documents, and of bounded size unless one document is larger, in pieces
    that the processor's cache holds."""
    chunk: list[_Texts] = []
    docs: list[int | None] = []
    marks: list[int] = []
    texts: list[bytes] = []
    held = rows = inner = 0
    for batch in batches:
        for doc, mark, text in zip(*(batch.column(x) for x in ("doc_id", "mark", "text")), strict=True):
            docs.append(doc.as_py())
            marks.append(mark.as_py())
            texts.append(_encoded(text.as_py()))
            held, rows, inner = held + len(texts[-1]), rows + 1, inner + len(texts[-1])
            full = rows >= n or held > size
            if full or inner > _PIECE:
                chunk.append(_Texts(docs, marks, texts).anchored())
                docs, marks, texts, inner = [], [], [], 0
            if full:
                yield chunk
                chunk, held, rows = [], 0, 0
    if docs:
        chunk.append(_Texts(docs, marks, texts).anchored())
    if chunk:
        yield chunk


def _first_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by all keys (the last three: doc, mark, place) without equal rows, and whether a row
    is the first of its leading keys."""
    order = np.lexsort(keys[::-1])
    rows = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    lead = np.zeros(len(order), bool)
    if len(order):
        new[0] = lead[0] = True
        for k, r in enumerate(rows):
            differ = r[1:] != r[:-1]
            new[1:] |= differ
            if k < len(rows) - 3:
                lead[1:] |= differ
    return order[new], lead[new]


_ENTRY = np.dtype([("lead", "<u8"), ("whole", "<u8"), ("parts", "<u8", (4,)), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i8"), ("a", "<i4"), ("b", "<i4")])
_LEAD = np.dtype([("lead", "<u4"), ("spot", "<u8")])
_STRING = np.dtype([("lead", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i8")])
_OUT = "block int, packed binary, doc long, mark long, a int, b int"
_SPOTS = "block int, spots binary"


def _runs(doc: np.ndarray, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
    """Spans of each document as maximal runs."""
    if not len(doc):
        return doc, mark, a, b
    order = np.lexsort((a, mark, doc))
    doc, mark, a, b = doc[order], mark[order], a[order].astype(np.int64), b[order].astype(np.int64)
    other = np.concatenate([[False], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    shift = np.cumsum(other) << 40  # documents one after another on one line
    reach = np.maximum.accumulate(b + shift)
    new = np.concatenate([[True], (a + shift)[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return doc[new], mark[new], a[new], reach[last] - shift[last]


_ROWS = pa.schema([("block", pa.int32()), ("packed", pa.binary()), ("doc", pa.int64()), ("mark", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _rows(blocks: list[tuple[int, bytes]], spans: list[tuple], schema: pa.Schema = _ROWS) -> Iterator[pa.RecordBatch]:
    """Packed entries by block, and spans that are settled already (block null)."""
    if blocks:
        none = pa.nulls(len(blocks))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([p for _, p in blocks], pa.binary()), *(none.cast(f.type) for f in list(schema)[2:])], schema=schema)
    for doc, mark, a, b in (_runs(*s) for s in spans):
        n = len(doc)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(doc), pa.array(mark), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], schema=schema)


def _leads(blocks: int):
    """Anchors by their leads' blocks: of each lead and chunk two at most. Those it has more, which are
    known to occur again, are by their spots' buckets already."""

    def run(batches):
        schema = pa.schema([("block", pa.int32()), ("leads", pa.binary()), ("spots", pa.binary())])
        for chunk in _texts(batches):
            lead, spot = (np.concatenate(x) for x in zip(*((t.lead, t.spots()) for t in chunk), strict=True))
            if not len(lead):
                continue
            order = np.argsort(lead, kind="stable")
            lead, spot = lead[order], spot[order]
            start = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
            two = np.arange(len(lead)) - np.repeat(start, np.diff(np.append(start, len(lead)))) < 2
            e = np.zeros(int(two.sum()), _LEAD)
            e["lead"], e["spot"] = lead[two] & np.uint64(0xFFFFFFFF), spot[two]
            out = [(b, e[x].tobytes(), None) for b, x in split(lead[two], blocks)]
            out += [(b, None, x) for b, x in _dealt(spot[~two], blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _dealt(spots: np.ndarray, blocks: int) -> list[tuple[int, bytes]]:
    spots = np.unique(spots)
    return [(b, spots[x].tobytes()) for b, x in split(spots, blocks)]


def _repeated(blocks: int):
    """Spots of anchors whose lead occurs again, by bucket."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        known = block[["block", "spots"]].dropna()
        e = np.frombuffer(b"".join(block["leads"].dropna()), _LEAD)
        _, inverse, counts = np.unique(e["lead"], return_inverse=True, return_counts=True)
        out = _dealt(e["spot"][counts[inverse] > 1], blocks)
        return pd.concat([known, pd.DataFrame(out, columns=["block", "spots"])])

    return run


def _own(part: pa.Table, spots: pa.Table) -> tuple[np.ndarray, Iterator[list[_Texts]]]:
    """A bucket's spots, sorted, and those of its documents that have any, in chunks."""
    own = np.unique(np.frombuffer(b"".join(spots.column("spots").to_pylist()), np.uint64))
    marks = part.column("mark").to_numpy().view(np.uint64)
    part = part.filter(pa.array(_among(own >> np.uint64(32), marks >> np.uint64(32)), pa.bool_()))
    return own, _texts(iter(part.to_batches()))


def _among(own: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which numbers stand in a sorted array."""
    if not len(own):
        return np.zeros(len(spots), bool)
    return own[np.minimum(np.searchsorted(own, spots), len(own) - 1)] == spots


def _entries(blocks: int):
    def run(part: pa.Table, spots: pa.Table) -> pa.Table:
        own, chunks = _own(part, spots)
        out: list[pa.RecordBatch] = []
        for chunk in chunks:
            made = []
            for t in chunk:
                t.only(_among(own, t.spots()))
                e = np.zeros(len(t.at), _ENTRY)
                a, b, e["whole"] = t.around()
                e["lead"], e["at"], e["doc"], e["mark"], e["a"], e["b"] = t.lead, t.at - t.low, t.doc, t.mark, a - t.low, b - t.low
                e["parts"] = t.parts().T
                made.append(e)
            e = np.concatenate(made)
            order, first = _first_of([e["lead"], e["whole"], e["doc"], e["mark"], e["at"]])
            again, e = e[order[~first]], e[order[first]]
            again = again[again["b"] - again["a"] >= WIDTH]
            out += _rows([(b, e[s].tobytes()) for b, s in split(np.ascontiguousarray(e["lead"]), blocks)], [(again["doc"], again["mark"], again["a"], again["b"])])
        return pa.Table.from_batches(out, _ROWS)

    return run


def _sort_anchors(blocks: int):
    """Spans that repeat (block null); and by bucket the spots of edges, an anchor and a range of starts."""

    def run(block: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(block.column("packed").to_pylist()), _ENTRY)
        order, first = _first_of([e["lead"], e["whole"], e["doc"], e["mark"], e["at"]])
        e = e[order]
        again = e[~first]
        again = again[again["b"] - again["a"] >= WIDTH]
        heads, spots = e[first], [np.empty(0, np.uint64)]
        for k in range(len(_RANGES)):
            part = heads["parts"][:, k]
            some = heads[part != 0]
            _, inverse, counts = np.unique(mix(some["parts"][:, k] ^ mix(some["lead"].copy())), return_inverse=True, return_counts=True)
            edge = some[counts[inverse] > 1] if len(some) else some
            spots.append(_spots(edge["mark"], edge["at"], k))
        found = _rows(_dealt(np.concatenate(spots), blocks), [(again["doc"], again["mark"], again["a"], again["b"])])
        return pa.Table.from_batches(found, _ROWS)

    return run


def _strings(blocks: int):
    def run(part: pa.Table, spots: pa.Table) -> pa.Table:
        own, chunks = _own(part, spots)
        anchors, out = np.unique(own & ~np.uint64(3)), []
        for chunk in chunks:
            made = []
            for t in chunk:
                t.only(_among(anchors, t.spots()))
                for k, (low, high) in enumerate(_RANGES):
                    edge = np.flatnonzero(_among(own, t.spots(k)))
                    edge = np.repeat(edge, high - low + 1)
                    start = t.at[edge] - np.tile(np.arange(low, high + 1), len(edge) // (high - low + 1))
                    ok = (start >= t.low[edge]) & (start + WIDTH <= t.high[edge])
                    edge, start = edge[ok], start[ok]
                    s = np.zeros(len(start), _STRING)
                    s["lead"], s["doc"], s["mark"], s["at"] = t.lead[edge], t.doc[edge], t.mark[edge], start - t.low[edge]
                    s["print"] = fingerprints(t.sums, start, start + WIDTH)
                    made.append(s)
            s = np.concatenate(made)
            order, first = _first_of([s["lead"], s["print"], s["doc"], s["mark"], s["at"]])
            again, s = s[order[~first]], s[order[first]]
            out += _rows([(b, s[x].tobytes()) for b, x in split(np.ascontiguousarray(s["lead"]), blocks)], [(again["doc"], again["mark"], again["at"], again["at"] + WIDTH)])
        return pa.Table.from_batches(out, _ROWS)

    return run


def _sort_strings(block: pd.DataFrame) -> pd.DataFrame:
    s = np.frombuffer(b"".join(block["packed"]), _STRING)
    order, first = _first_of([s["lead"], s["print"], s["doc"], s["mark"], s["at"]])
    again = s[order[~first]]
    doc, mark, a, b = _runs(again["doc"], again["mark"], again["at"], again["at"] + WIDTH)
    return pd.DataFrame({"doc": doc, "mark": mark, "a": a.astype(np.int32), "b": b.astype(np.int32)})


def _mark(text: str, id_column: str) -> Column:
    return F.xxhash64(F.col(id_column).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def repeated_spans(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc, mark, a, b``: byte ranges that consist of repeats, for each document (its id and a
    fingerprint of id and text); ranges may overlap."""
    scratch = Scratch(docs.sparkSession, "suffixes", clean=True)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), _mark(text, id_column).alias("mark"), F.col(text).cast("string").alias("text"))
    blocks = int(max(64, docs.count() // 4000))
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("mark", 32) * F.lit(blocks).cast("long"), 32).cast("int")

    def with_own(spots: DataFrame, compare) -> DataFrame:
        return source.groupBy(bucket.alias("block")).cogroup(spots.groupBy("block")).applyInArrow(compare, _OUT)

    leads = source.mapInArrow(_leads(blocks), "block int, leads binary, spots binary")
    leads = scratch.keep(leads.groupBy("block").applyInPandas(_repeated(blocks), _SPOTS), "leads")
    entries = scratch.keep(with_own(leads, _entries(blocks)), "entries")
    sorted_ = scratch.keep(entries.where("block is not null").select("block", "packed").groupBy("block").applyInArrow(_sort_anchors(blocks), _OUT), "sorted")
    spans = scratch.keep(entries.where("block is null").unionByName(sorted_.where("block is null")).select("doc", "mark", "a", "b"), "spans1")
    scratch.drop("leads", "entries")
    strings = scratch.keep(with_own(sorted_.where("block is not null").select("block", F.col("packed").alias("spots")), _strings(blocks)), "strings")
    scratch.drop("sorted")
    last = strings.where("block is not null").select("block", "packed").groupBy("block").applyInPandas(_sort_strings, "doc long, mark long, a int, b int")
    last = scratch.keep(strings.where("block is null").select("doc", "mark", "a", "b").unionByName(last), "spans2")
    scratch.drop("strings")
    return spans.unionByName(last)


def merged(spans: np.ndarray) -> np.ndarray:
    """(n, 2) ranges as maximal disjoint runs; ranges that touch are one run."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0])]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], 1)


_CUT = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                rows = []
                for doc, text, spans in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("spans"), strict=True):
                    data = _encoded(text)
                    v = np.array(spans.values.to_numpy(zero_copy_only=False), np.int64) if spans.is_valid else np.empty(0, np.int64)
                    runs = merged(np.stack([v >> 32, v & 0xFFFFFFFF], 1))
                    edges = [0, *runs.ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                    rows.append((doc, kept.decode("utf-8", "ignore") if with_text else None, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _CUT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", with_text: bool = True) -> DataFrame:
    """``doc_id, text, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``docs``.

    A byte goes when a WIDTH-byte string of UTF-8 that covers it also starts earlier: at a
    smaller id, or earlier in its document. Null ids are smallest; different rows of one id are
    ordered by a fingerprint of id and text; rows that repeat an id and its text count as one
    document and get equal results. Null texts are empty; texts under WIDTH bytes lose nothing.
    ``text`` drops a character of which a repeat cut off some bytes.
    """
    spans = repeated_spans(docs, text, id_column)
    packed = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    per_doc = spans.groupBy("doc", "mark").agg(F.collect_list(packed).alias("spans"))
    marked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), _mark(text, id_column).alias("mark"))
    joined = marked.withColumn("doc", F.coalesce("doc_id", F.lit(_FIRST))).join(per_doc, ["doc", "mark"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut(with_text), _CUT)


def op7_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("text")
