"""A hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class of word | history) P(word | class). The class is
predicted by a softmax whose features are the previous word, the previous two,
and the words two and three back (skips), each hashed into a table of rows with
one weight per class. Within its class a word has its relative frequency. Words
outside the dictionary share a class, in which counts are smoothed and one
share is left for all unseen words; the end of a text is a class of its own.
The probabilities of all words, known or not, add up to one.

Counts, classes and weights use every training document. Classes group words
that follow similar words (a mixture of multinomials over hashed predecessors),
split by frequency. Weights are trained in rounds: each task makes Adagrad
updates on its own documents from the weights of the last round, and the updates
of all tasks are averaged row by row, weighted by how often a row was used.

The dictionary and the weights have fixed sizes. All other words are counted
and scored by a join, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import split
from .quality import held_out
from .scratch import Scratch
from .words import batch_words, lowered, mix, text_print

#: Most frequent words with an entry of their own in the dictionary that tasks get.
DICTIONARY = 1 << 17
GROUPS, BINS = 6, 5
RARE, END = GROUPS * BINS, GROUPS * BINS + 1
CLASSES = END + 1
ROW_BITS = 13
FEATURES = 4
ROUNDS = 2
BATCH = 8192
RATE = 0.25

_LOW = 4
_ID = np.uint64(~((1 << _LOW) - 1) & (1 << 64) - 1)
_END_WORD = np.uint64(0xE5D0E5D0E5D0E5D0) & _ID
_START_WORD = np.uint64(0x57A2757A2757A270) & _ID


def _documents(batches: Iterator[pa.RecordBatch], n: int = 1000):
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def _tokens(texts: list[bytes]):
    """Yields (first, last, ids, lengths): tokens of rows first..last-1 with the end of each."""
    for first, last, words, counts in batch_words(texts):
        yield first, last, np.insert(words & _ID, np.cumsum(counts), _END_WORD), counts + 1


def _back(ids: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
    """The token so many steps before each, or the start of its text."""
    at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full(len(ids), _START_WORD)
    if len(ids) > steps:
        out[steps:] = ids[:-steps]
    out[at < steps] = _START_WORD
    return out


def _count(blocks: int):
    """Counts of (word, hashed predecessor), packed by block."""

    def run(batches):
        for part in _documents(batches):
            keys = []
            for _, _, ids, lengths in _tokens([lowered(t) for t in part.column(0).to_pylist()]):
                keys.append(ids | (_back(ids, lengths, 1) >> np.uint64(20)) & np.uint64((1 << _LOW) - 1))
            if keys:
                keys, counts = np.unique(np.concatenate(keys), return_counts=True)
                out = [(b, keys[s].tobytes(), counts[s].astype(np.uint32).tobytes()) for b, s in split(keys, blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "keys", "counts"])

    return run


_WORDS = "block int, keys binary, counts binary, n long, v long, word long, c long, profile binary"


def _words_of(least: int):
    """Per block: all words with their counts, and candidates for the dictionary as rows."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(block["keys"]), np.uint64)
        counts = np.frombuffer(b"".join(block["counts"]), np.uint32).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        ids = keys & _ID
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        total = np.add.reduceat(counts, start)
        whole = pd.DataFrame({"block": block["block"].iloc[:1].to_numpy(), "keys": [ids[start].tobytes()], "counts": [total.tobytes()], "n": total.sum(), "v": len(start), "word": 0, "c": 0, "profile": [b""]})
        often = np.flatnonzero((total >= least) & (ids[start] != _END_WORD))
        rank = np.full(len(start), -1)
        rank[often] = np.arange(len(often))
        owner = np.repeat(rank, np.diff(np.append(start, len(ids))))
        profile = np.zeros((len(often), 1 << _LOW), np.float32)
        known = owner >= 0
        np.add.at(profile, (owner[known], (keys[known] & np.uint64((1 << _LOW) - 1)).astype(np.int64)), counts[known])
        rows = pd.DataFrame({"block": -1, "keys": [b""] * len(often), "counts": [b""] * len(often), "n": 0, "v": 0, "word": ids[start][often].view(np.int64), "c": total[often], "profile": [p.tobytes() for p in profile]})
        return pd.concat([whole, rows])

    return run


def groups_of(profiles: np.ndarray, groups: int = GROUPS, rounds: int = 20, fit_on: int = 50_000, seeds: int = 400, tries: int = 12) -> np.ndarray:
    """The likeliest component of each word in a mixture of multinomials; words come by falling
    count. The mixture begins at the best of several k-means runs over the first words."""
    if not len(profiles):
        return np.empty(0, np.int64)
    x = profiles[:fit_on].astype(float)
    whole = (x.sum(0) + 0.01) / (x.sum(0) + 0.01).sum()
    shape = np.sqrt((x[:seeds] + 5 * whole) / (x[:seeds].sum(1, keepdims=True) + 5))
    draw = np.random.Generator(np.random.PCG64(3))
    best, cost = shape[:1], np.inf
    for _ in range(tries):
        centres = shape[draw.choice(len(shape), min(groups, len(shape)), replace=False)]
        for _ in range(25):
            near = ((shape[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([shape[near == k].mean(0) if (near == k).any() else shape[draw.integers(len(shape))] for k in range(len(centres))])
        now = ((shape[:, None] - centres[None]) ** 2).sum(2).min(1).sum()
        if now < cost:
            best, cost = centres, now
    theta, prior = np.log(best**2 / (best**2).sum(1, keepdims=True)), np.zeros(len(best))
    x *= np.minimum(1, 200 / x.sum(1))[:, None]  # no word counts for more than 200
    for _ in range(rounds):
        like = x @ theta.T + prior
        r = np.exp(like - like.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        mass = r.T @ x + 20 * whole
        theta = np.log(mass / mass.sum(1, keepdims=True))
        prior = np.log(r.sum(0) + 1) - np.log(len(x) + len(best))
    return np.concatenate([(profiles[i : i + 65536] @ theta.T.astype(np.float32) + prior).argmax(1) for i in range(0, len(profiles), 65536)])


@dataclass
class Vocabulary:
    """The dictionary by rising id: class, log10 of the chance within the class, log10(c + 0.5)."""

    ids: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    smooth: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    end_count: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES << ROW_BITS, CLASSES), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.float32))

    @property
    def log_base(self) -> float:
        return float(np.log10(self.n + 0.5 * (self.v + 1)))

    @property
    def rare_n(self) -> int:
        return self.n - int(self.counts.sum()) - self.end_count

    @property
    def log_rare(self) -> float:
        return float(np.log10(self.rare_n + 0.5 * (self.v - len(self.ids) - (self.end_count > 0) + 1)))

    def look_up(self, tokens: np.ndarray):
        """Classes, and places in the dictionary (-1: rare or end)."""
        some, inverse = np.unique(tokens, return_inverse=True)
        place = np.full(len(some), -1)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, some), len(self.ids) - 1)
            place = np.where(self.ids[at] == some, at, -1)
        cls = np.where(place >= 0, self.classes[place] if len(self.ids) else 0, RARE)
        cls[some == _END_WORD] = END
        return cls[inverse], place[inverse]

    def chances(self, rows: np.ndarray) -> np.ndarray:
        """log softmax over the classes, for rows of feature places."""
        z = self.bias + self.weights[rows[0]]
        for f in range(1, FEATURES):
            z += self.weights[rows[f]]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def feature_rows(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    one, two, three = (_back(ids, lengths, k) for k in (1, 2, 3))
    shift = np.uint64(64 - ROW_BITS)
    hashed = [one, mix(one + two * np.uint64(0x9E3779B97F4A7C15)), two * np.uint64(0xD6E8FEB86659FD93), three * np.uint64(0xA0761D6478BD642F)]
    return np.stack([(mix(h.copy()) >> shift).astype(np.int64) + (f << ROW_BITS) for f, h in enumerate(hashed)])


def vocabulary(words: DataFrame, ends: int, size: int = DICTIONARY) -> Vocabulary:
    """The ``size`` most frequent words; ``ends``: how many training documents there are."""
    n, v = words.where("block >= 0").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(n or 0), int(v or 0)
    top = words.where("block < 0").orderBy(F.desc("c"), "word").limit(size).select("word", "c", "profile").toPandas()
    counts = top["c"].to_numpy(np.int64)
    profiles = np.frombuffer(b"".join(top["profile"]), np.float32).reshape(-1, 1 << _LOW)
    group = groups_of(profiles)
    classes = np.zeros(len(top), np.int64)
    for g in range(GROUPS):
        own = np.flatnonzero(group == g)
        mass = np.cumsum(counts[own])
        if len(own):
            classes[own] = g * BINS + np.minimum((mass - counts[own] / 2) * BINS // mass[-1], BINS - 1).astype(np.int64)
    per_class = np.bincount(classes, counts, CLASSES) if len(top) else np.zeros(CLASSES)
    ids = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ids)
    with np.errstate(divide="ignore"):
        within = np.log10(counts / per_class[classes]) if len(top) else np.empty(0)
    return Vocabulary(ids[order], classes[order], within[order], np.log10(counts + 0.5)[order], counts[order], n, v, ends)


def _train(shared, blocks: int):
    """One task's updates: per chunk of rows, the sums of row changes times uses, and the uses."""

    def run(batches):
        voc: Vocabulary = shared.value
        weights, squares = voc.weights.copy(), np.full(len(voc.weights), 1e-3, np.float32)
        used = np.zeros(len(weights), np.int64)
        bias, bias_squares, steps = voc.bias.copy(), np.float32(1.0), 0
        for part in _documents(batches):
            for _, _, ids, lengths in _tokens([lowered(t) for t in part.column(0).to_pylist()]):
                rows, (cls, _) = feature_rows(ids, lengths), voc.look_up(ids)
                for a in range(0, len(ids), BATCH):
                    r, y = rows[:, a : a + BATCH], cls[a : a + BATCH]
                    z = bias + weights[r[0]] + weights[r[1]] + weights[r[2]] + weights[r[3]]
                    z -= z.max(1, keepdims=True)
                    g = np.exp(z)
                    g /= g.sum(1, keepdims=True)
                    g[np.arange(len(y)), y] -= 1
                    mean = g.mean(0)
                    bias_squares += np.float32((mean**2).sum())
                    bias -= 0.1 / np.sqrt(bias_squares) * mean
                    for f in range(FEATURES):
                        order = np.argsort(r[f], kind="stable")
                        row = r[f][order]
                        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        n = np.diff(np.append(start, len(row))).astype(np.float32)
                        step = np.add.reduceat(g[order], start, axis=0) / np.sqrt(n)[:, None]
                        row = row[start]
                        squares[row] += (step**2).mean(1)
                        weights[row] -= RATE * step / np.sqrt(squares[row])[:, None]
                        used[row] += n.astype(np.int64)
                    steps += len(y)
        if not steps:
            return
        size = len(weights) // blocks
        task = TaskContext.get().partitionId()
        change = (weights - voc.weights) * used[:, None].astype(np.float32)
        out = [(b, task, change[b * size : (b + 1) * size].tobytes(), used[b * size : (b + 1) * size].tobytes()) for b in range(blocks)]
        out.append((blocks, task, ((bias - voc.bias) * steps).astype(np.float32).tobytes(), np.array([steps], np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "task", "change", "used"])

    return run


def _add_changes(block: pd.DataFrame) -> pd.DataFrame:
    change = sum(np.frombuffer(c, np.float32).astype(np.float64) for c in block["change"])
    used = sum(np.frombuffer(u, np.int64) for u in block["used"])
    return pd.DataFrame({"chunk": block["chunk"].iloc[:1], "task": block["task"].iloc[:1], "change": [change.astype(np.float32).tobytes()], "used": [used.tobytes()]})


_CHANGES = "chunk int, task int, change binary, used binary"


def train(training: DataFrame, voc: Vocabulary, rounds: int = ROUNDS, chunks: int = 32) -> Vocabulary:
    """Each round reads its own part of the training documents, so one pass covers all."""
    context = training.sparkSession.sparkContext
    prior = np.bincount(voc.classes, voc.counts, CLASSES).astype(float) if len(voc.ids) else np.zeros(CLASSES)
    prior[RARE], prior[END] = voc.rare_n, voc.end_count
    voc.bias = np.log((prior + 1) / (prior + 1).sum()).astype(np.float32)
    for k in range(rounds):
        part = training.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).select("text")
        changes = part.mapInArrow(_train(context.broadcast(voc), chunks), _CHANGES)
        # first within groups of tasks, so that no one adds up all of them
        changes = changes.groupBy("chunk", F.expr("task % 16").alias("turn")).applyInPandas(_add_changes, _CHANGES).groupBy("chunk").applyInPandas(_add_changes, _CHANGES)
        for row in changes.collect():  # of fixed size: the weights
            used = np.frombuffer(row.used, np.int64)
            change = np.frombuffer(row.change, np.float32).reshape(-1, CLASSES) / np.maximum(used, 1)[:, None]
            if row.chunk == chunks:
                voc.bias = voc.bias + change[0]
            else:
                size = len(voc.weights) // chunks
                voc.weights[row.chunk * size : (row.chunk + 1) * size] += change
    return voc


_SCORED = "doc_id long, key long, n_tokens long, n_known long, base double, score double, n_rare long, block int, rare binary"
_RARE = np.dtype([("word", "<u8"), ("key", "<i8"), ("times", "<i4")])


def _score(shared, blocks: int):
    def run(batches):
        voc: Vocabulary = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_rare", pa.int64()), ("block", pa.int32()), ("rare", pa.binary())])
        end_smooth = np.log10(voc.end_count + 0.5)
        for part in _documents(batches):
            texts = part.column(1).to_pylist()
            marks = np.array([text_print(t) for t in texts], np.int64)
            ids_of = part.column(0).to_pylist()
            keys = mix(mix(np.array([i or 0 for i in ids_of], np.int64).view(np.uint64)) + marks.view(np.uint64)).view(np.int64)
            out, rare = [], []
            for first, last, ids, lengths in _tokens([lowered(t) for t in texts]):
                cls, place = voc.look_up(ids)
                rows = feature_rows(ids, lengths)
                chance = np.empty(len(ids))
                for a in range(0, len(ids), BATCH):
                    p = voc.chances(rows[:, a : a + BATCH])
                    chance[a : a + BATCH] = p[np.arange(len(p)), cls[a : a + BATCH]]
                chance *= np.log10(np.e)
                in_dictionary, at_end = place >= 0, cls == END
                if len(voc.ids):
                    chance[in_dictionary] += voc.within[place[in_dictionary]]
                    smooth = np.where(in_dictionary, voc.smooth[place], np.where(at_end, end_smooth, 0))
                else:
                    smooth = np.where(at_end, end_smooth, 0)
                is_rare = ~in_dictionary & ~at_end
                start = np.cumsum(lengths) - lengths
                known = np.add.reduceat((in_dictionary | (at_end & (voc.end_count > 0))).astype(np.int64), start)
                n_rare = np.add.reduceat(is_rare.astype(np.int64), start)
                base = np.add.reduceat(smooth, start) - (lengths - n_rare) * voc.log_base
                score = np.add.reduceat(chance, start)
                for k in range(last - first):
                    out.append((ids_of[first + k], int(keys[first + k]), int(lengths[k]), int(known[k]), float(base[k]), float(score[k]), int(n_rare[k]), None, None))
                if is_rare.any():
                    # by row: rows that repeat share a key, and are made one when they meet
                    doc = np.repeat(np.arange(first, last), lengths)[is_rare]
                    word = ids[is_rare]
                    order = np.lexsort((doc, word))
                    word, doc = word[order], doc[order]
                    edge = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]))
                    r = np.zeros(len(edge), _RARE)
                    r["word"], r["key"], r["times"] = word[edge], keys[doc[edge]], np.diff(np.append(edge, len(word)))
                    rare.append(r)
            if rare:
                r = np.concatenate(rare)
                r = r[np.argsort(r["word"], kind="stable")]
                out += [(None, None, None, None, None, None, None, b, r[s].tobytes()) for b, s in split(np.ascontiguousarray(r["word"]), blocks)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _rare_counts(words: pd.DataFrame, rare: pd.DataFrame) -> pd.DataFrame:
    """Per document: the sum of log10(c + 0.5) of its rare tokens in this block, and how many are known."""
    r = np.unique(np.frombuffer(b"".join(rare["rare"]), _RARE)) if len(rare) else np.empty(0, _RARE)
    ids = np.frombuffer(b"".join(words["keys"]), np.uint64)
    counts = np.frombuffer(b"".join(words["counts"]), np.int64)
    c = np.zeros(len(r), np.int64)
    if len(ids) and len(r):
        at = np.minimum(np.searchsorted(ids, r["word"]), len(ids) - 1)
        c = np.where(ids[at] == r["word"], counts[at], 0)
    order = np.argsort(r["key"], kind="stable")
    key, times, c = r["key"][order], r["times"][order], c[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    if not len(start):
        return pd.DataFrame({"key": pd.Series(dtype="int64"), "smooth": pd.Series(dtype="float64"), "known": pd.Series(dtype="int64")})
    return pd.DataFrame({"key": key[start], "smooth": np.add.reduceat(times * np.log10(c + 0.5), start), "known": np.add.reduceat(times.astype(np.int64) * (c > 0), start)})


def score_texts(docs: DataFrame, text: str = "text", id_column: str = "doc_id", dictionary: int = DICTIONARY, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row.

    Learns from rows whose crc32 of the id as text leaves no 1 modulo 5; null ids are held out.
    Null and empty texts are the end alone. Rows that repeat an id and its text count each time
    in training and get equal scores. Without training rows every count is zero and the score is
    the base score. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "maxent")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = source.where(~held_out("doc_id", 5, 1))
    blocks = int(max(64, docs.count() // 4000))
    words = training.select("text").mapInArrow(_count(blocks), "block int, keys binary, counts binary").groupBy("block").applyInPandas(_words_of(3), _WORDS)
    words = scratch.keep(words, "words")
    voc = vocabulary(words, training.count(), dictionary)
    if voc.n:
        voc = train(training, voc, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    scored = scratch.keep(source.mapInArrow(_score(shared, blocks), _SCORED), "scored")
    rare = scored.where("block is not null").select("block", "rare")
    table = words.where("block >= 0").select("block", "keys", "counts")
    per_block = table.groupBy("block").cogroup(rare.groupBy("block")).applyInPandas(_rare_counts, "key long, smooth double, known long")
    per_doc = per_block.groupBy("key").agg(F.sum("smooth").alias("smooth"), F.sum("known").alias("known"))
    out = scored.where("block is null").join(scratch.keep(per_doc, "rare_of_documents"), "key", "left")
    smooth, n_rare = F.coalesce("smooth", F.lit(0.0)), F.col("n_rare")
    base = F.col("base") + smooth - n_rare * F.lit(voc.log_base)
    score = F.col("score") + smooth - n_rare * F.lit(voc.log_rare) if voc.n else base
    return out.select(
        "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(voc.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )


def op4_hashed_maxent(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
