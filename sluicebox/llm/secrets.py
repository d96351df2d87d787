"""Secret scanning: fixed patterns, and a character convolution over every other candidate.

The patterns give the base spans, which always stay. Every further run of 16 or
more credential characters that holds a digit is a candidate. A small
convolutional network in numpy reads a candidate with its surroundings. It is
trained on all labelled findings, the base spans (1) and the other candidates (0)
of all documents, and half of the positives are shown without
their surroundings, so that it learns how secrets look and not only what
introduces them. Findings are dealt to parts; every part goes over its own once a
round, and the networks of all parts are averaged before the next. A quarter of the
findings calibrates the outputs, and a candidate becomes a span of
kind ``model`` at the highest threshold that keeps the required recall.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_DIGIT = re.compile(r"[0-9]")
KINDS = ("assign", "access", "hex", "model")

RECALL, EPOCHS = 0.97, 12
#: A part has about so many findings, more where that takes more than PARTS parts; a label with fewer
#: than FEW findings a part goes to every part.
PART_FINDINGS, PARTS, FEW = 6_000, 64, 64
#: Outputs are counted in steps of 1 / STEPS up to EDGE either way, where they are certain.
STEPS, EDGE = 256, 128
BEFORE, BODY, AFTER = 24, 40, 16
#: Learning takes a longer finding in parts of so many characters; reading goes over so many places at once.
PART, PLACES = 1024, 1 << 14


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kinds as positions in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs with a digit that overlap no base span."""
    runs = [m.span() for m in CANDIDATE.finditer(text) if _DIGIT.search(text, m.start(), m.end())]
    return [(a, b) for a, b in runs if not any(s < b and a < e for s, _, e in base)]


def _codes() -> np.ndarray:
    code = np.full(128, 1, np.uint8)  # 0: outside the text, 1: any other character
    for i, group in enumerate(["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r", "\"'`", ":=", ".", "@", "-_", "+/", ",;!?", "()[]{}<>"]):
        code[[ord(c) for c in group]] = i + 2
    return code


_CODE = _codes()
_N_CODES = 18


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of the whole candidate (BODY places at least) and of what stands around it."""
    body = max(BODY, end - start)
    out = np.zeros(BEFORE + body + AFTER, np.uint8)

    def put(at: int, part: str):
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[at : at + len(points)] = np.where(points < 128, _CODE[np.minimum(points, 127)], 1)

    left = text[max(0, start - BEFORE) : start]
    put(BEFORE - len(left), left)
    put(BEFORE, text[start:end])
    put(BEFORE + body, text[end : end + AFTER])
    return out


def parts(x: np.ndarray) -> list[np.ndarray]:
    """A window in parts of PART characters of the candidate, each with what stands around the
    candidate; the last part ends where it ends."""
    body = len(x) - BEFORE - AFTER
    firsts = [*range(0, body - PART, PART), max(0, body - PART)]
    return [np.concatenate([x[:BEFORE], x[BEFORE + a : BEFORE + min(body, a + PART)], x[BEFORE + body :]]) for a in firsts]


@dataclass
class SecretModel:
    """Embedding -> convolution of width 5 -> ReLU -> maximum and mean over the candidate and
    over its surroundings -> one linear unit."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def _places(self, codes: np.ndarray):
        """Views of width 5 and their activations."""
        views = np.lib.stride_tricks.sliding_window_view(self.embed[codes], 5, axis=0).reshape(len(codes) - 4, -1)
        return views, np.maximum(views @ self.filters + self.bias, 0)

    @staticmethod
    def _edges(x: list[np.ndarray]) -> np.ndarray:
        """Where windows, one after another, have their first places: (windows, 4) of before, body,
        after, and of the places that reach into the next part (left out) in between."""
        n = np.array([len(w) for w in x])
        first = np.cumsum(n) - n
        return np.stack([first, first + BEFORE - 4, first + BEFORE, first + n - AFTER - 4, first + n - AFTER, first + n - 4], 1)

    def _pooled(self, x: list[np.ndarray]) -> np.ndarray:
        """Of each window: maximum and mean over the candidate, maximum over its surroundings, one."""
        codes, edges = np.concatenate(x), self._edges(x).ravel()
        top, total = np.zeros((len(edges), len(self.bias))), np.zeros((len(edges), len(self.bias)))
        for at in range(0, len(codes) - 4, PLACES):
            z = self._places(codes[at : at + PLACES + 4])[1]
            low, high = np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, at + len(z), "left")
            cuts = np.maximum(edges[low:high] - at, 0)
            top[low:high] = np.maximum(top[low:high], np.maximum.reduceat(z, cuts, axis=0))
            total[low:high] += np.add.reduceat(z, cuts, axis=0)
        size = np.diff(edges, append=0)[2::6]
        return np.concatenate([top[2::6], total[2::6] / size[:, None], np.maximum(top[0::6], top[4::6]), np.ones((len(x), 1))], 1)

    def logits(self, x: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self._pooled(x[i : i + 256]) @ self.out for i in range(0, len(x), 256)] or [np.empty(0)])

    def chances(self, x: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -40, 40)))


_WEIGHTS = ("embed", "filters", "bias", "out")
_K, _D = 24, 8
_SHAPES = ((_N_CODES, _D), (5 * _D, _K), (_K,), (3 * _K + 1,))


@dataclass
class Learner:
    """A network with what Adam keeps of its gradients."""

    model: SecretModel
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    @staticmethod
    def fresh(draw: np.random.Generator) -> Learner:
        m = SecretModel(draw.normal(0, 0.5, _SHAPES[0]), draw.normal(0, 0.2, _SHAPES[1]), np.zeros(_K), draw.normal(0, 0.1, _SHAPES[3]))
        return Learner(m, *({n: np.zeros_like(getattr(m, n)) for n in _WEIGHTS} for _ in range(2)))

    def packed(self) -> np.ndarray:
        return np.concatenate([np.ravel(x) for n in _WEIGHTS for x in (getattr(self.model, n), self.first[n], self.second[n])])

    @staticmethod
    def of(packed: np.ndarray, step: int) -> Learner:
        edges = np.cumsum([math.prod(x) for x in _SHAPES for _ in range(3)])[:-1]
        own = [x.reshape(shape).copy() for x, shape in zip(np.split(packed, edges), [x for x in _SHAPES for _ in range(3)], strict=True)]
        return Learner(SecretModel(*own[0::3]), dict(zip(_WEIGHTS, own[1::3], strict=True)), dict(zip(_WEIGHTS, own[2::3], strict=True)), step)

    def epoch(self, x: list[np.ndarray], y: np.ndarray, draw: np.random.Generator) -> None:
        """Once over all windows of both labels, the fewer ones again and again; of one label if there
        is no other."""
        m, k, d, first, second = self.model, _K, _D, self.first, self.second
        pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        steps = max(20, -(-max(len(pos), len(neg)) // 32))
        for pick in np.concatenate([np.resize(draw.permutation(own), steps * 32).reshape(steps, 32) for own in (pos if len(pos) else neg, neg if len(neg) else pos)], 1):
            xb, yb = [x[i] for i in pick], y[pick].astype(float)
            blind = np.flatnonzero((yb == 1) & (draw.random(len(yb)) < 0.5) & (len(neg) > 0))
            for i, other in zip(blind, draw.choice(neg, len(blind)) if len(blind) else blind, strict=True):
                xb[i] = np.concatenate([x[other][:BEFORE], xb[i][BEFORE:-AFTER], x[other][-AFTER:]])
            codes, edges = np.concatenate(xb), m._edges(xb)
            views, z = m._places(codes)
            cuts = np.minimum(edges.ravel(), len(z) - 1)
            top, size = np.maximum.reduceat(z, cuts, axis=0).reshape(len(xb), 6, k), edges[:, 3] - edges[:, 2]
            inside = np.add.reduceat(z, cuts, axis=0).reshape(len(xb), 6, k)[:, 2] / size[:, None]
            outside = np.maximum(top[:, 0], top[:, 4])
            h = np.concatenate([top[:, 2], inside, outside, np.ones((len(xb), 1))], 1)
            g = (1 / (1 + np.exp(-np.clip(h @ m.out, -40, 40))) - yb) / len(yb)
            gh = g[:, None] * m.out[None, :]
            row = np.repeat(np.arange(len(xb)), [len(w) for w in xb])[: len(z)]
            place = np.arange(len(z)) - edges[row, 0]
            body = (place >= BEFORE) & (place < edges[row, 3] - edges[row, 0])
            around = (place < BEFORE - 4) | (place >= edges[row, 4] - edges[row, 0]) & (place < edges[row, 5] - edges[row, 0])
            # a maximum's gradient goes to the places that reach it
            gz = np.where(body[:, None], gh[row, k : 2 * k] / size[row, None] + gh[row, :k] * (z == top[row, 2]), 0)
            gz += np.where(around[:, None], gh[row, 2 * k : 3 * k] * (z == outside[row]), 0)
            gz *= z > 0
            ge = np.zeros((len(codes), d))
            gv = (gz @ m.filters.T).reshape(len(z), d, 5)
            for t in range(5):
                ge[t : t + len(z)] += gv[..., t]
            gembed = np.zeros_like(m.embed)
            np.add.at(gembed, codes, ge)
            grads = {"out": h.T @ g, "bias": gz.sum(0), "filters": views.T @ gz, "embed": gembed}
            self.step += 1
            for n in _WEIGHTS:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                getattr(m, n)[...] -= 3e-3 * (first[n] / (1 - 0.9**self.step)) / (np.sqrt(second[n] / (1 - 0.999**self.step)) + 1e-8)


def calibrate(m: SecretModel, t: np.ndarray, target: np.ndarray, share: np.ndarray, recall: float = RECALL) -> SecretModel:
    """Slope, shift and threshold from outputs, their labels, and how many findings each stands for:
    logistic regression on the logit."""
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(m.slope * t + m.shift, -40, 40)))
        w = p * (1 - p) + 1e-6
        mean = lambda v: np.average(v, weights=share)
        a = np.array([[mean(w * t * t) + 1e-2, mean(w * t)], [mean(w * t), mean(w) + 1e-2]])
        ds, db = np.linalg.solve(a, [mean((target - p) * t) - 1e-2 * (m.slope - 1), mean(target - p) - 1e-2 * m.shift])
        m.slope, m.shift = float(np.clip(m.slope + 0.5 * ds, 0.05, 20)), float(np.clip(m.shift + 0.5 * db, -20, 20))
    order = np.argsort(t[target == 1])
    seen = np.cumsum(share[target == 1][order])
    least = t[target == 1][order][np.searchsorted(seen, int((1 - recall) * seen[-1]), "right")]
    m.threshold = max(0.5, float(1 / (1 + np.exp(-np.clip(m.slope * least + m.shift, -40, 40)))))
    return m


def train(x: list[np.ndarray], y: np.ndarray, recall: float = RECALL, epochs: int = EPOCHS, seed: int = 5, weight: np.ndarray | None = None) -> SecretModel | None:
    """None unless both labels occur at least four times."""
    if min((y == 1).sum(), (y == 0).sum()) < 4:
        return None
    draw = np.random.Generator(np.random.PCG64(seed))
    own = Learner.fresh(draw)
    order = draw.permutation(len(x))
    held = order[: max(4, len(x) // 4)]
    if not 0 < y[held].sum() < len(held):
        held = order
    learn = np.setdiff1d(order, held) if len(held) < len(x) else order
    if not 0 < y[learn].sum() < len(learn):
        learn = order
    for _ in range(epochs):
        own.epoch([x[i] for i in learn], y[learn], draw)
    return calibrate(own.model, own.model.logits([x[i] for i in held]), y[held], np.ones(len(held)) if weight is None else weight[held], recall)


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            base = base_spans(text or "")
            spans = [(text, m.start(2) if k == 0 and (m := ASSIGN.match(text, a)) else a, b, 1) for a, k, b in base]
            for t, a, b, y in spans + [(text, a, b, 0) for a, b in candidates(text or "", base)]:
                rows += [(doc_id, a, y, p.tobytes()) for p in parts(window(t, a, b))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "at", "y", "x"])


def _round(packed: np.ndarray, step: int, epochs: int, seed: int):
    """A part's network after ``epochs`` more, from that of all parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "doc_id", "at", "x"])
        own, y = Learner.of(packed, step), rows["y"].to_numpy()
        draw = np.random.Generator(np.random.PCG64([seed, step, int(rows["part"].iloc[0])]))
        x = [np.frombuffer(v, np.uint8) for v in rows["x"]]
        for _ in range(epochs):
            own.epoch(x, y, draw)
        return pd.DataFrame({"n": [len(rows)], "step": [own.step], "packed": [own.packed().tobytes()]})

    return run


def averaged(parts: list[tuple[int, int, np.ndarray]]) -> Learner:
    """One network of those of all parts, which weigh as much as they have findings."""
    n, step, packed = zip(*sorted(parts, key=lambda p: (p[0], p[2].tobytes())), strict=True)
    return Learner.of(np.average(packed, axis=0, weights=n), round(np.average(step, weights=n)))


def _outputs(model: SecretModel):
    """Labels and outputs in whole steps, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = model.logits([np.frombuffer(v, np.uint8) for v in batch.column("x").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.floor(np.clip(t, -EDGE, EDGE) * STEPS).astype(np.int32))], names=["y", "t"])

    return run


def fit(docs: DataFrame, part: int = PART_FINDINGS, epochs: int = EPOCHS, seed: int = 5) -> SecretModel | None:
    """From all findings out of all documents; None unless both labels occur at least four times.

    A quarter of them (by hash) calibrates, and the others are learned from; all do both where a
    label would be missing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = Scratch(docs.sparkSession, "secrets").keep(docs.mapInArrow(_findings, "doc_id long, at long, y int, x binary"), "findings")
    found = found.withColumn("drawn", F.xxhash64("doc_id", "at", "x"))
    held = F.pmod("drawn", F.lit(4)) == 0
    counts = {(r.y, r.held): r.n for r in found.groupBy("y", held.alias("held")).agg(F.count("*").alias("n")).collect()}
    of_label = [sum(n for (y, _), n in counts.items() if y == k) for k in (0, 1)]
    if min(of_label) < 4:
        return None
    learn, calibrating = (found.where(~held), found.where(held)) if len(counts) == 4 else (found, found)
    n = min(PARTS, -(-sum(of_label) // part))
    everywhere = [k for k in (0, 1) if of_label[k] < FEW * n]
    own = F.array(F.pmod(F.shiftright("drawn", 2), F.lit(n)).cast("int"))
    dealt = learn.select("doc_id", "at", "y", "x", F.explode(F.when(F.col("y").isin(everywhere), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(own)).alias("part"))
    state = Learner.fresh(np.random.Generator(np.random.PCG64(seed)))
    at_once = epochs if n == 1 else 1
    for _ in range(0, epochs, at_once):
        parts = dealt.repartition(n, "part").groupBy("part").applyInPandas(_round(state.packed(), state.step, at_once, seed), "n long, step long, packed binary").collect()
        state = averaged([(r.n, r.step, np.frombuffer(r.packed)) for r in parts])
    seen = calibrating.select("y", "x").mapInArrow(_outputs(state.model), "y int, t int").groupBy("y", "t").agg(F.count("*").alias("n")).orderBy("y", "t").toPandas()
    return calibrate(state.model, seen["t"].to_numpy() / STEPS, seen["y"].to_numpy(), seen["n"].to_numpy(float))


_RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"


def scan(docs: DataFrame, model: SecretModel | None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model``, one row per row of ``docs``.

    Null texts count as empty, which have no spans. Without a model only base spans are given.
    Repeated rows give repeated results; null ids are allowed; other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in _RESULT.split(", ")]
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                bases, found, x = [], [], []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for row, t in enumerate(texts):
                    bases.append(base_spans(t))
                    for a, b in candidates(t, bases[-1]) if model else ():
                        found.append((row, a, b))
                        x.append(window(t, a, b))
                extra: list[list] = [[] for _ in texts]
                if x:
                    for (row, a, b), p in zip(found, model.chances(x), strict=True):
                        if p >= model.threshold:
                            extra[row].append((a, 3, b))
                rows = []
                for doc_id, base, more in zip(part.column(0).to_pylist(), bases, extra, strict=True):
                    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                    spans = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))
                    rows.append((doc_id, *(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(said.encode()).hexdigest(), spans, len(more)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_column).cast("long"), F.col(text).cast("string")).mapInArrow(find, _RESULT)


def op6_char_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, fit(docs))
