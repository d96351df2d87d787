"""A quality classifier by Bradley-Terry ranking.

Every pair of a good and a bad labelled document is a preference. The chance
that i is preferred to j is sigmoid(w . (x_i - x_j)); w minimises the logistic
loss of sampled preferences by Newton's method. A document is accepted when its
latent score w . x reaches a quantile of the labelled documents' scores, the
one that splits the labels best. The reported score is a sigmoid of the latent
one, shifted so that the quantile falls on ACCEPT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batch_words, lowered

ACCEPT = 0.7
SAMPLE = 20_000
PAIRS = 120_000
_MARKS = b"!#$%&*|.,?\"'()+=:/<>@_-~^;[]{}\\"


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text: shares of kinds of characters, of repeated words and of repeated lines."""
    lower = [lowered(t) for t in texts]
    out = np.zeros((len(texts), 15 + len(_MARKS)))
    for first, last, words, counts in batch_words(lower):
        at = 0
        for row, n in zip(range(first, last), counts, strict=True):
            w, at = words[at : at + n], at + n
            data = (texts[row] or "").encode("utf-8", "surrogatepass")
            size = len(data)
            if not size:
                continue
            c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            kinds = [c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[32], c[10], c[128:].sum(), *c[list(_MARKS)]]
            out[row, 9:] = np.sqrt(np.array(kinds) / size)
            out[row, 0] = np.log1p(size)
            if n:
                same = w[1:] == w[:-1]
                uniq = np.unique(w, return_counts=True)[1]
                lines = data.split(b"\n")
                out[row, 1:9] = [
                    np.log1p(n), size / n, len(uniq) / n, np.sqrt(uniq.max() / n), np.sqrt(same.sum() / n),
                    np.sqrt((same[1:] & same[:-1]).sum() / n), np.log1p(len(lines)), len(set(lines)) / len(lines),
                ]
    out[:, 2] = np.minimum(out[:, 2], 100)
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        latent = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (latent - self.threshold) + np.log(ACCEPT / (1 - ACCEPT)), -60, 60)))


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> QualityModel | None:
    """None where either label is missing: there is no preference to learn from."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -6, 6)
    draw = np.random.Generator(np.random.PCG64(seed))
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    latent = z @ w
    # the quantile with the most labels on their own side, the middle one of ties
    levels = np.arange(1, 1000) / 1000
    cuts = np.quantile(latent, levels)
    good_s, bad_s = np.sort(latent[good]), np.sort(latent[bad])
    right = (len(good) - np.searchsorted(good_s, cuts)) / len(good) + np.searchsorted(bad_s, cuts) / len(bad)
    best = np.flatnonzero(right == right.max())
    threshold = float(cuts[best[len(best) // 2]])
    # one-parameter calibration: the slope by Newton's method, around the fixed threshold
    slope, t, base = 1.0, latent - threshold, np.log(ACCEPT / (1 - ACCEPT))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * t + base, -50, 50)))
        slope += float(((label - p) * t).mean() - 1e-3 * slope) / float((p * (1 - p) * t * t).mean() + 1e-3)
        slope = min(max(slope, 0.05), 20.0)
    return QualityModel(mean, scale, w, threshold, slope)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel | None:
    """From at most ``sample`` labelled rows (those of smallest hash of their id)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # at most `sample` rows of two numbers: small enough to broadcast at any scale
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    width = len(_MARKS) + 15

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                x = features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(measure, "doc_id long, quality int, x array<double>").orderBy("doc_id", "quality", "x").toPandas()
    x = np.array(found.x.tolist()).reshape(-1, width)
    return fit_pairs(x, found.quality.to_numpy())


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a column of scores (0 to 1; ACCEPT where there is no model).

    Scores depend on the text alone. Null and empty texts have all features zero and get the
    model's score for that; repeated rows get equal scores.
    """

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        if model is None:
            return pd.Series(ACCEPT, index=texts.index, dtype=float)
        values = texts.tolist()
        return pd.Series(np.concatenate([model.scores(features(values[i : i + 512])) for i in range(0, len(values), 512)] or [np.empty(0)]), index=texts.index)

    return docs.withColumn(into, of(F.col(text).cast("string")))


def accepted(docs: DataFrame, model: QualityModel | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that reach ACCEPT, with their columns."""
    mark = "__quality"
    return score(docs, model, text, mark).where(F.col(mark) >= ACCEPT).drop(mark)


def held_out(doc_id: str, parts: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == remainder, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Labels of held-out ids are never read. Labels other than 0 and 1, null ids and ids without a
    document teach nothing; a label that repeats counts as often as it is drawn.
    """
    model = fit(docs, labels.where(~held_out("doc_id", 4, 2)), sample)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))


def op1_bradley_terry(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
