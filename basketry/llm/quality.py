"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1; the unlabelled set is a sample of all documents outside the held-out
fold, whatever their label. The class prior is estimated from both, the weights minimise the non-negative risk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.shared import held_out, raw_text, reach_workers, store

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Settings:
    positives: int = 12000  # trusted positives in the fit at most
    unlabelled: int = 24000  # unlabelled documents in the fit at most
    rounds: int = 600
    rate: float = 0.05
    ridge: float = 1e-4


def byte_classes() -> np.ndarray:
    """Class of every byte: each punctuation mark its own, then capitals, small letters, digits, white space, others."""
    out = np.full(256, len(PUNCTUATION) + 4)
    out[list(PUNCTUATION)] = np.arange(len(PUNCTUATION))
    for k, span in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\v\f\r")):
        out[list(span)] = len(PUNCTUATION) + k
    return out


CLASSES = byte_classes()
CLASS_COUNT = len(PUNCTUATION) + 5
WIDTH = 2 * CLASS_COUNT + 10


def features(text: bytes) -> np.ndarray:
    """Shares of character classes, plain and as roots, and figures of words, lines and repetition."""
    size = max(1, len(text))
    shares = np.zeros(CLASS_COUNT)
    for at in range(0, len(text), 1 << 20):
        shares += np.bincount(CLASSES[np.frombuffer(text[at:at + (1 << 20)], dtype=np.uint8)], minlength=CLASS_COUNT)
    shares /= size
    words = text.split()
    count = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / count
    lines = text.split(b"\n")
    kinds = len(set(words))
    letters = sum(map(len, words))
    return np.concatenate([shares, np.sqrt(shares), [
        again, math.sqrt(again), kinds / count, math.log1p(kinds), math.log1p(len(words)),
        letters / count / 10, (letters / count / 10) ** 2, math.log1p(count / len(lines)),
        1 - len(set(lines)) / len(lines), math.log1p(len(words)) ** 2 / 10,
    ]])


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.center) / self.scale, -8, 8) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept under prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss (Adam).

    Where the unlabelled part of the risk is negative its gradient is ascended, as the estimator prescribes.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p = np.hstack([positive, np.ones((len(positive), 1))])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1))])
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, settings.rounds + 1):
        zp, zu = p @ w, u @ w
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rise = p.T @ (-sigmoid(-zp)) * (prior / len(p))
        rest = u.T @ sigmoid(zu) / len(u) - p.T @ sigmoid(zp) * (prior / len(p))
        step = rise + rest if minus >= 0 else -rest
        step[:-1] += settings.ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        w -= settings.rate * (1 - k / settings.rounds) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the smallest ratio of the two tails of a score.

    Any set of scores holds prior * (its share of positives) of the unlabelled rows at least, so each ratio bounds the
    prior from above. Tails of less than a third of the positives are too small a sample to take a minimum over.
    """
    cuts = np.quantile(positive, np.linspace(0.01, 0.67, 67))
    ratios = [(unlabelled >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, settings: Settings) -> Model:
    both = np.vstack([positive, unlabelled])
    center = both.mean(axis=0)
    scale = np.maximum(both.std(axis=0), 1e-3)
    p, u = (np.clip((x - center) / scale, -8, 8) for x in (positive, unlabelled))
    # a first separation of positives from unlabelled rows orders the scores for the prior
    w, b = minimise(p, u, 0.5, settings)
    prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = minimise(p, u, prior, settings)
    return Model(center, scale, w, b, prior)


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                                         names=["doc_id", "trusted", "features"])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on bounded samples by the hash of the id; None without a positive and an unlabelled document.

    Only rows outside the held-out fold (and with an id) take part. Labels other than 1 are not read as such. The samples
    are of ids; of rows with one id that with the least features counts.
    """
    reach_workers(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(0))
    trusted = labels.where((F.col("quality") == 1) & ~held_out(0)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    position = F.xxhash64("doc_id", F.lit(11))

    def sample(rows: DataFrame, bound: int, flag: bool) -> DataFrame:
        return rows.orderBy(position, "doc_id").limit(bound).withColumn("trusted", F.lit(flag))

    chosen = sample(ids.distinct().join(trusted, "doc_id"), settings.positives, True).unionByName(
        sample(ids.distinct(), settings.unlabelled, False))
    chosen = store(chosen, "quality-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text")).join(
        F.broadcast(chosen), "doc_id")  # at most positives + unlabelled rows
    rows = texts.select("doc_id", "trusted", "text").mapInArrow(feature_batches, "doc_id long, trusted boolean, features array<double>")
    # of rows that share an id one is learned from, so the driver gets no more rows than the sample has ids
    rows = rows.groupBy("doc_id", "trusted").agg(F.min("features").alias("features")).toArrow().sort_by([("trusted", "ascending"), ("doc_id", "ascending")])
    flags = rows.column("trusted").to_numpy().astype(bool)
    values = np.array(rows.column("features").to_pylist(), dtype=float).reshape(-1, WIDTH)
    if not flags.any() or flags.all():
        return None
    return fit(values[flags], values[~flags], settings)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The score is the probability of a good document. Null texts count as empty and are scored; null and repeated ids
    are kept. Without a model every score is 0.5. Only doc_id and text are read.
    """
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(x) for x in batch.column(1).to_pylist()]).reshape(-1, WIDTH)
            scores = model.score(rows) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score(docs, train(docs, labels, settings))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; all columns stay, no row moves."""
    model = train(docs, labels, settings)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features((x or "").encode()) for x in batch.column(place).to_pylist()]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(rows) >= threshold)) if model else batch

    return docs.mapInArrow(run, docs.schema)
