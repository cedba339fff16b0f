"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Counts of the n-grams and weights come from a bounded sample of the labelled training rows; the bound is a parameter.
Weights are fitted only for n-grams with enough evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.shared import held_out, raw_text, reach_workers, store

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
FEATURES = 8192
SAMPLE = 12000  # training rows of each class at most
SLICE = 1 << 19  # characters handled at once


@dataclass
class Settings:
    low: int = 3
    high: int = 6
    features: int = FEATURES
    sample: int = SAMPLE
    smoothing: float = 1.0
    min_rows: int = 8
    ridge: float = 2e-4
    rounds: int = 150


def characters(text: bytes) -> np.ndarray:
    """Lower-cased code points, runs of white space as one blank, a blank at both ends."""
    return np.frombuffer(f" {' '.join(text.decode().lower().split())} ".encode("utf-32-le"), dtype="<u4")


def joined(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of texts laid end to end: index of the first text, characters, owner of every character."""
    start, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        parts.append(characters(text))
        size += len(parts[-1])
        if size >= SLICE or k == len(texts) - 1:
            yield start, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            start, parts, size = k + 1, [], 0


def buckets(chars: np.ndarray, owner: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, inside) of all n-grams that begin at each character, by length; inside: the n-gram is of one text."""
    mixed = np.zeros(len(chars), dtype=np.uint64)
    letters = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, high + 1):
        if n > len(chars):
            return
        mixed = mixed[:len(chars) - n + 1] * np.uint64(0x100000001B3) + letters[n - 1:]
        if n >= low:
            yield ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS), \
                owner[n - 1:] == owner[:len(owner) - n + 1]


def present(texts: list[bytes], slots: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, distinct features it holds) for every text; slots: bucket to feature, -1 none."""
    width = int(slots.max(initial=0)) + 1
    for start, chars, owner in joined(texts):
        found = []
        for bucket, inside in buckets(chars, owner, low, high):
            slot = slots[bucket]
            hit = np.nonzero((slot >= 0) & inside)[0]
            found.append(owner[hit] * width + slot[hit])
        keys = np.unique(np.concatenate(found)) if found else np.array([], dtype=np.int64)
        ends = np.searchsorted(keys, np.arange(1, int(owner[-1]) + 2) * width)
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            yield start + k, keys[a:b] % width


def count_buckets(settings: Settings):
    """Partial document frequencies of every bucket in both classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chars = characters(text)
                for bucket, _ in buckets(chars, np.zeros(len(chars), dtype=bool), settings.low, settings.high):
                    seen[bucket] = True
                held = np.flatnonzero(seen)
                counts[label, held] += 1
                seen[held] = False
        used = np.nonzero(counts.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[0, used]), pa.array(counts[1, used])],
                                         names=["bucket", "clean", "toxic"])
    return run


@dataclass
class Model:
    slots: np.ndarray  # bucket to feature, -1 none
    weights: np.ndarray  # log-count ratio times fitted weight, by feature
    intercept: float


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence features by accelerated gradient steps."""
    sizes = np.array([len(x) for x in rows])
    flat = np.concatenate(rows) if len(rows) else np.array([], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    scaled = ratio[flat]
    # step by coordinate: a bound of the curvature
    norm = np.bincount(owner, np.abs(scaled), minlength=len(rows))
    curve = np.bincount(flat, weight[owner] * np.abs(scaled) * norm[owner], minlength=len(ratio)) / 4 + settings.ridge
    w, b, ahead, ahead_b = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    for k in range(settings.rounds):
        z = np.bincount(owner, scaled * ahead[flat], minlength=len(rows)) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        step = np.bincount(flat, scaled * error[owner], minlength=len(ratio)) + settings.ridge * ahead
        new, new_b = ahead - step / curve, ahead_b - error.sum()
        pull = k / (k + 3)
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on rows with a label of 0 or 1 whose id is not held out; without both classes the model is flat.

    An id labelled 0 and 1 counts in both classes. Of rows with one id all give counts, one gives weights.
    """
    reach_workers(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(0))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(settings.sample)
             for k in (0, 1)]
    chosen = store(drawn[0].unionByName(drawn[1]), "toxicity-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text")).join(
        F.broadcast(chosen), "doc_id")  # at most two samples of ids, so no text is shuffled
    texts = store(texts, "toxicity-training")
    counts = texts.select("text", "toxic").mapInArrow(count_buckets(settings), "bucket long, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    enough = F.col("clean") + F.col("toxic") >= settings.min_rows
    counts = store(counts, "toxicity-counts")
    total = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    p = (F.col("toxic") + settings.smoothing) / F.lit(float(total[1] or 0) + settings.smoothing * BUCKETS)
    q = (F.col("clean") + settings.smoothing) / F.lit(float(total[0] or 0) + settings.smoothing * BUCKETS)
    ratio = F.log(p / q)
    # evidence: the ratio in units of its standard error
    evidence = F.abs(ratio) / F.sqrt(1 / (F.col("toxic") + settings.smoothing) + 1 / (F.col("clean") + settings.smoothing))
    best = counts.where(enough).select("bucket", ratio.alias("ratio"), evidence.alias("evidence"))
    best = best.orderBy(F.desc("evidence"), "bucket").limit(settings.features).toPandas()  # a bounded vocabulary
    slots = np.full(BUCKETS, -1, dtype=np.int32)
    slots[best["bucket"].to_numpy(dtype=np.int64)] = np.arange(len(best))
    ratios = best["ratio"].to_numpy(dtype=float)
    classes = {r.toxic for r in texts.select("toxic").distinct().collect()}
    if len(classes) < 2 or not len(best):
        return Model(slots, np.zeros(max(1, len(best))), 5.0 if classes == {1} else -5.0)
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x.astype(np.int32) for _, x in present(batch.column(0).to_pylist(), slots, settings.low, settings.high)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(held, pa.list_(pa.int32()))],
                                             names=["doc_id", "toxic", "held"])

    sample = texts.select("text", "toxic", "doc_id").mapInArrow(hold, "doc_id long, toxic int, held array<int>")
    # of rows that share an id one is learned from, so the driver gets no more rows than the samples have ids
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("held").alias("held")).toArrow().sort_by([("toxic", "ascending"), ("doc_id", "ascending")])
    rows = [np.asarray(x.values) for x in sample.column("held").combine_chunks()]
    weights, intercept = fit_weights(rows, sample.column("toxic").to_numpy().astype(float), ratios, settings)
    return Model(slots, weights * ratios, intercept)


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The score is the probability of the toxic label. Null and empty texts score by the intercept alone; null and
    repeated ids are kept. Only doc_id and text are read.
    """
    reach_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, model.intercept)
            for k, held in present(batch.column(1).to_pylist(), model.slots, settings.low, settings.high):
                z[k] += model.weights[held].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                                             names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score(docs, train(docs, labels, settings), settings)
