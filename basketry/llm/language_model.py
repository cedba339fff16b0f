"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over all training documents by grouped sums. A count c is stored as the
level 1 + floor(log c / log BASE): the n-gram is inserted once for each level up to its own. A probe asks for level
1, 2, ... until the filter says no, which gives the quantised count. The filter is an array of segments chosen by the
n-gram's hash, each built in one task. Workers get the segments by broadcast, in rounds of bounded size; every round
notes the levels it finds, and the probabilities are formed from the levels of all rounds. All bits of an n-gram lie in
one 64-byte block, those of one level in one word of it, so that its probes touch memory once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from basketry.llm.shared import held_out, raw_text, reach_workers, store

BASE = 1.5
PROBES = 3  # bits of a word for each level
SEGMENT_BITS = 22  # bits of one segment, as a power of two
BITS_PER_INSERTION = 12
ROUND_BYTES = 128 << 20  # segments broadcast at once
HOT_WORDS = 1 << 16  # words whose exact counts go to every worker
WORDS_KEPT = 300_000  # bound of the hash memory of one worker
PAIR_WEIGHT = 0.4
END = b"\n"  # no word holds a line break
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
STEP = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Signed 64-bit hash of a word, remembered for the first words of a worker."""

    def __missing__(self, word: bytes) -> int:
        number = xxh3_64_intdigest(word)
        number -= (number >> 63) << 64
        if len(self) < WORDS_KEPT:
            self[word] = number
        return number


HASHES = Hashes()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the A-Z lower-cased words and of the end."""
    words = text.lower().split()
    words.append(END)
    return np.fromiter(map(HASHES.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


def laid_out(texts: list[bytes], size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of whole texts: index of the first, hashes of all their tokens, tokens of each text."""
    start, parts, total = 0, [], 0
    for k, text in enumerate(texts):
        parts.append(tokens(text))
        total += len(parts[-1])
        if total >= size or k == len(texts) - 1:
            yield start, np.concatenate(parts), np.array([len(x) for x in parts])
            start, parts, total = k + 1, [], 0


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows the end."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts] = np.uint64(HASHES[END] & (2**64 - 1))
    return mixed(before * PAIR + mixed(hashes))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words (kind 1) and pairs (kind 2)."""
    for batch in batches:
        for _, hashes, sizes in laid_out(batch.column(0).to_pylist(), 1 << 21):
            for kind, grams in ((1, hashes), (2, pairs(hashes, sizes))):
                keys, times = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, dtype=np.int8)), pa.array(keys.view(np.int64)), pa.array(times)],
                    names=["kind", "gram", "times"])


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(grams * STEP) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)


def words_and_masks(grams: np.ndarray, level: int, bits: int = SEGMENT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Word of a segment, and the bits in it, for n-grams at a level."""
    x = mixed(grams + np.uint64(level * int(STEP) & 2**64 - 1))
    block = mixed(grams ^ PAIR) & np.uint64((1 << (bits - 9)) - 1)
    mask = np.zeros(len(grams), dtype=np.uint64)
    for probe in range(PROBES):
        mask |= np.uint64(1) << ((x >> np.uint64(8 + 6 * probe)) & np.uint64(63))
    return ((block << np.uint64(3)) | (x & np.uint64(7))).astype(np.int64), mask


def build_segments(counts: DataFrame, segments: int, size: int = SEGMENT_BITS) -> DataFrame:
    """(segment, bits): the filter over rows (gram, times)."""
    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment_of(grams, segments).astype(np.int32)), batch.column(0),
                 pa.array(level_of(batch.column(1).to_numpy()).astype(np.int8))], names=["segment", "gram", "level"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, bits = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([open_], pa.int32()),
                                               pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            owners = batch.column(0).to_numpy()
            grams, tops = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if owners[a] != open_:
                    if open_ is not None:
                        yield done()
                    open_, bits = int(owners[a]), np.zeros(1 << (size - 6), dtype=np.uint64)
                for level in range(1, int(tops[a:b].max()) + 1):
                    held = grams[a:b][tops[a:b] >= level]
                    np.bitwise_or.at(bits, *words_and_masks(held, level, size))
        if open_ is not None:
            yield done()

    rows = counts.select("gram", "times").mapInArrow(levels, "segment int, gram long, level byte")
    return rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(fill, "segment int, bits binary")


def probe_levels(grams: np.ndarray, low: int, high: int, segments: int, words: np.ndarray,
                 size: int = SEGMENT_BITS) -> np.ndarray:
    """Levels of n-grams whose segments are held (low..high - 1), 0 for all others. Equal n-grams are probed once."""
    grams, places = np.unique(grams, return_inverse=True)
    out = np.zeros(len(grams), dtype=np.uint8)
    owner = segment_of(grams, segments).astype(np.int64)
    open_ = np.flatnonzero((owner >= low) & (owner < high))
    level = 1
    while len(open_) and level < 255:
        at, mask = words_and_masks(grams[open_], level, size)
        hit = words[((owner[open_] - low) << (size - 6)) + at] & mask == mask
        open_ = open_[hit]
        out[open_] = level
        level += 1
    return out[places]


def expected(levels: np.ndarray) -> np.ndarray:
    """Count that stands for a level: the geometric middle of its range; 0 for level 0."""
    table = np.array([0.0, *(max(1.0, BASE ** (k - 0.5)) for k in range(1, 256))])
    return table[levels]


def score_documents(docs: DataFrame, training: DataFrame, round_bytes: int = ROUND_BYTES,
                    segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, one row per row of ``docs``.

    ``base_score`` uses exact counts: those of the most frequent words travel to the workers (a fixed number of them),
    those of all others are joined by the word's hash. ``score`` is log10 of weight * c(v w) / c(v) + (1 - weight) * p(w)
    summed over the tokens, p(w) the smoothed share of the word, all counts from the filter. Null and empty texts hold
    the end alone; null and repeated ids are kept. Words are told apart by 64-bit hashes. Without training tokens every
    probability is that of an unknown word.
    """
    spark = docs.sparkSession
    reach_workers(spark)
    counts = training.select(raw_text().alias("text")).mapInArrow(count_batches, "kind byte, gram long, times long")
    counts = store(counts.groupBy("kind", "gram").agg(F.sum("times").alias("times")), "gram-counts")
    words = counts.where("kind = 1").select("gram", "times")
    level = F.floor(F.log("times") / math.log(BASE) + 1e-9) + 1
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.count("*").alias("types"), F.sum("times").alias("total"),
                                                         F.sum(level).alias("levels")).collect()}
    total, types = (int(sums[1].total), int(sums[1].types)) if sums else (0, 0)
    insertions = sum(int(r.levels) for r in sums.values())
    segments = max(1, -(-insertions * BITS_PER_INSERTION >> segment_bits))
    filled = store(build_segments(counts, segments, segment_bits), "bloom-segments")
    scale = total + 0.5 * (types + 1)

    hot = words.orderBy(F.desc("times"), "gram").limit(HOT_WORDS).toArrow()  # a fixed number of rows
    order = np.argsort(hot.column("gram").to_numpy())
    hot_grams, hot_times = hot.column("gram").to_numpy()[order], hot.column("times").to_numpy()[order].astype(float)

    per_round = max(1, round_bytes >> (segment_bits - 3))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       raw_text().alias("text"), F.lit(None).cast("binary").alias("levels"))
    rounds = [(k, min(k + per_round, segments)) for k in range(0, segments, per_round)]
    for k, (low, high) in enumerate(rounds):
        packed = np.zeros((high - low) << (segment_bits - 6), dtype=np.uint64)
        for r in filled.where(F.col("segment").between(low, high - 1)).toLocalIterator():
            at = (r.segment - low) << (segment_bits - 6)
            packed[at:at + len(r.bits) // 8] = np.frombuffer(r.bits, dtype=np.uint64)
        held = spark.sparkContext.broadcast(packed)  # at most round_bytes
        last = k == len(rounds) - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, low=low, high=high, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, before = batch.column(2).to_pylist(), batch.column(3)
                for start, hashes, sizes in laid_out(texts):
                    levels = np.concatenate([probe_levels(hashes, low, high, segments, held.value, segment_bits),
                                             probe_levels(pairs(hashes, sizes), low, high, segments, held.value, segment_bits)])
                    part = batch.slice(start, len(sizes))
                    if before.null_count < len(before):
                        known = np.frombuffer(b"".join(before.slice(start, len(sizes)).to_pylist()), dtype=np.uint8)
                        # stored text by text: levels of the words, then of the pairs
                        of_word = np.arange(len(hashes)) + np.repeat(np.cumsum(sizes) - sizes, sizes)
                        of_pair = of_word + np.repeat(sizes, sizes)
                        levels = np.maximum(levels, known[np.concatenate([of_word, of_pair])])
                    yield finish(part, hashes, sizes, levels) if last else keep(part, sizes, levels)

        def keep(part: pa.RecordBatch, sizes: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
            half, ends = len(levels) // 2, np.cumsum(sizes)
            noted = [levels[a:b].tobytes() + levels[half + a:half + b].tobytes() for a, b in zip(ends - sizes, ends)]
            return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(noted, pa.binary())],
                                              names=["row", "doc_id", "text", "levels"])

        def finish(part: pa.RecordBatch, hashes: np.ndarray, sizes: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
            starts = np.cumsum(sizes) - sizes
            single, double = expected(levels[:len(hashes)]), expected(levels[len(hashes):])
            before = np.empty_like(single)
            before[1:] = single[:-1]
            before[starts] = single[starts + sizes - 1]  # the end stands before the first token, too
            share = np.where((double > 0) & (before > 0), np.minimum(1.0, double / np.maximum(before, 1.0)), 0.0)
            chance = PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * np.minimum(1.0, (single + 0.5) / max(scale, 0.5))
            score = np.add.reduceat(np.log10(chance), starts)
            signed = hashes.view(np.int64)
            at = np.minimum(np.searchsorted(hot_grams, signed), max(0, len(hot_grams) - 1))
            hot_hit = hot_grams[at] == signed if len(hot_grams) else np.zeros(len(signed), dtype=bool)
            base = np.where(hot_hit, np.log10(((hot_times[at] if len(hot_grams) else 0.0) + 0.5) / max(scale, 0.5)), 0.0)
            rare = np.split(signed[~hot_hit], np.cumsum(np.add.reduceat((~hot_hit).astype(np.int64), starts))[:-1])
            return pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes.astype(np.int64)),
                 pa.array(np.add.reduceat(hot_hit.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)),
                 pa.array(score), pa.array(rare, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_tokens", "hot_known", "hot_base", "score", "rare"])

        if last:
            rows = rows.mapInArrow(run, "row long, doc_id long, n_tokens long, hot_known long, hot_base double, "
                                        "score double, rare array<long>")
        else:
            rows = rows.mapInArrow(run, "row long, doc_id long, text binary, levels binary")
        rows = store(rows, f"lm-round-{k}")
    asked = rows.select("row", F.explode("rare").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("n"))
    found = asked.join(words, "gram", "left")
    own = F.log10((F.coalesce("times", F.lit(0)) + 0.5) / F.lit(max(scale, 0.5))) * F.col("n")
    rest = found.groupBy("row").agg(F.sum(own).alias("rest"), F.sum(F.when(F.col("times") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    return rows.drop("rare").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("hot_base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score")


def score_by_fold(docs: DataFrame, remainder: int = 1) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold, with ``held_out``."""
    scored = score_documents(docs, docs.where(~held_out(remainder)))
    return scored.select("doc_id", held_out(remainder).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
