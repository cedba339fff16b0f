"""Phrase collocations by best-first branch-and-bound growth of prefixes.

Phrases grow word by word. A phrase p of count f(p) whose first word counts f(w) bounds the score of whatever begins
with p: no such phrase counts more than f(p), and cut after its first word it scores 2000000 * f(p) / (f(w) + f(p))
at most. The same holds from the right for whatever ends with p. Each round takes the best part of every unsettled
language's frontier, the phrases whose bounds reach a floor, counts their growth over the corpus, and stops once the
floor has ``limit`` surviving scores above or at it; then nothing below the floor, nor any tie, can enter the result.
Otherwise the floor goes down. Pruning tests are bitmaps of fixed size: a false hit only counts a phrase too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.language_model import HASHES, mixed
from basketry.llm.shared import raw_text, reach_workers, store

LIMIT = 2000
LEAST = 30  # occurrences of a candidate
UNIT = 2_000_000
COVER = 80  # percent of a phrase's count that a longer candidate around it needs to drop it
FRONTIER = 4  # pairs expanded in the first round, in multiples of the limit; eightfold with each further round
FILTER_BITS = 27  # bits of a pruning bitmap, as a power of two
BITMAP = 1 << 15  # bits of one value of Spark's bitmap aggregate
SLICE = 8 << 20  # bytes of text counted at once
TURN = 21  # bits by which a word's key is rotated for each place in a phrase
WORDS = ("w1", "w2", "w3", "w4")

# The characters that end a piece, all mapped to the full stop.
CUTS = b".,;:!?\n\x0b\x0c\r"
TO_STOP = bytes(ord(".") if i in CUTS else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased words in order; a full stop stands where a piece ends."""
    return text.lower().translate(TO_STOP).replace(b".", b" . ").split()  # of bytes: ASCII white space only


def laid_out(langs: list[str], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """Slices of whole texts: key of each token (0 ends a piece), its word's index, the words, its row."""
    start = 0
    while start < len(texts):
        tokens, sizes, size, k = [], [], 0, start
        while k < len(texts) and (not sizes or size < SLICE):
            own = words_of(texts[k])
            own.append(b".")
            tokens += own
            sizes.append(len(own))
            size, k = size + len(texts[k]), k + 1
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        base = np.fromiter(map(HASHES.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)
        row = np.repeat(np.arange(start, k), sizes)
        lang = np.array([HASHES[x.encode()] for x in langs[start:k]], dtype=np.int64).view(np.uint64)
        keys = mixed(base[index] + mixed(lang)[row - start])
        keys[keys == 0] = 1
        if b"." in words:
            keys[index == words.index(b".")] = 0
        yield keys, index, words, row
        start = k


def rolled(key: np.ndarray, place: int) -> np.ndarray:
    by = TURN * place % 64
    return key << np.uint64(by) | key >> np.uint64(64 - by) if by else key


def code_of(*keys: np.ndarray) -> np.ndarray:
    """One number for the words of a phrase, by exclusive-or of their rotated keys."""
    out = keys[0].copy()
    for place, key in enumerate(keys[1:], 1):
        out ^= rolled(key, place)
    return out


def code(*keys: str) -> Column:
    """``code_of`` as a column."""
    out = F.col(keys[0])
    for place, key in enumerate(keys[1:], 1):
        by = TURN * place % 64
        out = out.bitwiseXOR(F.shiftleft(key, by).bitwiseOR(F.shiftrightunsigned(key, 64 - by)))
    return out


def held(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = (codes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(rows: DataFrame, *keys: str):
    """Bits of the phrases' codes, 2^FILTER_BITS in all whatever the number of rows, sent to every worker."""
    at = rows.select(F.shiftrightunsigned(code(*keys), 64 - FILTER_BITS).alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / BITMAP).alias("part")).agg(
        F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for part in parts.toLocalIterator():
        begin = part.part * (BITMAP >> 3)
        out[begin:begin + (BITMAP >> 3)] = np.frombuffer(part.bits, dtype=np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def tallied(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each occurs (a hash clash may list one twice)."""
    order = np.argsort(code_of(*columns))
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), raw_text().alias("text"))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, w1, f) of words that occur ``least`` times at least, w1 their key; the row without a word has the language's total."""
    names = ("lang", "word", "w1", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for keys, index, words, row in laid_out(langs, batch.column(1).to_pylist()):
                index, row, keys = index[keys != 0], row[keys != 0], keys[keys != 0]
                found, first, times = np.unique(keys, return_index=True, return_counts=True)
                own = [langs[r] for r in row[first].tolist()]
                total = {}
                for lang, n in zip(own, times.tolist()):
                    total[lang] = total.get(lang, 0) + n
                # words of Spark strings are valid UTF-8
                yield pa.RecordBatch.from_arrays([
                    pa.array(own + list(total), pa.string()),
                    pa.array([words[i].decode() for i in index[first].tolist()] + [None] * len(total), pa.string()),
                    pa.array(np.append(found.view(np.int64), np.zeros(len(total), dtype=np.int64))),
                    pa.array(np.append(times, np.array(list(total.values()), dtype=np.int64)), pa.int64())], names=names)

    parts = texts_of(docs).mapInArrow(run, "lang string, word string, w1 long, f long")
    counts = parts.groupBy("lang", "word", "w1").agg(F.sum("f").alias("f"))
    return store(counts.where((F.col("f") >= least) | F.col("word").isNull()), "phrase-words")


def phrase_counts(docs: DataFrame, size: int, least: int, wanted, name: str) -> DataFrame:
    """(w1.., n) of the phrases of ``size`` words whose windows ``wanted`` takes, ``least`` occurrences at least."""
    names = WORDS[:size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, *_ in laid_out(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, times = tallied(wanted(keys))
                yield pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in found], pa.array(times, pa.int64())],
                                                 names=[*names, "n"])

    parts = texts_of(docs).mapInArrow(run, ", ".join(f"{w} long" for w in (*names, "n")))
    return store(parts.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least), name)


def windows(keys: np.ndarray, size: int, take: np.ndarray) -> list[np.ndarray]:
    """The words of the windows that begin where ``take`` holds."""
    at = np.flatnonzero(take)
    return [keys[at + k] for k in range(size)]


def pair_windows(words):
    def wanted(keys: np.ndarray) -> list[np.ndarray]:
        good = (keys != 0) & held(words.value, keys)
        return windows(keys, 2, good[:-1] & good[1:])

    return wanted


def triple_windows(frequent, heads, tails):
    """Windows of frequent pairs of which the first is worth growing to the right or the second to the left."""

    def wanted(keys: np.ndarray) -> list[np.ndarray]:
        whole = (keys[:-1] != 0) & (keys[1:] != 0)
        codes = code_of(keys[:-1], keys[1:])
        good = whole & held(frequent.value, codes)
        return windows(keys, 3, good[:-1] & good[1:] & (held(heads.value, codes[:-1]) | held(tails.value, codes[1:])))

    return wanted


def quadruple_windows(heads, tails, good):
    """Windows whose bounds from both sides reach the floor, or which may cover a triple that reaches it."""

    def wanted(keys: np.ndarray) -> list[np.ndarray]:
        zero = keys == 0
        whole = ~(zero[:-2] | zero[1:-1] | zero[2:])
        codes = code_of(keys[:-2], keys[1:-1], keys[2:])
        head, tail, near = (whole & held(x.value, codes) for x in (heads, tails, good))
        both = whole[:-1] & whole[1:]
        return windows(keys, 4, both & ((head[:-1] & tail[1:]) | near[:-1] | near[1:]))

    return wanted


def share(one: str, two: str) -> Column:
    """floor(UNIT * a / (one + two)) by decimal integer division, exact beyond 64 bits."""
    return F.expr(f"({UNIT} * cast(a as decimal(20,0))) div (cast({one} as decimal(20,0)) + cast({two} as decimal(20,0)))")


def scored(rows: DataFrame, cuts: list[tuple[str, str]], first: str, last: str) -> DataFrame:
    """Adds l, r, score of the lowest cut (ties to the first) and the bounds of what begins or ends with the phrase."""
    each = [F.struct(share(l, r).alias("score"), F.lit(k).alias("cut"), F.col(l).alias("l"), F.col(r).alias("r"))
            for k, (l, r) in enumerate(cuts)]
    out = rows.withColumn("best", F.array_min(F.array(*each)))
    return out.withColumns({"score": F.col("best.score"), "l": F.col("best.l"), "r": F.col("best.r"),
                            "head_bound": share("a", first), "tail_bound": share("a", last)}).drop("best")


def pairs_of(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """Frequent pairs with scores and bounds: lang, w1, w2, a, l, r, score, head_bound, tail_bound."""
    rows = phrase_counts(docs, 2, least, pair_windows(bitmap_of(words, "w1")), "phrase-pairs")
    one = words.select("lang", "w1", F.col("f").alias("f1"))
    two = words.select(F.col("w1").alias("w2"), F.col("f").alias("f2"))
    return store(scored(rows.join(one, "w1").join(two, "w2"), [("f1", "f2")], "f1", "f2").drop("f1", "f2"), "phrase-pair-scores")


def triples_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    one = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    two = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    full = rows.join(one, ["w1", "w2"]).join(two, ["w2", "w3"])
    return store(scored(full, [("f1", "f23"), ("f12", "f3")], "f1", "f3"), "phrase-triple-scores")


def quadruples_of(rows: DataFrame, triples: DataFrame) -> DataFrame:
    """Scores of phrases of four words; those of which one triple was not counted lie below the floor and are left out."""
    one = triples.select("lang", "w1", "w2", "w3", F.col("a").alias("f123"), "f12", "f1")
    two = triples.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"),
                         F.col("a").alias("f234"), F.col("f23").alias("f34"), F.col("f3").alias("f4"))
    full = rows.join(one, ["w1", "w2", "w3"]).join(two, ["w2", "w3", "w4"])
    return scored(full, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")], "f1", "f4")


def uncovered(rows: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """Rows without a longer candidate around them that holds ``COVER`` percent of their occurrences."""
    own = list(WORDS[:size])
    sides = [longer.select(*[F.col(WORDS[k + by]).alias(WORDS[k]) for k in range(size)], F.col("a").alias("most")) for by in (0, 1)]
    most = sides[0].unionByName(sides[1]).groupBy(*own).agg(F.max("most").alias("most"))
    out = rows.join(most, own, "left")
    return out.where(f"most is null or 100 * cast(most as decimal(20,0)) < {COVER} * cast(a as decimal(20,0))").drop("most")


def floors_of(pairs: DataFrame, size: int) -> DataFrame:
    """(lang, floor): the score of each language's pair number ``size``, 0 where it has no more. One row a score is ordered."""
    tally = pairs.groupBy("lang", "score").agg(F.count("*").alias("times"))
    before = F.sum("times").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    best = tally.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("lang").agg(
        F.sum("times").alias("all"), F.min(F.when(F.col("before") < size, F.col("score"))).alias("floor"))
    return best.select("lang", F.when(F.col("all") <= size, 0).otherwise(F.col("floor")).cast("long").alias("floor"))


def expanded(docs: DataFrame, pairs: DataFrame, floors: DataFrame, frequent, least: int) -> DataFrame:
    """All surviving phrases whose scores reach their language's floor: lang, w1..w4, a, l, r, score, floor."""
    own = store(pairs.join(F.broadcast(floors), "lang"), "phrase-frontier")
    reach = lambda rows, column, *keys: bitmap_of(rows.where(F.col(column) >= F.col("floor")), *keys)
    two = ("w1", "w2")
    heads, tails = reach(own, "head_bound", *two), reach(own, "tail_bound", *two)
    rows = phrase_counts(docs, 3, least, triple_windows(frequent, heads, tails), "phrase-triples")
    triples = triples_of(rows, pairs)
    near = triples.join(F.broadcast(floors), "lang")
    three = ("w1", "w2", "w3")
    marks = [reach(near, c, *three) for c in ("head_bound", "tail_bound", "score")]
    quads = phrase_counts(docs, 4, least, quadruple_windows(*marks), "phrase-quadruples")
    for used in (heads, tails, *marks):
        used.unpersist()
    good = F.col("score") >= F.col("floor")
    columns = ["lang", *WORDS, "a", "l", "r", "score", "floor"]
    full = quadruples_of(quads, triples).join(F.broadcast(floors), "lang").where(good).select(*columns)
    none = F.lit(None).cast("long")
    part = uncovered(near.where(good), quads, 3).withColumn("w4", none).select(*columns)
    return full.unionByName(part).unionByName(
        uncovered(own.where(good), rows, 2).withColumns({"w3": none, "w4": none}).select(*columns))


def collocations(docs: DataFrame, limit: int = LIMIT, least: int = LEAST, frontier: int = FRONTIER) -> DataFrame:
    """Each language's ``limit`` best phrases: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null lang is ``und``. Repeated rows count as often as they stand there, ids are not read, so
    null or repeated ones change nothing. Phrases of equal score and count are ordered by their UTF-8 bytes. A
    language without a candidate has no row, an empty table gives none. Other columns are not read. Words are told apart
    by 64-bit keys of language and word, phrases by the keys of all their words.
    """
    reach_workers(docs.sparkSession)
    counts = word_counts(docs, least)
    words, totals = counts.where("word is not null and w1 is not null"), counts.where("word is null").select("lang", F.col("f").alias("n"))
    pairs = pairs_of(docs, words, least)
    frequent = bitmap_of(pairs, "w1", "w2")
    done, size, rest = None, frontier * limit, pairs
    while True:
        floors = store(floors_of(rest, size), "phrase-floors")
        found = store(expanded(docs, pairs, floors, frequent, least), "phrase-survivors")
        tally = floors.join(found.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
        settled = store(tally.withColumn("settled", F.expr(f"floor = 0 or coalesce(found, 0) >= {limit}")), "phrase-settled")
        part = found.join(F.broadcast(settled.where("settled").select("lang")), "lang", "left_semi")
        done = part if done is None else done.unionByName(part)
        open_langs = settled.where("not settled").select("lang")
        if open_langs.isEmpty():
            break
        rest, size = pairs.join(F.broadcast(open_langs), "lang", "left_semi"), 8 * size
    frequent.unpersist()
    # of equal score and count the text decides: it is fetched for what can still be among the first
    order = [F.desc("score"), F.desc("a")]
    own = Window.partitionBy("lang")
    near = done.withColumn("place", F.rank().over(own.orderBy(*order))).where(F.col("place") <= limit).drop("place", "floor")
    for k, w in enumerate(WORDS):
        near = near.join(words.select(F.col("w1").alias(w), F.col("word").alias(f"t{k}")), w, "left")
    near = near.withColumn("phrase", F.concat_ws(" ", *[f"t{k}" for k in range(len(WORDS))]))
    best = near.withColumn("rank", F.row_number().over(own.orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= limit)
    return best.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
