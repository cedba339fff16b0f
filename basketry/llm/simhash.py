"""SimHash near-duplicates by exact comparison of tiles.

Fingerprints are compared tile by tile with numpy exclusive-or and bit counts. A tile holds fingerprints with
the same population counts of their four 16-bit words; two fingerprints within the radius differ by at most the
radius in the sum of these counts, so only such tile pairs meet. A tile of many fingerprints is cut into chunks
and its chunks meet pairwise. A task emits a spanning forest of each tile pair, never all its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from basketry.llm.shared import components, free_name, quoted, raw_text, reach_workers, store

SEED = 42
TILE = 2048
WORDS, BASE = 4, 17  # four 16-bit words, each with 0 to 16 bits set


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the A-Z lower-cased word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([xxh64_intdigest(x, SEED) for x in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, texts = batch.columns
        marks = np.array([fingerprint(x.as_py()) for x in texts], dtype="<u8").view("<i8")
        names = [*batch.schema.names[:-1], "print"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.int64())], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print), one row per row of ``docs``."""
    reach_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text")).mapInArrow(
        print_batches, "doc_id long, print long")


def row_key() -> Column:
    """Key of a row by id and text; repeated rows share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), raw_text())


def signature(mark: Column) -> Column:
    """Population counts of the four words as one number below 17^4."""
    out = F.lit(0)
    for i in range(WORDS):
        count = F.bit_count(F.shiftrightunsigned(mark, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int")
        out = out + count * BASE**i
    return out


def offsets(radius: int) -> list[int]:
    """Signature differences within the radius, one of each pair of opposite ones; no difference first."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius]
    return [0] + sorted(sum(x * BASE**i for i, x in enumerate(d)) for d in steps if d > (0,) * WORDS)


def tiles(marks: DataFrame, radius: int) -> DataFrame:
    """Rows (low, high, side, print): the tile pair and the side on which the fingerprint stands in it.

    Tiles are numbered signature * 2^24 + chunk. Chunk counts come from the table of signatures, which has at
    most 17^4 rows whatever the input.
    """
    marks = marks.withColumn("sig", signature(F.col("print")))
    chunks = store(marks.groupBy("sig").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks")), "signatures")
    own = marks.join(F.broadcast(chunks), "sig")
    own = own.withColumn("chunk", F.pmod(F.xxhash64("print", F.lit(7)), "chunks").cast("int"))
    near = offsets(radius)
    step = F.explode(F.array(*[F.lit(x) for x in [*near, *[-x for x in near[1:]]]])).alias("step")
    other = chunks.select(F.col("sig").alias("other"), F.col("chunks").alias("others"))
    met = own.select("print", "sig", "chunk", step).withColumn("other", F.col("sig") + F.col("step"))
    met = met.join(F.broadcast(other), "other")
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("at"))
    number = lambda sig, chunk: F.col(sig).cast("long") * (1 << 24) + F.col(chunk)
    met = met.select("print", "step", number("sig", "chunk").alias("mine"), number("other", "at").alias("yours"))
    # a step from the lower to the upper tile or back: the step's own sign tells which side this one is
    first = F.when(F.col("step") == 0, F.col("mine") <= F.col("yours")).otherwise(F.col("step").isin(near[1:]))
    return met.select(F.when(first, F.col("mine")).otherwise(F.col("yours")).alias("low"),
                      F.when(first, F.col("yours")).otherwise(F.col("mine")).alias("high"),
                      F.when(first, 0).otherwise(1).alias("side"), "print")


def forest(one: np.ndarray, two: np.ndarray, count: int) -> np.ndarray:
    """Root (smallest index) of every node under the links one[i] - two[i]."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, root[one], low)
        np.minimum.at(new, root[two], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new


def compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the distinct fingerprints of one tile (right None) or between two tiles."""
    other = left if right is None else right
    near = np.bitwise_count(left[:, None] ^ other[None, :]) <= radius
    if right is None:
        near &= np.tri(len(left), k=-1, dtype=bool).T
    i, j = np.nonzero(near)
    if not len(i):
        return left[:0], left[:0]
    nodes = left if right is None else np.concatenate([left, right])
    root = forest(i, j if right is None else j + len(left), len(nodes))
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[root[moved]]


def link_tiles(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the tile pair that may go on in the next batch
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            cuts = np.nonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))[0] + 1
            last = cuts[-1] if len(cuts) else 0
            yield from emit([x[:last] for x in cols], cuts[:-1])
            rest = [x[last:] for x in cols]
        if rest is not None and len(rest[0]):
            yield from emit(rest, np.array([], dtype=np.int64))

    def emit(cols: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        ends = [0, *cuts.tolist(), len(cols[0])]
        for start, end in zip(ends[:-1], ends[1:]):
            if end - start < 2:
                continue
            marks = cols[3][start:end].view(np.uint64)
            if cols[0][start] == cols[1][start]:
                links = compare(marks, None, radius)
            else:
                right = cols[2][start:end] == 1
                links = compare(marks[~right], marks[right], radius)
            if len(links[0]):
                out.append(links)
        if out:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


def links(marks: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span every component of distinct fingerprints within ``radius`` bits."""
    pairs = tiles(marks, radius)
    # partition number left to the session; a tile pair has at most 2 * TILE rows
    dealt = pairs.repartition(F.col("low"), F.col("high")).sortWithinPartitions("low", "high")
    return dealt.mapInArrow(link_tiles(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked directly or through others).

    One row per input row. Null and empty texts have fingerprint zero and link like any other; rows with a null
    id get the component's smallest id (null where no row of it has one). Repeated rows stay repeated. Columns
    other than doc_id and text are ignored. An empty table gives no rows.
    """
    prints = store(fingerprints(docs), "prints")
    marks = store(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "marks")
    found = components(links(marks.select("print"), radius))
    ids = found.withColumnRenamed("node", "print").join(marks, "print")
    lowest = ids.groupBy("root").agg(F.min("first").alias("linked_id"))
    linked = ids.join(lowest, "root").select("print", "linked_id")
    # fingerprints of one row without a link need no partner in the join back
    groups = marks.where("n > 1").join(linked, "print", "full").select(
        "print", F.coalesce("linked_id", "first").alias("component"))
    out = prints.join(store(groups, "groups"), "print", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                      F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id; all columns stay.

    Groups are of texts, not of ids: different texts of one id are judged apart, and of rows that are not near one
    another none goes. Rows without an id come after all others in the choice. Rows of the same id and text count as
    one document, whatever their other columns hold, and one of them stays. Ties of the id go to the smaller hash of
    id and text. An empty table gives no rows.

    Only keys and fingerprints are grouped; texts meet the list of rows that go or are repeated, no more.
    """
    reach_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), raw_text().alias("text"))
    prints = store(rows.mapInArrow(print_batches, "doc_id long, key long, print long"), "row-prints")
    marks = store(prints.groupBy("key", "doc_id", "print").agg(F.count("*").alias("n")), "row-marks")
    found = components(links(marks.select("print").distinct(), radius)).withColumnRenamed("node", "print")
    grouped = marks.join(found, "print", "left").select("key", "doc_id", "n", F.coalesce("root", "print").alias("root"))
    grouped = store(grouped, "row-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = grouped.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    # what stays as it is needs no partner in the join with the texts
    judged = grouped.join(first.where("rows > 1"), "root", "left").select(
        "key", (F.col("first.key") != F.col("key")).alias("goes"), "n")
    judged = store(judged.where("goes or n > 1").select("key", F.coalesce("goes", F.lit(False)).alias("goes")), "near-duplicates")
    key, goes = free_name(docs, "row_key"), free_name(docs, "row_goes")
    keyed = docs.withColumn(key, row_key())
    met = keyed.join(judged.select(F.col("key").alias(key), F.col("goes").alias(goes)), key, "left")
    out = met.where(F.col(goes).isNull()).select(*quoted(docs))
    if judged.where("not goes").isEmpty():
        return out
    # copies are reduced in each task before the shuffle
    return out.unionByName(met.where(~F.col(goes)).dropDuplicates([key]).select(*quoted(docs)))
