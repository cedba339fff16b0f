"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector of whole-number impacts, an item one of term weights; the score is their inner product.
Documents are gathered in trees of bounded size. A node knows the centroid c and radius r of its documents, so no
document below it scores more than q.c + |q'| * r, q' being the item's weights of terms that occur below the node. Nodes
are taken best-first, and a subtree goes unread once its bound, rounded up past every error of the sums, is below the
score that the item's last place already has. Leaves are scored in whole numbers. Trees are built once and stored; a
first pass reads each item's most promising leaf of every tree, which gives the floors of the second pass.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from basketry.llm.decontaminate import passage_blocks
from basketry.llm.shared import raw_text, reach_workers, store

BEST = 50
BLOCK_CHARS = 1 << 18  # characters of the items that are searched together
TREE_DOCS = 2048
TREE_ENTRIES = 1 << 20  # entries of a tree's documents; a longer document has a tree of its own
LEAF_DOCS = 64
EPS = float(np.finfo(np.float64).eps)

# Bytes of a term, A-Z in lower case; in UTF-8 every byte of a character beyond ASCII is above 0x7F.
TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TO_TERMS = bytes(b if b in TERM_BYTES else ord(" ") for b in bytes(range(256)).lower())

VECTORS = pa.schema([("doc_id", pa.int64()), ("docs", pa.int64()), ("size", pa.int64()), ("terms", pa.binary()), ("times", pa.binary())])
VECTORS_DDL = "doc_id long, docs long, size long, terms binary, times binary"
HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
HITS_DDL = "item int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TO_TERMS).split()


def vector_batches(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with a term of the vocabulary, one row for all others of a batch."""
        for batch in batches:
            ids, sizes, terms, times, others, length = [], [], [], [], 0, 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                own = [k for k in map(vocabulary.get, words) if k is not None]
                if own:
                    found, n = np.unique(np.array(own, dtype=np.int32), return_counts=True)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append(found.tobytes())
                    times.append(n.astype(np.int32).tobytes())
                elif words:
                    others, length = others + 1, length + len(words)
            rows = [[*ids, None], [1] * len(ids) + [others], [*sizes, length], [*terms, None], [*times, None]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, VECTORS)], schema=VECTORS)

    return run


def presence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) partial document counts."""
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int32)
        term, n = np.unique(flat, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n, pa.int64())], names=["term", "df"])


@dataclass
class Rows:
    """Sparse vectors: row i has entries starts[i] to starts[i + 1] - 1, one at least."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        starts = np.append(0, np.cumsum(sizes))
        at = np.arange(starts[-1]) + np.repeat(self.starts[:-1][rows] - starts[:-1], sizes)
        return Rows(starts, self.terms[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.terms], self.starts[:-1])

    def squares(self) -> np.ndarray:
        return np.add.reduceat(self.values.astype(np.float64) ** 2, self.starts[:-1])


@dataclass
class Tree:
    """Documents in leaf order and nodes; node k has documents begins[k] to ends[k] - 1 and children lefts[k], lefts[k] + 1 (0: a leaf)."""

    ids: np.ndarray
    known: np.ndarray  # false where the document has no id
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    lefts: np.ndarray
    radii: np.ndarray
    centre_starts: np.ndarray
    centre_terms: np.ndarray
    centres: np.ndarray


KINDS = {"ids": np.int64, "known": np.bool_, "starts": np.int64, "terms": np.int32, "values": np.int32, "begins": np.int32,
         "ends": np.int32, "lefts": np.int32, "radii": np.float64, "centre_starts": np.int64, "centre_terms": np.int32,
         "centres": np.float32}
TREES = pa.schema([(name, pa.binary()) for name in KINDS])
TREES_DDL = ", ".join(f"{name} binary" for name in KINDS)


def impacts(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Whole-number impact of a term that occurs so often in a document of that norm; below 10^6."""
    return (1_000_000_000 * times) // (1000 * times + 20 * norm)


def build(ids: np.ndarray, known: np.ndarray, rows: Rows, width: int, leaf: int = LEAF_DOCS) -> Tree:
    """Ball tree by median cuts between two distant documents; equal documents are cut in half as they stand."""
    order = np.arange(len(ids))
    begins, ends, lefts, radii, centres = [0], [len(ids)], [0], [], []
    node, dense = 0, np.zeros(width)
    while node < len(begins):
        begin, end = begins[node], ends[node]
        own = rows.take(order[begin:end])
        support, place = np.unique(own.terms, return_inverse=True)
        centre = (np.bincount(place, weights=own.values) / (end - begin)).astype(np.float32)
        dense[support] = centre
        squares, middle = own.squares(), float(np.sum(centre.astype(np.float64) ** 2))
        away = squares - 2 * own.dot(dense) + middle
        # each sum has no more terms than the support; (|x| + |c|)^2 <= 2 (|x|^2 + |c|^2) bounds what is summed
        slack = 4 * (len(support) + 16) * EPS * (squares + middle)
        radii.append(math.sqrt(float(np.max(np.maximum(away, 0) + slack))) * (1 + 8 * EPS))
        centres.append((support, centre))
        dense[support] = 0
        if end - begin > leaf:
            one = own.take(np.array([int(np.argmax(away))]))
            dense[one.terms] = one.values
            to_one = squares - 2 * own.dot(dense)
            two = own.take(np.array([int(np.argmax(to_one))]))
            dense[one.terms] = 0
            dense[two.terms] += two.values
            to_two = squares - 2 * own.dot(dense)
            dense[two.terms] = 0
            order[begin:end] = order[begin:end][np.argsort(to_one - to_two, kind="stable")]
            half = begin + (end - begin) // 2
            lefts[node] = len(begins)
            begins += [begin, half]
            ends += [half, end]
            lefts += [0, 0]
        node += 1
    sorted_rows = rows.take(order)
    return Tree(ids[order], known[order], sorted_rows.starts, sorted_rows.terms, sorted_rows.values, np.array(begins), np.array(ends),
                np.array(lefts), np.array(radii), np.append(0, np.cumsum([len(s) for s, _ in centres])),
                np.concatenate([s for s, _ in centres]), np.concatenate([c for _, c in centres]))


def tree_batches(documents: int, length: int, width: int):
    """Trees over consecutive rows of vectors. ``documents``, ``length``: N and L of the collection."""

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        ids, sizes, terms, times = zip(*parts)
        counts = [len(x) for x in terms]
        norm = np.array([50 + 50 * n * documents // length for n in sizes], dtype=np.int64)
        values = impacts(np.concatenate(times).astype(np.int64), np.repeat(norm, counts))
        rows = Rows(np.append(0, np.cumsum(counts)), np.concatenate(terms), values)
        tree = build(np.array([x or 0 for x in ids], dtype=np.int64), np.array([x is not None for x in ids]), rows, width)
        return pa.RecordBatch.from_arrays([pa.array([getattr(tree, n).astype(k).tobytes()], pa.binary()) for n, k in KINDS.items()],
                                          schema=TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries = [], 0
        for batch in batches:
            for doc_id, size, terms, times in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = np.frombuffer(terms, dtype=np.int32)
                if parts and (len(parts) >= TREE_DOCS or entries + len(own) > TREE_ENTRIES):
                    yield pack(parts)
                    parts, entries = [], 0
                parts.append((doc_id, size, own, np.frombuffer(times, dtype=np.int32)))
                entries += len(own)
        if parts:
            yield pack(parts)

    return run


@dataclass
class Items:
    """Sparse weights of the items of a block, each with a term at least."""

    numbers: np.ndarray
    rows: Rows
    width: int


class Best:
    """An item's best documents so far: score descending, then id ascending, those without id last."""

    def __init__(self, size: int, floor: int):
        self.size, self.floor = size, floor  # floor: what a document must score to count, 1 at least
        self.scores, self.ids, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        scores = np.concatenate([self.scores, scores[good]])
        ids, known = np.concatenate([self.ids, ids[good]]), np.concatenate([self.known, known[good]])
        order = np.lexsort((ids, ~known, -scores))[:self.size]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]
        if len(order) == self.size:
            self.floor = max(self.floor, int(self.scores[-1]))


class Reader:
    """Bounds and leaf scores of one tree for the items of a block."""

    def __init__(self, tree: Tree, items: Items):
        self.tree, self.items, self.leaves = tree, items, {}
        rows, starts = items.rows, items.rows.starts[:-1]
        weights = rows.values.astype(np.float64)
        self.bounds = np.empty((len(tree.begins), len(items.numbers)))
        dense, inside = np.zeros(items.width), np.zeros(items.width)
        for node, radius in enumerate(tree.radii):
            span = slice(tree.centre_starts[node], tree.centre_starts[node + 1])
            support = tree.centre_terms[span]
            dense[support], inside[support] = tree.centres[span], 1
            product = np.add.reduceat(weights * dense[rows.terms], starts)
            norm = np.sqrt(np.add.reduceat(weights**2 * inside[rows.terms], starts))
            # all terms are positive: rounding errors are a share of the sum
            self.bounds[node] = (product + norm * radius) * (1 + 4 * (len(support) + 16) * EPS) + 1
            dense[support] = inside[support] = 0
        self.place = np.full(items.width, -1, dtype=np.int64)

    def score(self, node: int, item: int, best: Best) -> None:
        """Exact scores of a leaf's documents."""
        tree = self.tree
        begin, end = int(tree.begins[node]), int(tree.ends[node])
        if node not in self.leaves:
            span = slice(int(tree.starts[begin]), int(tree.starts[end]))
            terms, column = np.unique(tree.terms[span], return_inverse=True)
            table = np.zeros((len(terms), end - begin), dtype=np.int32)
            table[column, np.repeat(np.arange(end - begin), np.diff(tree.starts[begin:end + 1]))] = tree.values[span]
            self.leaves[node] = terms, table
        terms, table = self.leaves[node]
        rows = self.items.rows
        span = slice(rows.starts[item], rows.starts[item + 1])
        at = np.minimum(np.searchsorted(terms, rows.terms[span]), len(terms) - 1)
        here = terms[at] == rows.terms[span]
        if here.any():
            scores = rows.values[span][here] @ table[at[here]].astype(np.int64)
            best.add(scores, tree.ids[begin:end], tree.known[begin:end])

    def probe(self, item: int, best: Best) -> None:
        """The leaf that the better bound leads to at every node."""
        node, bounds = 0, self.bounds[:, item]
        while left := int(self.tree.lefts[node]):
            node = left if bounds[left] >= bounds[left + 1] else left + 1
        if bounds[node] >= best.floor:
            self.score(node, item, best)

    def search(self, item: int, best: Best) -> None:
        """Leaves in falling order of their bounds, until no bound reaches the item's floor."""
        bounds = self.bounds[:, item]
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= best.floor:
            node = heapq.heappop(heap)[1]
            left = int(self.tree.lefts[node])
            if left:
                for child in (left, left + 1):
                    if bounds[child] >= best.floor:
                        heapq.heappush(heap, (-bounds[child], child))
            else:
                self.score(node, item, best)


def hit_batches(items, size: int, floors: np.ndarray, whole: bool):
    """The best documents of every item among a task's trees. ``whole``: search, else only probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Items = items.value
        best = [Best(size, int(f)) for f in floors]
        for batch in batches:
            for k in range(batch.num_rows):
                tree = Tree(**{n: np.frombuffer(batch.column(n)[k].as_buffer(), dtype=kind) for n, kind in KINDS.items()})
                reader = Reader(tree, own)
                for item in range(len(best)):
                    (reader.search if whole else reader.probe)(item, best[item])
        for item, x in enumerate(best):
            if len(x.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.ids), item, dtype=np.int32)), pa.array(x.ids, mask=~x.known),
                                                  pa.array(x.scores)], schema=HITS)

    return run


def first_places(hits: DataFrame, size: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def search_block(docs: DataFrame, block: list[tuple[int, str]], size: int) -> DataFrame | None:
    """Results for a block of (item_id, text); None if no item has a term."""
    spark = docs.sparkSession
    texts = [(i, sorted(set(terms_of(t.encode())))) for i, t in block]
    texts = [(i, t) for i, t in texts if t]
    if not texts:
        return None
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, own in texts for t in own}))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    vectors = store(rows.mapInArrow(vector_batches(vocabulary), VECTORS_DDL), "lexical-vectors")
    total = vectors.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    held = vectors.where("terms is not null")
    df = np.zeros(len(vocabulary), dtype=np.int64)
    # a row for each term of the block
    for term, n in held.select("terms").mapInArrow(presence_batches, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    parts = [np.array([vocabulary[t] for t in own], dtype=np.int32) for _, own in texts]
    flat = np.concatenate(parts)
    items = spark.sparkContext.broadcast(Items(np.array([i for i, _ in texts]), Rows(
        np.append(0, np.cumsum([len(p) for p in parts])), flat, weights[flat]), len(vocabulary)))
    trees = held.select("doc_id", "size", "terms", "times").mapInArrow(tree_batches(total.docs, total.size, len(vocabulary)), TREES_DDL)
    trees = store(trees, "lexical-trees")
    floors = np.ones(len(texts), dtype=np.int64)
    probed = first_places(trees.mapInArrow(hit_batches(items, size, floors, False), HITS_DDL), size)
    # a row for each item of the block
    for item, places, last in probed.groupBy("item").agg(F.count("*"), F.min("score")).collect():
        if places == size:
            floors[item] = last
    best = first_places(trees.mapInArrow(hit_batches(items, size, floors, True), HITS_DDL), size)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(texts)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, size: int = BEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``size`` best documents of every item: item_id, rank (from 1), doc_id, score above 0.

    Null and empty texts have no term: they hold nothing, find nothing and do not count as documents. Items without id or
    text are left out; items of one id are ranked each. Rows of one doc_id are documents of their own; rows without
    id come after others of their score. Items are taken in blocks of about ``block_chars``, each with its own pass over the
    documents. Other columns are not read. Empty tables give no rows.
    """
    reach_workers(docs.sparkSession)
    out = None
    for block in passage_blocks(benchmark, block_chars):
        part = search_block(docs, block, size)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
