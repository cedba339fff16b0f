"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs with at most e edits shares m + 1 - q - q * e q-grams with its occurrence, all
on diagonals (text position minus passage position) at most e from one another's mean. Shared q-grams are counted in
overlapping bands of diagonals; bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.shared import raw_text, reach_workers

Q = 8
EDIT_RATE = 0.1
BLOCK_CHARS = 4 << 20  # passages of one pass, in characters
SLICE = 1 << 21  # characters of documents handled at once
FILTER_BITS = 22
POSTINGS = 1 << 21  # shared q-grams expanded at once
MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()),
                     ("edits", pa.int64()), ("similarity", pa.float64())])
MATCHES_DDL = "doc_id long, item_id long, begin long, end long, edits long, similarity double"


def normalise(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that begins at each position."""
    out = np.zeros(max(0, len(chars) - q + 1), dtype=np.uint64)
    letters = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(q if len(out) else 0):
        out = out * np.uint64(0x100000001B3) + letters[k:k + len(out)]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Passages:
    """q-grams of a block of passages, by hash."""

    ids: list[int]
    texts: list[str]
    q: int
    budgets: np.ndarray  # edits allowed
    bounds: np.ndarray  # q-grams that an occurrence shares at least
    hashes: np.ndarray  # distinct, sorted
    starts: np.ndarray  # first posting of each hash
    items: np.ndarray  # postings
    places: np.ndarray
    maybe: np.ndarray  # by the upper bits of the hash


def index_passages(rows: list[tuple[int, str]], q: int, rate: float) -> Passages:
    """Index (item_id, text). The edit budget is rate * m, or less where the lemma would give no bound of one q-gram."""
    kept = [(i, t) for i, t in ((i, normalise(t or "")) for i, t in rows) if len(t) >= q]
    sizes = np.array([len(t) for _, t in kept], dtype=np.int64)
    budgets = np.minimum((rate * sizes).astype(np.int64), (sizes - q) // q)
    each = [grams(code_points(t), q) for _, t in kept]
    flat = np.concatenate(each) if each else np.array([], dtype=np.uint64)
    items = np.repeat(np.arange(len(kept)), [len(x) for x in each])
    places = np.concatenate([np.arange(len(x)) for x in each]) if each else flat.astype(np.int64)
    order = np.argsort(flat, kind="stable")
    hashes, starts = np.unique(flat[order], return_index=True)
    maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
    maybe[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return Passages([i for i, _ in kept], [t for _, t in kept], q, budgets, sizes + 1 - q - q * budgets, hashes,
                    np.append(starts, len(flat)), items[order], places[order], maybe)


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best occurrence of a passage whose diagonals lie in low..high; None beyond budget.

    Rows of the table are passage characters, columns the diagonals of the band, so a substitution stays in its
    column, a missing text character comes from the right and an extra one from the left. The text is padded with a
    character that equals no other: to replace by it costs as much as to leave out.
    """
    width = high - low + 1
    front, back = max(0, -low), max(0, high + len(passage) - len(text))
    padded = np.concatenate([np.zeros(front, dtype=np.uint32), text, np.zeros(back, dtype=np.uint32)])
    at = low + front
    unit = np.int64(1) << 32  # cost * 2^32 + first diagonal: the least cost, then the least begin, by one comparison
    row, ramp = np.arange(width, dtype=np.int64), np.arange(width) * unit
    for i, letter in enumerate(passage):
        step = row + (padded[at + i:at + i + width] != letter) * unit
        np.minimum(step[:-1], row[1:] + unit, out=step[:-1])
        row = np.minimum.accumulate(step - ramp) + ramp
        if i % 16 == 15 and row.min() >> 32 > budget:
            return None
    best = int(np.argmin(row))
    edits, begin = int(row[best] >> 32), low + int(row[best] & (unit - 1))
    if edits > budget:
        return None
    return edits, max(0, begin), min(len(text), low + best + len(passage))


def posting_chunks(found: Passages, at: np.ndarray, slot: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(posting, text position, first position not yet covered) for runs of hits of about ``size`` postings."""
    counts = found.starts[slot + 1] - found.starts[slot]
    ends = np.cumsum(counts)
    first = 0
    while first < len(at):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + size, side="right")))
        own = counts[first:last]
        inner = np.cumsum(own)
        posting = np.arange(inner[-1]) - np.repeat(inner - own - found.starts[slot[first:last]], own)
        yield posting, np.repeat(at[first:last], own), int(at[last]) if last < len(at) else np.iinfo(np.int64).max
        first = last


def candidate_bands(found: Passages, chars: np.ndarray, chunk: int = POSTINGS) -> tuple[np.ndarray, np.ndarray]:
    """(item, band) of all bands that share enough q-grams; band b holds diagonals b * s to (b + 2) * s - 1, s = 2e + 1.

    Shared q-grams are expanded ``chunk`` at a time; a band is counted when no later text position can reach it, so
    memory does not grow with the repetitions in a text.
    """
    hashed = grams(chars, found.q)
    at = np.flatnonzero(found.maybe[hashed >> np.uint64(64 - FILTER_BITS)])
    slot = np.minimum(np.searchsorted(found.hashes, hashed[at]), len(found.hashes) - 1)
    real = found.hashes[slot] == hashed[at]
    at, slot = at[real], slot[real]
    steps, sizes = 2 * found.budgets + 1, np.array([len(t) for t in found.texts], dtype=np.int64)
    origins = np.cumsum(sizes) - sizes  # a passage place as one number among those of all passages
    total, shift = int(sizes.sum()), int(sizes.max(initial=0)) + 2  # bands + shift are positive

    def expand() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        for posting, position, rest in posting_chunks(found, at, slot, chunk):
            item = found.items[posting]
            band = (position - found.places[posting]) // steps[item]
            mixed = (item * 0x9E3779B1 + band * 0x85EBCA77) & ((1 << 21) - 1)
            # the second band of a diagonal is the one before
            before = (item * 0x9E3779B1 + (band - 1) * 0x85EBCA77) & ((1 << 21) - 1)
            yield (np.concatenate([item, item]), np.concatenate([band, band - 1]), np.concatenate([mixed, before]),
                   np.concatenate([found.places[posting]] * 2), rest)

    postings = int((found.starts[slot + 1] - found.starts[slot]).sum())
    chunks = list(expand()) if postings <= chunk else None  # one chunk is kept, more are expanded again
    crude = np.zeros(1 << 21, dtype=np.int64)
    for _, _, mixed, _, _ in chunks or expand():
        crude += np.bincount(mixed, minlength=1 << 21)
    out_items, out_bands = [], []
    held = np.array([], dtype=np.int64)
    for item, band, mixed, place, rest in chunks or expand():
        # crude counts by a hash of (item, band) leave few rows for the exact count
        enough = crude[mixed] >= found.bounds[item]
        # a passage place counts once in a band, however often a repetitive text holds its q-gram
        fresh = (band[enough] + shift) * total + origins[item[enough]] + place[enough]
        held = np.union1d(held, fresh)
        band, spot = held // total - shift, held % total
        item = np.searchsorted(origins, spot, side="right") - 1
        closed = (band + 2) * steps[item] - 1 + sizes[item] < rest
        item, band, held = item[closed], band[closed], held[~closed]
        first = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]))) if len(item) else item
        times = np.diff(np.append(first, len(item)))
        keep = times >= found.bounds[item[first]]
        out_items.append(item[first][keep])
        out_bands.append(band[first][keep])
    none = np.array([], dtype=np.int64)
    item, band = np.concatenate([none, *out_items]), np.concatenate([none, *out_bands])
    order = np.lexsort((band, item))
    return item[order], band[order]


def occurrences(found: Passages, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits): the best occurrence of every passage in every text, in normalised characters."""
    start = 0
    while start < len(texts):
        parts, size, k = [], 0, start
        while k < len(texts) and (not parts or size < SLICE):
            parts.append(normalise(texts[k]))
            size, k = size + len(parts[-1]) + 1, k + 1
        chars = code_points("\n".join(parts))  # no normalised text holds a line break
        limits = np.cumsum([0] + [len(p) + 1 for p in parts])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, band in zip(*candidate_bands(found, chars)):
            budget, passage = int(found.budgets[item]), found.texts[item]
            step = 2 * budget + 1
            low, high = int(band) * step, (int(band) + 2) * step - 1
            # the band may lie across the border of two texts
            first = max(0, int(np.searchsorted(limits, max(0, low - budget), side="right")) - 1)
            last = min(len(parts) - 1, int(np.searchsorted(limits, high + len(passage) + budget, side="right")) - 1)
            for text in range(first, last + 1):
                begin = max(int(limits[text]), low - budget)
                end = min(int(limits[text + 1]) - 1, high + len(passage) + budget)
                if end - begin < len(passage) - budget:
                    continue
                held = best.get((text, int(item)))
                if held and held[0] == 0:
                    continue
                region = parts[text][begin - limits[text]:end - limits[text]]
                if (exact := region.find(passage)) >= 0:
                    result = (0, exact, exact + len(passage))
                else:
                    result = align(code_points(passage), code_points(region), low - budget - begin, high + budget - begin, budget)
                if result:
                    place = (result[0], result[1] + begin - int(limits[text]), result[2] + begin - int(limits[text]))
                    best[text, int(item)] = min(held, place) if held else place
        for (text, item), (edits, begin, end) in sorted(best.items()):
            yield start + text, item, begin, end, edits
        start = k


def passage_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of about ``block_chars``, each collected alone; rows without id or text are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield [(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and passage that occurs in it: doc_id, item_id, begin, end, edits, similarity.

    The best occurrence counts (fewest edits, then the first); begin and end are positions in the text in lower case
    with single blanks. Similarity is 1 - edits / passage length, 1 - ``rate`` at least. Passages below ``q``
    characters are not searched for; short ones have a budget that keeps the lemma's bound positive. Null and empty
    texts hold nothing; rows with a null id are reported under it, repeated rows are reported each. A benchmark of
    any size is taken in blocks, one pass over the documents each.
    """
    reach_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    out = None
    for block in passage_blocks(benchmark, block_chars):
        found = index_passages(block, q, rate)

        def run(batches: Iterator[pa.RecordBatch], found: Passages = found) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, result = batch.column(0).to_pylist(), []
                if len(found.hashes):
                    for text, item, begin, end, edits in occurrences(found, [x.decode() for x in batch.column(1).to_pylist()]):
                        result.append((ids[text], found.ids[item], begin, end, edits, 1 - edits / len(found.texts[item])))
                columns = list(zip(*result)) or [[]] * len(MATCHES)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MATCHES)], schema=MATCHES)

        part = rows.mapInArrow(run, MATCHES_DDL)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no passage; all columns stay, no row moves."""
    reach_workers(docs.sparkSession)
    place = docs.columns.index("text")
    for block in passage_blocks(benchmark, block_chars):
        found = index_passages(block, q, rate)

        def run(batches: Iterator[pa.RecordBatch], found: Passages = found) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                if len(found.hashes):
                    for text, *_ in occurrences(found, [x or "" for x in batch.column(place).to_pylist()]):
                        clean[text] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
