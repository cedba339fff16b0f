"""Byte-pair encoding by speculation: greedy longest match, checked pair by pair, merged exactly where it fails.

A token sequence is the merge result of a word if and only if every token is the merge result of its own text and
no merge would have crossed the boundary of two neighbours. The greedy proposal is checked for all new words of a
batch at once with numpy; only words with a crossed boundary go through the merge loop.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from basketry.llm.pretokens import WORD_PIECES, byte_letters, is_latin
from basketry.llm.shared import raw_text, reach_workers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SUFFIX, END = "</w>", "\U0010ffff"  # the word end as one character while matching
WORDS_KEPT = 300_000  # bound of the word memory of one worker
NEVER = np.int64(1) << 40


class Merges:
    """Tables of a vocabulary: halves and rank of every token, and the token of every pair."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.text = {i: t for t, i in vocab.items()}
        ends = {t: (t.removesuffix(SUFFIX) + END if t.endswith(SUFFIX) and t != SUFFIX else t) for t in vocab}
        self.ids = {ends[t]: i for t, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        size = max(vocab.values()) + 1
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)  # when the token is made; -1: not by a merge
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.size = size
        for rank, pair in enumerate(merges):
            one, two = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = vocab[self.text[one] + self.text[two]]
            if (one, two) in self.pairs:
                continue
            self.pairs[one, two] = rank, made
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = one, two, rank
        codes = np.array([a * size + b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.code_rank = np.array([r for r, _ in self.pairs.values()], dtype=np.int64)[order]
        # tokens that merging their own text does not give are no proposal
        self.usable = {t: i for t, i in self.ids.items() if self.rank[i] < 0 or self.exact(t) == [i]}

    def exact(self, word: str) -> list[int]:
        """Merge a word (its end marked) by rank, leftmost first."""
        symbols = list(word)
        if len(symbols) > 1 and symbols[-1] == END:
            symbols[-2:] = ["".join(symbols[-2:])]
        ids: list[int] = [self.ids[x] for x in symbols]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pairs.get((ids[i], ids[j]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(len(ids)):
            offer(i)
        while queue:
            _, i, one, two, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != one or j < 0 or ids[j] != two:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the last token holds the word's end."""
        out, at, usable, size = [], 0, self.usable, len(word)
        while at < size:
            for end in range(min(size, at + self.longest), at, -1):
                found = usable.get(word[at:end])
                if found is not None and end != size - 1:  # the end mark is no token of its own
                    break
            out.append(found)
            at = end
        return out

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would no merge have crossed their boundary?

        Goes back in time: the piece of the boundary that was made last is undone first. A crossing merge takes
        place when its rank comes before the merge that uses up the left piece, and not after that of the right.
        """
        one, two = one.copy(), two.copy()
        until_one, until_two = np.full(len(one), NEVER), np.full(len(one), NEVER)
        good, open_ = np.ones(len(one), dtype=bool), np.arange(len(one))
        while len(open_):
            a, b = one[open_], two[open_]
            code = a * self.size + b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[at] == code, self.code_rank[at], NEVER)
            crossed = (rank < until_one[open_]) & (rank <= until_two[open_]) & (rank < NEVER)
            good[open_[crossed]] = False
            born_a, born_b = self.rank[a], self.rank[b]
            undo_a = born_a > born_b
            done = crossed | ((born_a < 0) & (born_b < 0))
            x = open_[undo_a]
            until_one[x], one[x] = born_a[undo_a], self.right[a[undo_a]]
            x = open_[~undo_a & (born_b >= 0)]
            until_two[x], two[x] = self.rank[two[x]], self.left[two[x]]
            open_ = open_[~done]
        return good

    def words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of every word, and how many words needed exact merging."""
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.fromiter((x for p in proposed for x in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.nonzero(owner[1:] == owner[:-1])[0]
        codes, where = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = ~self.compatible(codes // self.size, codes % self.size)[where]
        failed = np.unique(owner[inner[bad]])
        for k in failed.tolist():
            proposed[k] = self.exact(words[k])
        return proposed, len(failed)


class Memory(dict):
    """Remembered words; those of the current batch beyond the bound are only passing."""

    passing: dict = {}

    def __missing__(self, word):
        return self.passing[word]


class WordEncoder:
    """Texts to ids and back; per word it remembers the ids and the decoded text, both as text.

    The library gives the normalised words of texts outside Latin-1; special tokens are cut out before.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.token = self.merges.text | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.letters = byte_letters()
        self.ids, self.texts = Memory(), Memory()

    def bytes_of(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode()])

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as they are, other words with a leading blank if not Latin-1."""
        if self.marks is None:
            return self.words(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):  # every second part is a mark
            out += [part] if k % 2 else self.words(part)
        return out

    def words(self, text: str) -> list[str]:
        if is_latin(text):
            return WORD_PIECES.findall(text.lower())
        return [" " + x for x, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])

    def learn(self, words: list[str]) -> None:
        marked = [w for w in words if w not in self.special]
        found, _ = self.merges.words([(w[1:] if w[0] == " " else self.bytes_of(w)) + END for w in marked])
        found += [[self.special[w]] for w in words if w in self.special]
        marked += [w for w in words if w in self.special]
        room = max(0, WORDS_KEPT - len(self.ids))
        for memory, values in ((self.ids, [" ".join(map(str, x)) for x in found]),
                               (self.texts, [self.decode(x) for x in found])):
            memory.update(zip(marked[:room], values))
            memory.passing = dict(zip(marked[room:], values[room:]))

    def encode(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Per text: ids in decimal and tokens, each joined by one space."""
        cut = [self.pieces(t) for t in texts]
        self.learn(list(set().union(*cut).difference(self.ids)))
        ids, shown = self.ids.__getitem__, self.texts.__getitem__
        return [" ".join(map(ids, x)) for x in cut], [" ".join(map(shown, x)) for x in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def text_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, rows: int = 512):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            yield piece.column(0), *encoder(vocabulary).encode([x.decode() for x in piece.column(1).to_pylist()])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>), decoded (the tokens joined by one space), one row per row of ``docs``.

    A null text is empty and has no ids. Other columns are ignored; ids may be null or repeated.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, shown in text_batches(batches, vocabulary):
            lists = [list(map(int, x.split())) for x in ids]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(lists, pa.list_(pa.int32())), pa.array(shown, pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    reach_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``encode`` gives, without moving the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for doc_ids, ids, shown in text_batches(batches, vocabulary):
            counts = pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids, counts, pa.array(list(map(digest, ids)), pa.string()),
                                              pa.array(list(map(digest, shown)), pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    reach_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
