"""Token ids as Parquet list columns with controlled row groups, encodings and page indexes."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from basketry.llm.files import attempt_name, make_folder, open_folder
from basketry.llm.pretokens import SPACED_PIECES, byte_letters, is_latin
from basketry.llm.shared import raw_text, reach_workers, store
from basketry.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES_KEPT = 200_000  # bound of the piece memory of one worker
FILE = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
FILE_DDL = "doc_id long, at long, n_tokens long, tokens array<int>"
MANIFEST_DDL = "part long, file string, docs long, tokens long"


class Memory(dict):
    """Ids of pieces, asked for when a piece is first met; those beyond the bound are kept in ``passing``."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of = ids_of
        self.passing: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.passing.get(piece)
        if ids is None:
            ids = self.ids_of(piece)
            (self if len(self) < PIECES_KEPT else self.passing)[piece] = ids
        return ids


class PieceEncoder:
    """The tokenizers library over distinct pieces; frequent pieces are remembered as id bytes.

    Merges never cross a piece, so ids of a text are those of its pieces in turn. Texts outside Latin-1 or
    with a special token go to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.known = Memory(self.piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one piece from the library's model, which needs no cutting."""
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, SPACED_PIECES.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        self.known.passing.clear()  # of the last batch
        return [self.cut(t) if is_latin(t) and not any(s in t for s in self.special) else self.whole(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = 0,
                 encoding: str = "dictionary", group_tokens: int = 1 << 20, page_bytes: int = 64 << 10) -> DataFrame:
    """Encode all documents and write their ids in ascending doc_id order; the manifest (part, file, docs, tokens).

    Files hold doc_id, ``at`` (ids before the document in its file), n_tokens and the list of ids, end id included.
    A row group ends after ``group_tokens`` ids. ``encoding`` of the ids is "dictionary" or "delta". Pages have an
    index, so a filter on doc_id skips row groups and pages. Documents with a null id come first; rows of the same
    id are in the order of their texts; a null text is empty and has the end id only.
    """
    reach_workers(docs.sparkSession)
    make_folder(folder)
    options = {"compression": "zstd", "write_page_index": True, "data_page_size": page_bytes}
    if encoding == "dictionary":
        options["use_dictionary"] = ["tokens.list.element"]
    elif encoding == "delta":
        options |= {"use_dictionary": False, "column_encoding": {"tokens.list.element": "DELTA_BINARY_PACKED"}}
    else:
        raise ValueError(encoding)
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        out, name, docs_done, tokens_done = None, attempt_name(0, ".parquet"), 0, 0
        held: list[tuple[int | None, bytes]] = []
        held_tokens = 0

        def flush() -> None:
            nonlocal out, docs_done, tokens_done, held_tokens
            if out is None:
                out = pq.ParquetWriter(f"{path}/{name}", FILE, filesystem=files, **options)
            sizes = np.array([len(x) // 4 for _, x in held], dtype=np.int64)
            ends = np.cumsum(sizes)
            values = pa.array(np.frombuffer(b"".join(x for _, x in held), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            rows = pa.Table.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array(tokens_done + ends - sizes),
                                         pa.array(sizes), lists], schema=FILE)
            out.write_table(rows, row_group_size=len(held))
            docs_done, tokens_done = docs_done + len(held), tokens_done + int(ends[-1])
            held.clear()
            held_tokens = 0

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                piece = batch.slice(start, 128)
                texts = [x.decode() for x in piece.column(1).to_pylist()]
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder(vocabulary).encode(texts)):
                    held.append((doc_id, ids + end))
                    held_tokens += len(ids) // 4 + 1
                    if held_tokens >= group_tokens:
                        flush()
        if held:
            flush()
        if out is not None:
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [docs_done], "tokens": [tokens_done]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(write, MANIFEST_DDL), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, tokens, from the files that the manifest names.

    Columns that are not selected are not read. The manifest has one row per file, which bounds the broadcast.
    """
    spans = manifest.select("part", "file", "tokens").orderBy("part").collect()  # one row per file
    starts, total = [], 0
    for span in spans:
        starts.append((span.file, total))
        total += span.tokens
    bases = spark.createDataFrame(starts, "file string, base long")
    files = spark.read.schema(FILE_DDL).parquet(folder).withColumn("file", F.col("_metadata.file_name"))
    return files.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "tokens")


def checksum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
        at = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the ids of all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch_path(spark, "tokens")
    rows = read_tokens(spark, folder, write_tokens(docs, folder))
    return rows.mapInArrow(checksum_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
