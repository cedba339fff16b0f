"""WARC archives: one gzip member per record, written and read back by tasks.

The reader goes through an archive once: incremental zlib decompression of one member at a time, framing by
Content-Length, and verification of block and payload digests. It holds one record in memory.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.llm.files import attempt_name, make_folder, open_folder
from basketry.llm.shared import raw_text, reach_workers, store
from basketry.session import scratch_path

CHUNK = 1 << 18
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
RECORD_DDL = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string, payload binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    digits = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def build_record(page_id: int | None, url: str | None, payload: bytes, response: int | None, date: str) -> bytes:
    """One WARC record; ``response`` is the page that a revisit refers to, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if response is None else b"")
    head = [("WARC-Type", "response" if response is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
            ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if response is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(response))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream in turn, each decompressed chunk by chunk."""
    raw = stream.read(CHUNK)
    while raw:
        unzip, plain = zlib.decompressobj(wbits=31), bytearray()
        while not unzip.eof:
            if not raw and not (raw := stream.read(CHUNK)):
                raise EOFError("the archive ends within a member")
            plain += unzip.decompress(raw, CHUNK)
            raw = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
        yield bytes(plain)
        raw = raw or stream.read(CHUNK)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block; ValueError where the framing or a digest is wrong."""
    head, mark, _ = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not mark or not version.startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    start = len(head) + 4
    end = start + int(fields["content-length"])
    if member[end:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the record")
    block = member[start:end]
    if fields.get("warc-block-digest", "") != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    return fields, block


def read_record(member: bytes) -> dict:
    """A record's row; the payload of a revisit is null, its size and digest are those of the full payload."""
    fields, block = parse_record(member)
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (digest != sha1_base32(payload) or int(sizes[0]) != len(payload)):
        raise ValueError("payload digest or size differs")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": page_of(fields.get("warc-refers-to")), "payload_bytes": int(sizes[0]),
            "payload_digest": digest, "payload": payload if kind == "response" else None}


def plan_records(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with ``response``: the page to refer to, null where the page's record is a response itself.

    Equal payloads are found by digest; only digests that occur more than once are joined back.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        raw_text("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= min_bytes)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    found = rows.join(store(shared.select("digest", "latest"), "shared-payloads"), "digest", "left")
    return found.select("page_id", "url", "payload",
                        F.when(F.col("latest") != F.col("page_id"), F.col("latest")).alias("response"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 64 << 20,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per page into files of about ``file_bytes``; the manifest (file, records, bytes).

    A page with a null id is always a response. Pages that share id and payload with the response are
    responses too. Null html is an empty payload, a null url gives no target line.
    """
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number, records, size = None, 0, 0, 0
        files, path = open_folder(folder)

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"file": name, "records": records, "bytes": size}], MANIFEST)

        for batch in batches:
            for page_id, url, payload, response in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    name, records, size = attempt_name(number, ".warc.gz"), 0, 0
                    out, number = files.open_output_stream(f"{path}/{name}", compression=None), number + 1
                member = gzip_member(build_record(page_id.as_py(), url.as_py(), payload.as_py(), response.as_py(), date))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    planned = plan_records(pages, min_bytes)
    return store(planned.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the manifest's files; a damaged record ends the job with an error."""
    reach_workers(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in members(stream):
                        row = read_record(member)
                        held += len(row["payload"] or b"") if payload else 64
                        rows.append(row if payload else row | {"payload": None})
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    # as many tasks as files, which have about the same size; a plain repartition by key would be merged again
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, RECORD_DDL)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = scratch_path(spark, "warc")
    records = read_archives(write_archives(pages, folder), folder, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
