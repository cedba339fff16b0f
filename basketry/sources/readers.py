"""Sources: raw menu exports and stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from basketry import vocab
from basketry.session import cut_lineage

# Doubled quotes inside quoted fields, as spreadsheets and data frames write them.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
RECORDS = pa.schema([("path", pa.string()), ("split", pa.int64()), ("kind", pa.int32()), ("record", pa.binary())])
RAW_COLUMNS = list(dict.fromkeys(vocab.RAW_HEADERS.values()))


def quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, split, value): physical lines in file order within each input split, split being its first byte."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def record_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (path, split, value, inside) to records (path, split, kind, record).

    ``inside`` tells whether the split begins within quotes. Kind 0 is a whole record, 1 what ends a record of an earlier
    split, 2 what a later split goes on with; a split that lies within one field is of kind 3. At the beginning of a file
    kind 0 is 4 and kind 2 is 5.
    """
    at, held, opened, from_before, fresh = None, [], False, False, False

    def kind_of(from_before: bool, ended: bool) -> int:
        return int(from_before) if ended else 2 + int(from_before)

    for batch in batches:
        out = {"path": [], "split": [], "kind": [], "record": []}

        def emit(place: tuple, kind: int, lines: list[bytes]) -> None:
            for name, value in zip(out, (*place, kind, b"\n".join(lines))):
                out[name].append(value)

        columns = [c.to_pylist() for c in batch.columns]
        for path, split, value, inside in zip(*columns):
            if (path, split) != at:
                if at is not None and held:
                    emit(at, 5 if fresh else kind_of(from_before, False), held)
                at, held, opened, from_before, fresh = (path, split), [], inside, inside, split == 0
            held.append(value)
            opened ^= value.count(b'"') % 2 == 1
            if not opened:
                emit(at, 4 if fresh else kind_of(from_before, True), held)
                held, from_before, fresh = [], False, False
        yield pa.RecordBatch.from_pydict(out, schema=RECORDS)
    if held:
        yield pa.RecordBatch.from_pydict({"path": [at[0]], "split": [at[1]], "kind": [5 if fresh else kind_of(from_before, False)],
                                          "record": [b"\n".join(held)]}, schema=RECORDS)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): the records of CSV files, one row each; first: it begins its file.

    Files are read by as many tasks as they have splits. A line break ends a record where the number of quotes before
    it in the file is even; quotes are counted per split, and the counts of the splits before tell each task how
    it begins. Only records that lie across splits, two parts for each split at most, are put together by a shuffle.
    Files with bytes that are not UTF-8 are read as Latin-1.
    """
    lines = quoted_lines(spark, path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("path", "split").agg(F.sum(quotes).alias("quotes"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "split", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
                           F.min("utf8").over(Window.partitionBy("path")).alias("utf8"))
    splits = cut_lineage(splits)  # a row a split
    rows = lines.withColumn("value", F.col("value").cast("binary")).join(F.broadcast(splits.drop("utf8")), ["path", "split"])
    parts = rows.select("path", "split", "value", "inside").mapInArrow(record_parts, "path string, split long, kind int, record binary")
    whole = parts.filter("kind in (0, 4)").select("path", "record", (F.col("kind") == 4).alias("first"))
    cut = parts.filter("kind in (1, 2, 3, 5)")
    # a part of kind 2 or 5 opens a record, those that follow it up to the next kind 1 go on with it
    order = Window.partitionBy("path").orderBy("split", "kind")
    numbered = cut.withColumn("number", F.sum(F.col("kind").isin(2, 5).cast("int")).over(order))
    joined = numbered.groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("split", "kind", "record"))).alias("parts"))
    mended = joined.select("path", F.aggregate(
        F.transform("parts", lambda x: x["record"]), F.lit(None).cast("binary"),
        lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, F.lit(b"\n"), x))).alias("record"),
        (F.get("parts", F.lit(0))["kind"] == 5).alias("first"))
    both = whole.unionByName(mended).join(F.broadcast(splits.groupBy("path").agg(F.min("utf8").alias("utf8"))), "path")
    text = F.when(F.col("utf8"), F.col("record").cast("string")).otherwise(F.decode("record", "ISO-8859-1"))
    return both.select(F.regexp_replace(text, "\r$", "").alias("record"), "first")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw export, every column as text.

    Only the header line is looked at for the schema. Quoted fields may hold line breaks, and files of any size
    are read by many tasks. Lines that do not fit the header keep their text in ``_corrupt_record``; empty lines are left
    out. Files may be UTF-8 or, one by one, Latin-1. A path without a header is an error.
    """
    header = spark.read.options(**CSV_OPTIONS).option("multiLine", True).csv(path).schema
    if not header.fields:
        raise ValueError(f"no header in {path}")
    fields = [T.StructField(f.name, T.StringType()) for f in header.fields]
    schema = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
    records = csv_records(spark, path).filter("not first and trim(record) != ''")
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = records.select(F.from_csv("record", F.lit(schema.toDDL()), options).alias("row"))
    return parsed.select(*[F.col(f"row.`{f.name}`") for f in schema.fields])


def corrupt_rows(raw: DataFrame) -> DataFrame:
    """One row: all rows of a raw export, and those that did not fit its header."""
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count("_corrupt_record").alias("corrupt"))


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename known headers, drop the rest; synonyms of one column fill each other's gaps."""
    found: dict[str, list[Column]] = {}
    for raw in df.columns:
        standard = vocab.RAW_HEADERS.get(raw.strip().lower())
        if standard:
            found.setdefault(standard, []).append(F.col(f"`{raw}`"))
    missing = [c for c in ("item_name", "price") if c not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    empty = F.lit(None).cast("string")
    return df.select(*[F.coalesce(*found.get(c, [empty])).alias(c) for c in RAW_COLUMNS])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, require: list[str] = ()) -> DataFrame:
    """Parquet table with a declared schema and a check of required columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    missing = [c for c in require if c not in table.columns]
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return table


def read_features(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Feature table that must already carry its ``_norm`` columns."""
    defaults = vocab.DEFAULT_USER_VECTOR if table == "user" else vocab.DEFAULT_RESTAURANT_VECTOR
    return read_table(spark, path, require=list(defaults))
