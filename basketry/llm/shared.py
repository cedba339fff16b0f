"""What the operators share: tables, stored intermediate results, connected components."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.session import scratch_path

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package, wherever the driver was started."""
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, known) if x)


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: a short lineage with a known size."""
    reach_workers(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_text(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def quoted(df: DataFrame) -> list:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def held_out(remainder: int, id_column: str = "doc_id"):
    """True for rows whose crc32 of the id as text has this remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): (node, root), root being the smallest node.

    Alternating large-star and small-star steps, each round stored in the shared folder. Every step is a
    grouped minimum and an equi-join on the node; no component is ever gathered in one task. Nodes without
    a partner, null ends and self loops give no row.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = store(pairs.where("a > b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == before:
            break
        before = (state.n, state.s)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = store(large.where("a > b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b")
        pairs = store(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return store(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "components")
