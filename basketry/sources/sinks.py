"""Sinks: every stage's output as partitioned files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.sources.readers import CSV_OPTIONS



def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> DataFrame:
    """Write and return the stored table; CSV joins list columns with "|"."""
    out = df
    if fmt == "csv":
        lists = [name for name, kind in df.dtypes if kind.startswith("array")]
        out = df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists}) if lists else df
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    reader = df.sparkSession.read.schema(out.schema)
    return reader.options(**CSV_OPTIONS).csv(path) if fmt == "csv" else reader.parquet(path)


def write_events(events: DataFrame, path: str, granularity: str = "day", spread: int = 16, tasks: int | None = None,
                 show: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cart events partitioned by time, so that a time split reads only the periods it needs.

    A busy period is written by up to ``spread`` tasks instead of one. ``show`` makes the events, row by row, of what is
    given instead: then only that moves, in ``tasks`` tasks.
    """
    dated = events.withColumn("event_date", F.to_date(F.date_trunc(granularity, F.col("ts").cast("timestamp"))))
    keys = ["event_date", F.pmod(F.xxhash64("session_id"), F.lit(spread))]
    spread_out = dated.repartition(tasks, *keys) if tasks else dated.repartition(*keys)
    return write_table(show(spread_out) if show else spread_out, path, partition_by=["event_date"])


def write_training_set(training: DataFrame, path: str) -> DataFrame:
    """Training rows with native list columns."""
    return write_table(training, path)


def write_edges(edges: DataFrame, path: str, buckets: int = 16) -> DataFrame:
    """Edge table split by source, so that lookups of few items read few files."""
    keyed = edges.withColumn("bucket", F.pmod(F.hash("src"), F.lit(buckets)))
    return write_table(keyed.repartition("bucket"), path, partition_by=["bucket"])


def write_embeddings(vectors: DataFrame, path: str) -> DataFrame:
    """(item_id, idx, vector) rows."""
    return write_table(vectors.select("item_id", "idx", "vector"), path)


def write_scalers(scalers: DataFrame, path: str) -> DataFrame:
    """Scaler statistics, a dozen rows in one file."""
    return write_table(scalers.coalesce(1), path)


def read_edges(spark: SparkSession, path: str, items: list | None = None, buckets: int = 16) -> DataFrame:
    """Edges, optionally of a short list of sources, read from their buckets only."""
    edges = spark.read.parquet(path)
    if items is None:
        return edges
    wanted = spark.createDataFrame([(i,) for i in items], f"src {dict(edges.dtypes)['src']}")
    touched = [r[0] for r in wanted.select(F.pmod(F.hash("src"), F.lit(buckets))).distinct().collect()]
    return edges.filter(F.col("bucket").isin(touched) & F.col("src").isin(items))
