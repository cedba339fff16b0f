"""Structured Streaming jobs on cart and activity events.

Every job takes a streaming frame and shares its transformations with the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.functions import context
from basketry.operators.menu import top_per
from basketry.session import scratch_path
from basketry.sources.bindings import CartModel

LATENESS = "10 minutes"
#: Keyed state that outlives memory: in RocksDB files, with one bound for all stores of an executor.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
END_OF_INPUT = "9000-01-01 00:00:00"  # later than any row


def stream_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; the schema is taken from the files, never inferred from rows."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """``values`` in the session's configuration for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available and return the result as a stored table (exactly-once file sink)."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{out}-log")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Apply a batch operator to every micro-batch.

    Each batch overwrites its own folder, so a replayed batch does not add rows twice.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{out}-log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def run_closed(stream: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame],
               close: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """Gather ``stream`` in keyed state by ``close`` and answer what its windows close, until the input ends.

    ``close`` is an aggregate under a watermark on ``ts``. An end mark, a row with nothing but a far time, follows the
    last input as a second source of the same query: it moves the watermark past every window that is still open. A
    restarted query goes on from its checkpoint, so each key is answered once however its rows are cut into batches.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    none = spark.createDataFrame([], stream.schema)
    none.write.parquet(f"{out}-marks")
    marks = spark.readStream.schema(stream.schema).parquet(f"{out}-marks")
    closed = close(stream.unionByName(marks))

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run() -> None:
        query = closed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{out}-log")
        with settings(spark, STATE_ON_DISK):  # a query takes them when it starts
            started = query.trigger(availableNow=True).start()
        started.awaitTermination()

    run()
    end = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != ts]
    spark.range(1).select(*end, F.lit(END_OF_INPUT).cast("timestamp").alias(ts)).write.mode("append").parquet(f"{out}-marks")
    run()
    return spark.read.parquet(out).drop("batch")


def carts(lines: DataFrame, delay: str, gap: str = "30 minutes") -> DataFrame:
    """Carts (request_id, items) of streamed lines (request_id, item_id, ts), closed ``gap`` after their last line.

    ``delay`` is how far behind the newest line a line may arrive. The state holds one set per open cart. No filter on
    request_id here: it would be pushed below the watermark, which must see the end mark.
    """
    timed = lines.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "request_id")
    return timed.agg(F.collect_set("item_id").alias("items")).select("request_id", "items")


def enrich(lines: DataFrame, m: CartModel) -> DataFrame:
    """Adds with category, price, session attributes and meal; batch and stream alike."""
    items = m["b_items"].select("item_id", "item_category", "price", "restaurant_id")
    adds = lines.select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("item_id"), "l_linenumber")
    joined = adds.join(items, "item_id").join(m["b_sessions"], "session_id")
    return joined.select(
        "session_id", "l_linenumber", "item_id", "item_category", "price", "user_type",
        context.meal_type(F.col("hour")).alias("meal_type"),
        context.category_index(F.col("item_category")).alias("category_index"),
        (F.col("item_category") == "beverage").cast("int").alias("is_beverage"),
    )


def activity(events: DataFrame) -> DataFrame:
    """Shop activity: what was shown, what was added, by whom and for which item."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        (F.col("event_type") == "purchase").cast("int").alias("added"),
        F.col("event_type").isin("click", "view", "purchase").cast("int").alias("shown"),
        context.meal_type(F.hour("ts")).alias("meal_type"),
    )


def attach_rate(events: DataFrame) -> DataFrame:
    """Adds per shown item, by meal and hour; rows later than the watermark are dropped."""
    windows = activity(events).withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 hour"), "meal_type")
    return windows.agg(F.sum("added").alias("adds"), F.sum("shown").alias("shown")).select(
        F.col("window.start").alias("window_start"), "meal_type", "adds", "shown",
        F.try_divide(F.col("adds").cast("double"), F.col("shown")).alias("attach_rate"),
    )


def item_windows(events: DataFrame) -> DataFrame:
    """Adds per item in hourly windows that slide by 15 minutes."""
    added = activity(events).filter(F.col("added") == 1).withWatermark("ts", LATENESS)
    counts = added.groupBy(F.window("ts", "1 hour", "15 minutes"), "item_id").agg(F.count(F.lit(1)).alias("adds"))
    return counts.select(F.col("window.start").alias("window_start"), "item_id", "adds")


def top_items(counts: DataFrame, n: int = 5) -> DataFrame:
    return top_per(counts, ["window_start"], [F.desc("adds"), F.asc("item_id")], n)


def activity_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Visits of a user: activity without a pause of ``gap``."""
    visits = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    sessions = visits.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap), "user_id")
    return sessions.agg(F.count(F.lit(1)).alias("events")).select(
        "user_id",
        F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"),
        "events",
    )
