"""Ordered carts: sequences, running cart state, time split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketry.functions.hashing import uniform
from basketry.functions.numeric import fixed, money
from basketry.operators.ordering import quantiles, running


def filter_positive(events: DataFrame) -> DataFrame:
    return events.filter(F.col("label") == 1)


def ordered_sequence(adds: DataFrame, item: str = "item_id") -> DataFrame:
    """Items of each session in step order."""
    steps = F.sort_array(F.collect_list(F.struct("step_number", item)))
    return adds.groupBy("session_id").agg(F.transform(steps, lambda s: s[item]).alias("item_sequence"))


def global_stable_sort(sequences: DataFrame) -> DataFrame:
    return sequences.orderBy("session_id")


def step_state(adds: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Cart contents, categories and total before every step.

    ``extra`` names further columns of the items in the cart, gathered as ``cart_lines``: structs of item_id and these.
    """
    before = (
        Window.partitionBy("session_id").orderBy("step_number").rowsBetween(Window.unboundedPreceding, -1)
    )
    lines = {"cart_lines": F.collect_list(F.struct("item_id", *extra)).over(before)} if extra else {}
    return adds.withColumns({
        **lines,
        "cart_items": F.collect_list("item_id").over(before),
        "cart_categories": F.collect_list("item_category").over(before),
        "cart_total": F.coalesce(F.sum(money(F.col("price"))).over(before).cast("double"), F.lit(0.0)),
    })


def cart_sizes(adds: DataFrame) -> DataFrame:
    return adds.groupBy("session_id").agg((F.max("step_number") + 1).alias("cart_size"))


def cart_size_distribution(adds: DataFrame) -> DataFrame:
    """Sessions per cart size with share, and overall statistics on every row."""
    sizes = cart_sizes(adds)
    histogram = sizes.groupBy("cart_size").agg(F.count(F.lit(1)).alias("sessions"))
    overall = histogram.agg(
        F.struct(
            F.sum("sessions").alias("n"),
            F.min("cart_size").alias("low"),
            F.max("cart_size").alias("high"),
            (F.sum(F.col("sessions") * F.col("cart_size")) / F.sum("sessions")).alias("mean"),
        )
    ).scalar()
    median = quantiles(sizes, "cart_size", {"q": 0.5}).scalar()
    return histogram.withColumn("_o", overall).select(
        "cart_size",
        "sessions",
        fixed(100.0 * F.col("sessions") / F.col("_o.n")).alias("pct"),
        F.col("_o.low").alias("min_size"),
        fixed(median).alias("median_size"),
        fixed(F.col("_o.mean")).alias("mean_size"),
        F.col("_o.high").alias("max_size"),
    )


def sequence_length_distribution(sequences: DataFrame) -> DataFrame:
    counts = sequences.groupBy(F.size("item_sequence").cast("long").alias("length")).agg(
        F.count(F.lit(1)).alias("sequences")
    )
    return counts.select(
        "length", "sequences", fixed(100.0 * F.col("sequences") / counts.agg(F.sum("sequences")).scalar()).alias("pct")
    )


def time_split(events: DataFrame, validation: float = 0.1) -> DataFrame:
    """Label each session train or validation: the latest share of rows validates.

    Sessions are ordered by (ts, session_id) and never cut. Positions come from per-day totals,
    so there is no global sort.
    """
    sessions = events.groupBy("session_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("rows"))
    placed = running(
        sessions, [], F.unix_date(F.to_date("ts")), [F.col("ts"), F.col("session_id")], {"upto": F.col("rows")}
    )
    cut = sessions.agg(F.floor(F.sum("rows") * F.lit(1.0 - validation))).scalar()
    return placed.withColumn("split", F.when(F.col("upto") <= cut, "train").otherwise("validation"))


def session_sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Keep whole sessions whose key hashes below ``fraction``; stable across runs."""
    return df.filter(uniform(F.col("session_id"), seed=seed) < fraction)
