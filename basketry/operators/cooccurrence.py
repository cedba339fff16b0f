"""Directional co-occurrence graph as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry import vocab
from basketry.functions.numeric import fixed, share
from basketry.operators.menu import top_per
from basketry.operators.ordering import quantiles

STEP_BLOCK = 512


def item_counts(adds: DataFrame, item: str = "item_id") -> DataFrame:
    return adds.groupBy(F.col(item).alias("item_id")).agg(F.count(F.lit(1)).alias("n"))


def session_pairs(adds: DataFrame, item: str = "item_id") -> DataFrame:
    """Ordered pairs (src before dst) of one session.

    The equi-join key is (session, block of the earlier step). Ordinary carts fit in block 0; a
    session with very many steps is spread over its blocks instead of meeting in one task.
    """
    earlier = adds.select(
        "session_id",
        F.floor(F.col("step_number") / STEP_BLOCK).alias("_block"),
        F.col("step_number").alias("_step"),
        F.col(item).alias("src"),
    )
    later = adds.select(
        "session_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("step_number") / STEP_BLOCK))).alias("_block"),
        F.col("step_number").alias("_later"),
        F.col(item).alias("dst"),
    )
    pairs = earlier.join(later, ["session_id", "_block"])
    return pairs.filter((F.col("_step") < F.col("_later")) & (F.col("src") != F.col("dst"))).select(
        "session_id", "src", "dst"
    )


def pair_counts(adds: DataFrame, item: str = "item_id", directional: bool = True) -> DataFrame:
    """Pair frequencies, counted per task before the shuffle on (src, dst)."""
    counts = session_pairs(adds, item).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pair_count"))
    if directional:
        return counts
    mirrored = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pair_count")
    return counts.unionByName(mirrored).groupBy("src", "dst").agg(F.sum("pair_count").alias("pair_count"))


def filter_min_support(counts: DataFrame, minimum: int = vocab.MIN_PAIR_COUNT) -> DataFrame:
    return counts.filter(F.col("pair_count") >= minimum)


def cond_prob_edges(
    adds: DataFrame,
    item: str = "item_id",
    minimum: int = vocab.MIN_PAIR_COUNT,
    top: int = vocab.TOP_NEIGHBORS,
) -> DataFrame:
    """Edges (src, dst, pair_count, src_count, prob, rank) with prob = P(dst follows | src)."""
    supported = filter_min_support(pair_counts(adds, item), minimum)
    # Within one source, order by count equals order by probability.
    best = top_per(supported, ["src"], [F.desc("pair_count"), F.asc("dst")], top)
    sources = item_counts(adds, item).select(F.col("item_id").alias("src"), F.col("n").alias("src_count"))
    return best.join(sources, "src").select(
        "src", "dst", "pair_count", "src_count", share(F.col("pair_count"), F.col("src_count")).alias("prob"), "rank"
    )


def neighbors_lookup(edges: DataFrame, items: DataFrame, n: int | None = None) -> DataFrame:
    """Neighbours of the given items (column item_id), best first."""
    found = edges.join(items.select(F.col("item_id").alias("src")).distinct(), "src", "left_semi")
    return found if n is None else found.filter(F.col("rank") <= n)


def edge_probability(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Probability of the given (src, dst) pairs; 0 without an edge."""
    known = edges.select("src", "dst", "prob")
    return pairs.join(known, ["src", "dst"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    stats = edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.min("prob").alias("min_prob"),
        F.max("prob").alias("max_prob"),
        F.avg("prob").alias("mean_prob"),
    )
    return stats.withColumn("items", nodes.agg(F.count(F.lit(1))).scalar()).select(
        "items",
        "edges",
        fixed(share(F.col("edges"), F.col("items"))).alias("avg_neighbors"),
        *[fixed(F.col(x)).alias(x) for x in ("min_prob", "max_prob", "mean_prob")],
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-degree of every node, also of nodes without edges."""
    out = edges.groupBy(F.col("src").alias("item_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(out, "item_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    degree = degrees(nodes, edges)
    stats = degree.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("degree") <= 2).alias("low_degree"),
        F.count_if(F.col("degree") >= 20).alias("high_degree"),
        F.avg("degree").alias("mean_degree"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
    )
    return stats.select(
        "items", "low_degree", "high_degree", "min_degree", "max_degree",
        fixed(F.col("mean_degree")).alias("mean_degree"),
        fixed(100.0 * F.col("low_degree") / F.col("items")).alias("low_pct"),
        fixed(100.0 * F.col("high_degree") / F.col("items")).alias("high_pct"),
        fixed(quantiles(degree, "degree", {"q": 0.5}).scalar()).alias("median_degree"),
    )


def top_degree(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), F.asc("item_id")).limit(n)


def symmetrize_edges(edges: DataFrame) -> DataFrame:
    """Undirected weights: the larger probability of both directions."""
    forward = edges.select("src", "dst", "prob")
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "prob")
    return forward.unionByName(backward).groupBy("src", "dst").agg(F.max("prob").alias("weight"))
