"""Menus: ranking, capping, popularity pools and ratings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry import vocab
from basketry.functions.numeric import exact_mean, fixed, share
from basketry.operators.ordering import quantile, quantiles, ranked
from basketry.session import cut_lineage

BROADCAST_ENTRIES = 1 << 20  # pool entries, of some 32 bytes, that every task may hold


def with_vote_stats(items: DataFrame) -> DataFrame:
    """Attach vote minimum, maximum and menu size of the restaurant (aggregate, then lookup)."""
    stats = items.groupBy("restaurant_id").agg(
        F.min("item_votes").alias("_min_votes"),
        F.max("item_votes").alias("_max_votes"),
        F.count(F.lit(1)).alias("_menu_size"),
    )
    return items.join(stats, "restaurant_id")


def vote_minmax(items: DataFrame) -> DataFrame:
    spread = F.col("_max_votes") - F.col("_min_votes") + F.lit(1e-10)
    scored = with_vote_stats(items).withColumn("vote_score", (F.col("item_votes") - F.col("_min_votes")) / spread)
    return scored.drop("_min_votes", "_max_votes", "_menu_size")


def votes_norm_max(items: DataFrame) -> DataFrame:
    """Votes relative to the best item; uniform when nobody voted."""
    norm = F.when(F.col("_max_votes") > 0, F.col("item_votes") / F.col("_max_votes")).otherwise(
        F.lit(1.0) / F.col("_menu_size")
    )
    return with_vote_stats(items).withColumn("norm_votes", norm).drop("_min_votes", "_max_votes", "_menu_size")


def with_menu_score(items: DataFrame) -> DataFrame:
    score = F.col("vote_score") * 0.7 + F.coalesce(F.col("best_seller"), F.lit(0)) * 0.3
    return vote_minmax(items).withColumn("menu_score", score).drop("vote_score")


def menu_rank(items: DataFrame) -> DataFrame:
    """Full ranking of every menu."""
    return ranked(with_menu_score(items), ["restaurant_id"], F.col("menu_score"), [F.col("item_id")], "item_rank")


def top_per(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Each task keeps at most ``n`` per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("long")).filter(F.col(name) <= n)


def cap_menu(items: DataFrame, n: int = vocab.MENU_CAP) -> DataFrame:
    order = [F.desc("menu_score"), F.asc("item_id")]
    return top_per(with_menu_score(items), ["restaurant_id"], order, n, "item_rank").drop("menu_score")


def capping_summary(items: DataFrame, n: int = vocab.MENU_CAP) -> DataFrame:
    """Menu sizes before and after the cap, and the shift of category shares."""
    capped = cap_menu(items, n)

    def shares(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("item_category").agg(F.count(F.lit(1)).alias(name))

    def sizes(df: DataFrame) -> DataFrame:
        return df.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n"))

    before = sizes(items)
    affected = before.agg(
        F.count_if(F.col("n") > n).alias("affected"), F.sum(F.greatest(F.col("n") - n, F.lit(0))).alias("removed")
    )
    both = shares(items, "before").join(shares(capped, "after"), "item_category", "full_outer")
    totals = {"before": items, "after": capped}
    pct = {
        x: 100.0 * F.coalesce(F.col(x), F.lit(0)) / df.agg(F.count(F.lit(1))).scalar() for x, df in totals.items()
    }
    table = both.select(
        "item_category",
        F.coalesce("before", F.lit(0)).alias("items_before"),
        F.coalesce("after", F.lit(0)).alias("items_after"),
        fixed(pct["before"]).alias("pct_before"),
        fixed(pct["after"]).alias("pct_after"),
    )
    one = affected.select(F.struct("affected", "removed").alias("s")).scalar()
    return table.withColumns({
        "restaurants_affected": one["affected"],
        "items_removed": one["removed"],
    })


def smoothed_rating(
    merchants: DataFrame,
    rating: str = "delivery_rating",
    votes: str = "delivery_votes",
    prior_votes: int = vocab.SMOOTHING_VOTES,
    global_mean: float | None = None,
) -> DataFrame:
    """Rating pulled towards the mean of all restaurants, the more so the fewer the votes."""
    mean = F.lit(global_mean) if global_mean is not None else merchants.agg(exact_mean(F.col(rating))).scalar()
    with_mean = merchants.withColumn("_mean", mean)
    smooth = (F.col(rating) * F.col(votes) + F.col("_mean") * prior_votes) / (F.col(votes) + prior_votes)
    return with_mean.withColumn("smoothed_rating", fixed(F.coalesce(smooth, F.col("_mean")), 3)).drop("_mean")


def smoothing_impact(smoothed: DataFrame) -> DataFrame:
    """One row comparing raw and smoothed ratings."""
    raw, new, votes = F.col("delivery_rating"), F.col("smoothed_rating"), F.col("delivery_votes")
    change = F.abs(new - raw)
    stats = smoothed.agg(
        F.count(F.lit(1)).alias("restaurants"),
        *[f(x).alias(f"{n}_{label}") for x, label in ((raw, "raw"), (new, "smoothed"))
          for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_samp, "std"))],
        F.avg(change).alias("mean_change"),
        F.max(change).alias("max_change"),
        F.count_if(change > 0.1).alias("changed_over_0_1"),
        F.count_if(votes == 0).alias("votes_none"),
        F.count_if(votes.between(1, 20)).alias("votes_low"),
        F.count_if(votes > 100).alias("votes_high"),
    )
    counts = ["restaurants", "changed_over_0_1", "votes_none", "votes_low", "votes_high"]
    return stats.select(
        *[F.col(x) if x in counts else fixed(F.col(x)).alias(x) for x in stats.columns],
        fixed(quantile(smoothed, "delivery_rating", 0.5)).alias("median_raw"),
        fixed(quantile(smoothed, "smoothed_rating", 0.5)).alias("median_smoothed"),
    )


def popularity_rank(items: DataFrame) -> DataFrame:
    """Position of each item in its restaurant, most voted first."""
    return ranked(items, ["restaurant_id"], F.col("item_votes"), [F.col("item_id")], "popularity_rank")


def pool_arrays(ranked_items: DataFrame, rank: str, limit: int | Column, fields: list[str | Column]) -> DataFrame:
    """One row per restaurant with its best ``limit`` items as an ordered array.

    Steps or requests then join one row each instead of one row per candidate.
    """
    kept = ranked_items.filter(F.col(rank) <= limit)
    pool = F.sort_array(F.collect_list(F.struct(rank, *fields)))
    return kept.groupBy("restaurant_id").agg(pool.alias("pool"))


def pack_pools(pools: DataFrame, fields: list[str]) -> DataFrame:
    """``pools`` with one binary per restaurant: its entries' ``fields`` in turn, eight bytes each, missing ones NaN or 0.

    A step then carries its pool to a Python worker as one block of bytes instead of hundreds of values.
    """
    def pack(pool: pa.Array) -> pa.Array:
        entries = pc.list_flatten(pool)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pool).to_numpy(zero_copy_only=False))])
        block = np.zeros((len(entries), len(fields)), "int64")
        for i, name in enumerate(fields):
            values = pc.struct_field(entries, name)
            real = pa.types.is_floating(values.type)
            filled = pc.fill_null(values, float("nan") if real else 0).to_numpy(zero_copy_only=False)
            block[:, i] = filled.astype("float64").view("int64") if real else filled.astype("int64")
        offsets = pa.array(ends * 8 * len(fields), pa.int32())
        return pa.Array.from_buffers(pa.binary(), len(pool), [None, offsets.buffers()[1], pa.py_buffer(block.tobytes())])

    return pools.withColumn("pool", F.arrow_udf(pack, "binary")("pool"))


def small_pools(pools: DataFrame, limit: int) -> DataFrame:
    """``pools`` computed once and, while restaurants are few, marked for broadcast.

    Steps then stay where they are instead of moving to the task of their restaurant.
    """
    stored = cut_lineage(pools)
    return F.broadcast(stored) if stored.count() * limit <= BROADCAST_ENTRIES else stored


def popularity_pool(requests: DataFrame, items: DataFrame, k: int = vocab.CANDIDATE_POOL) -> DataFrame:
    """The ``k`` most popular items of the restaurant that are not in the cart.

    ``requests`` holds restaurant_id and cart_items. A pool keeps k plus the largest cart, which is
    enough to fill k places whatever the cart excludes.
    """
    largest = requests.agg(F.coalesce(F.max(F.size("cart_items")), F.lit(0))).scalar()
    pools = pool_arrays(popularity_rank(items), "popularity_rank", F.lit(k) + largest, ["item_id"])
    joined = requests.join(pools, "restaurant_id")
    free = F.filter("pool", lambda x: ~F.array_contains("cart_items", x["item_id"]))
    picked = joined.withColumn("_free", F.slice(free, 1, k)).drop("pool")
    columns = [x for x in picked.columns if x not in ("_free",)]
    return picked.select(*columns, F.posexplode("_free").alias("_pos", "_item")).select(
        *columns,
        F.col("_item.item_id").alias("item_id"),
        F.col("_item.popularity_rank").alias("popularity_rank"),
        (F.col("_pos") + 1).cast("long").alias("pool_rank"),
    )


def free_items(carts: DataFrame, items: DataFrame) -> DataFrame:
    """Number and id sum of the restaurant's items that the cart does not hold.

    ``carts`` holds restaurant_id and cart_lines, structs of item_id and the item's restaurants (``homes``). The menu's
    totals less those of its items in the cart: no step carries a menu, however long.
    """
    totals = items.select("restaurant_id", "item_id").distinct().groupBy("restaurant_id").agg(
        F.count("item_id").alias("_menu"), F.coalesce(F.sum("item_id"), F.lit(0)).alias("_ids"))
    own = F.filter("cart_lines", lambda x: F.array_contains(x["homes"], F.col("restaurant_id")))
    joined = carts.withColumn("_own", F.array_distinct(F.transform(own, lambda x: x["item_id"]))).join(
        small_pools(totals, 1), "restaurant_id")
    held = F.aggregate("_own", F.lit(0).cast("long"), lambda a, x: a + x)
    return joined.withColumns({
        "free_items": F.col("_menu") - F.size("_own"), "free_id_sum": F.col("_ids") - held}).drop("_own", "_menu", "_ids")


def top_items(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc("item_id")).limit(n)


def menu_listing(items: DataFrame, limit: int = 20) -> DataFrame:
    """First items of every menu with the menu's full size."""
    sizes = items.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("total"))
    order = [F.desc("item_votes"), F.asc("item_id")]
    page = top_per(items, ["restaurant_id"], order, limit, "position")
    return page.join(sizes, "restaurant_id").select(
        "restaurant_id", "position", "item_id", "item_name", "price", F.col("item_category").alias("category"), "total"
    )


def merchant_price_stats(merchants: DataFrame, items: DataFrame) -> DataFrame:
    """Mean, deviation and number of prices per restaurant; gaps filled with the median and 0."""
    price = F.col("price")
    stats = items.groupBy("restaurant_id").agg(
        exact_mean(price).alias("avg_item_price"),
        F.stddev_samp(price).alias("price_std"),
        F.count(price).alias("menu_size"),
    )
    joined = merchants.join(stats, "restaurant_id", "left")
    return joined.withColumns({
        "avg_item_price": F.coalesce(F.col("avg_item_price"), quantile(joined, "avg_item_price", 0.5)),
        "price_std": F.coalesce(F.col("price_std"), F.lit(0.0)),
        "menu_size": F.coalesce(F.col("menu_size"), F.lit(0)),
    })


def price_band(df: DataFrame, column: str = "avg_item_price", name: str = "price_band_index") -> DataFrame:
    """Quintile 0-4 by exact edges; coinciding edges simply leave a band empty."""
    edges = quantiles(df, column, {f"e{i}": i / 5 for i in range(1, 5)})
    row = edges.select(F.struct(*edges.columns).alias("s")).scalar()
    banded = df.withColumn("_edges", row)
    band = F.when(F.lit(False), F.lit(None).cast("int"))
    for i in range(1, 5):
        band = band.when(F.col(column) <= F.col(f"_edges.e{i}"), i - 1)
    return banded.withColumn(name, F.when(F.col(column).isNotNull(), band.otherwise(4))).drop("_edges")
