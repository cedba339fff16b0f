"""Choice probabilities of restaurants and items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry import vocab
from basketry.functions.cleaning import lookup
from basketry.functions.context import category_index, cuisine_group, heavy_meal, item_price_fit, merchant_price_fit
from basketry.functions.numeric import clip, share
from basketry.operators.menu import cap_menu, pack_pools, pool_arrays, small_pools, votes_norm_max


def normalise(weight: Column, group: list[str]) -> Column:
    """Weight as a share of its group; uniform when all weights are zero."""
    window = Window.partitionBy(*group)
    total = F.sum(weight).over(window)
    return F.when(total > 0, weight / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(window))


def merchant_affinity(users: DataFrame, merchants: DataFrame) -> DataFrame:
    """P(restaurant | user) over the restaurants of the user's city.

    ``merchants`` carries smoothed_rating, delivery_votes, cuisine and avg_item_price.
    """
    votes = F.col("delivery_votes")
    scored = merchants.select(
        "restaurant_id",
        "city",
        "avg_item_price",
        cuisine_group(F.col("cuisine")).alias("_group"),
        (
            clip((F.col("smoothed_rating") - 3.0) / 1.5, 0.1, 1.0)
            * F.when(votes > 0, F.least(F.lit(1.5), F.log1p(votes) / F.log1p(F.lit(1000.0)))).otherwise(0.5)
        ).alias("_appeal"),
    )
    pairs = users.join(scored, "city")
    liked = F.array_contains(F.split("preferred_cuisines", r"\|"), F.col("_group"))
    weight = (
        F.col("_appeal")
        * F.when(liked, 1.5).otherwise(0.8)
        * merchant_price_fit(F.col("user_type"), F.coalesce(F.col("avg_item_price"), F.lit(200.0)))
    )
    weighted = pairs.withColumn("_weight", weight)
    return weighted.select(
        "user_id", "restaurant_id", normalise(F.col("_weight"), ["user_id"]).alias("probability")
    )


def first_item_affinity(contexts: DataFrame, items: DataFrame, cap: int = vocab.MENU_CAP) -> DataFrame:
    """P(first item | restaurant, user type, meal).

    Computed once per distinct context, not per session: sessions look their context up.
    """
    distinct = contexts.select("restaurant_id", "user_type", "meal_type").distinct()
    menu = votes_norm_max(cap_menu(items, cap))
    pairs = distinct.join(menu, "restaurant_id")
    boost = F.when(F.lit(False), F.lit(1.0))
    for meal, boosts in vocab.FIRST_ITEM_BOOST.items():
        boost = boost.when(F.col("meal_type") == meal, F.coalesce(lookup(F.col("item_category"), boosts), F.lit(1.0)))
    weight = (
        0.5 * F.col("norm_votes")
        + 0.3 * F.col("best_seller")
        + 0.2 * item_price_fit(F.col("user_type"), F.col("price"))
    ) * boost.otherwise(1.0)
    key = ["restaurant_id", "user_type", "meal_type"]
    return pairs.withColumn("_weight", weight).select(
        *key, "item_id", normalise(F.col("_weight"), key).alias("probability")
    )


def menu_weights():
    """UDF (pool, cart_items, factors, budget) -> (affinity, total), one Arrow batch at a time over the flat pools.

    Self-contained, so that workers need not import this package.
    """
    chunk = 1024

    def weigh(pool: pa.Array, cart: pa.Array, factors: pa.Array, budget: pa.Array) -> pa.Array:
        def lists(x):
            sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype("int64")
            return sizes, np.concatenate([[0], np.cumsum(sizes)])

        plain = lambda x: pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False)
        packed = pool.cast(pa.large_binary())
        starts = np.frombuffer(packed.buffers()[1], "int64")[packed.offset:packed.offset + len(pool) + 1] // 40
        block = np.frombuffer(packed.buffers()[2] or b"", "int64")[:starts[-1] * 5].reshape(-1, 5)
        sizes = np.diff(starts)
        ids, code = (np.ascontiguousarray(block[:, i]) for i in (0, 2))
        unnamed = block[:, 1] == 0
        price, base = (np.ascontiguousarray(block[:, i]).view("float64") for i in (3, 4))
        rates = plain(pc.list_flatten(factors)).reshape(len(pool), -1)
        limit = plain(budget)
        held_sizes, held_starts = lists(cart)
        held = pc.list_flatten(cart).to_numpy(zero_copy_only=False)
        flat, totals = np.zeros(len(ids)), np.zeros(len(pool))
        for at in range(0, len(pool), chunk):
            to = min(at + chunk, len(pool))
            width = int(sizes[at:to].max(initial=0))
            if not width:
                continue
            inside = np.arange(width) < sizes[at:to, None]
            place = np.where(inside, starts[at:to, None] + np.arange(width), 0)
            own = np.arange(at, to)[:, None]
            weight = base[place] * rates[own, code[place]] * np.where(price[place] <= limit[at:to, None], 1.0, 0.3)
            name, known = ids[place], ~unnamed[place]
            longest = held_sizes[at:to]
            for i in range(int(longest.max(initial=0))):
                with_i = np.flatnonzero(longest > i)
                taken = (name[with_i] == held[held_starts[at:to][with_i] + i][:, None]) & known[with_i]
                weight[with_i] = np.where(taken, 0.0, weight[with_i])
            weight[~inside] = 0.0
            totals[at:to] = np.cumsum(weight, axis=1)[:, -1]  # from the left, as a fold does
            flat[starts[at]:starts[to]] = weight[inside]
        items = pa.array(ids, mask=unnamed)
        pairs = pa.StructArray.from_arrays([items, pa.array(flat, mask=np.isnan(flat))], ["item_id", "weight"])
        listed = pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pairs)
        return pa.StructArray.from_arrays([listed, pa.array(totals, mask=np.isnan(totals))], ["affinity", "total"])

    return F.arrow_udf(weigh, "affinity array<struct<item_id: bigint, weight: double>>, total double")


def next_item_affinity(steps: DataFrame, items: DataFrame, cap: int = vocab.MENU_CAP) -> DataFrame:
    """Add ``affinity``, an array of (item_id, weight) over the restaurant's menu, and its total.

    The division stays outside the array (``choice_probability``): inside the lambda the total
    would be summed again for every entry.

    ``steps`` carries cart_items, cart_categories, cart_total, user_type, meal_type,
    avg_order_value. Items in the cart get 0.
    """
    base = 0.15 * F.col("norm_votes") + 0.35 * F.col("best_seller") + 0.5
    menu = votes_norm_max(cap_menu(items, cap)).withColumns({
        "base": base, "code": category_index(F.col("item_category"))
    })
    pools = pool_arrays(menu, "item_rank", cap, [
        F.col("item_id").cast("long").alias("item_id"), F.col("item_id").isNotNull().cast("long").alias("named"),
        F.col("code").cast("long").alias("code"), F.col("price").cast("double").alias("price"), "base"])
    pools = pack_pools(pools, ["item_id", "named", "code", "price", "base"])
    # All but base and price depends on the category alone: one factor per category and step,
    # computed below the join, leaves a short product per menu item.
    categories = F.col("cart_categories")
    last = F.try_element_at(categories, F.lit(-1))
    has_main = F.array_contains(categories, "main")
    boosts = {
        "beverage": F.when(has_main & ~F.array_contains(categories, "beverage"), 6.0).otherwise(1.0)
        * F.when(F.col("meal_type").isin("lunch", "dinner"), 2.0).otherwise(1.0),
        "dessert": F.when(heavy_meal(categories) == 1, 4.0).otherwise(1.0)
        * F.when(F.col("user_type").isin("premium", "luxury"), 3.0).otherwise(1.0),
        "main": F.when(has_main, 0.5).otherwise(1.0),
    }

    def factor(name: str) -> Column:
        rates = {frm: row.get(name, vocab.OTHER_TRANSITION) for frm, row in vocab.CATEGORY_TRANSITIONS.items()}
        repeated = F.size(F.filter(categories, lambda c: c == name)) >= 2
        follow = F.coalesce(lookup(last, rates), F.lit(1.0))
        return follow * boosts.get(name, F.lit(1.0)) * F.when(repeated, 0.3).otherwise(1.0)

    prepared = steps.withColumns({
        "_factors": F.array(*[factor(name) for name in vocab.CATEGORY_INDEX]),
        "_budget": F.greatest(F.lit(50.0), F.col("avg_order_value") - F.col("cart_total")),
    }).join(small_pools(pools, cap), "restaurant_id")
    weighted = prepared.withColumn("_w", menu_weights()("pool", "cart_items", "_factors", "_budget"))
    return weighted.select(*steps.columns, F.col("_w.affinity").alias("affinity"), F.col("_w.total").alias("affinity_total"))


def choice_probability(weight: Column) -> Column:
    """Probability of one entry of ``affinity``; uniform when every weight is zero."""
    total = F.col("affinity_total")
    return F.when(total > 0, weight / total).otherwise(F.lit(1.0) / F.size("affinity"))


def transition_matrix(adds: DataFrame) -> DataFrame:
    """Learned P(next category | last category) from consecutive adds."""
    order = Window.partitionBy("session_id").orderBy("step_number")
    moves = adds.withColumn("from_category", F.lag("item_category").over(order)).filter(
        F.col("from_category").isNotNull()
    )
    counts = moves.groupBy("from_category", F.col("item_category").alias("to_category")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy("from_category").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "from_category").select(
        "from_category", "to_category", "n", share(F.col("n"), F.col("_total")).alias("rate")
    )
