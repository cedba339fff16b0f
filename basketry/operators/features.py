"""User, restaurant, item and cart features, scalers and the training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketry import vocab
from basketry.functions import context
from basketry.functions.numeric import clip, exact_mean, fixed, money, share
from basketry.operators.menu import merchant_price_stats, price_band


def count_of(categories: Column, category: str) -> Column:
    return F.size(F.filter(categories, lambda c: c == category)).cast("long")


def user_rfm(steps: DataFrame, users: DataFrame, reference: str) -> DataFrame:
    """Recency, frequency, spend and taste per user from positive steps.

    Sessions are reduced first, so distinct counting needs no expansion and a busy user arrives as
    one row per session.
    """
    sessions = steps.groupBy("user_id", "session_id").agg(
        F.max("ts").alias("ts"),
        F.count(F.lit(1)).alias("steps"),
        F.sum(money(F.col("cart_total"))).alias("spend"),
        F.sum(F.size("cart_categories").cast("long")).alias("seen"),
        F.sum(count_of(F.col("cart_categories"), "dessert")).alias("desserts"),
        F.sum(count_of(F.col("cart_categories"), "beverage")).alias("beverages"),
    )
    per_user = sessions.groupBy("user_id").agg(
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("frequency"),
        *[F.sum(x).alias(x) for x in ("steps", "spend", "seen", "desserts", "beverages")],
    )
    tastes = users.select("user_id", F.size(F.split("preferred_cuisines", r"\|")).alias("_cuisines"))
    age = (F.unix_timestamp(F.lit(reference).cast("timestamp")) - F.unix_timestamp("last_ts")) / 86400
    seen = F.greatest(F.col("seen"), F.lit(1))
    return per_user.join(tastes, "user_id", "left").select(
        "user_id",
        clip(F.floor(age), 0, 365).cast("long").alias("recency_days"),
        clip(F.col("frequency"), 1, 1000).cast("long").alias("frequency"),
        clip(fixed(F.col("spend").cast("double") / F.col("steps"), 2), 0.0, 10000.0).alias("monetary_avg"),
        F.coalesce(fixed(F.least(F.col("_cuisines"), F.lit(5)) / 5.0, 4), F.lit(0.5)).alias("cuisine_entropy"),
        clip(fixed(F.col("steps") / F.col("frequency"), 2), 0.0, 20.0).alias("avg_cart_size"),
        fixed(F.col("desserts") / seen, 4).alias("dessert_ratio"),
        fixed(F.col("beverages") / seen, 4).alias("beverage_ratio"),
    )


def merchant_features(merchants: DataFrame, items: DataFrame) -> DataFrame:
    """Clipped restaurant features; ``merchants`` carries smoothed_rating and delivery_votes."""
    stats = merchant_price_stats(merchants.select("restaurant_id", "smoothed_rating", "delivery_votes"), items)
    banded = price_band(stats.withColumn("avg_item_price", F.greatest(F.col("avg_item_price"), F.lit(0.0))))
    return banded.select(
        "restaurant_id",
        clip(F.col("smoothed_rating"), 1.0, 5.0).alias("smoothed_rating"),
        clip(F.col("delivery_votes"), 0, 100000).cast("long").alias("delivery_votes"),
        clip(F.col("avg_item_price"), 0.0, 5000.0).alias("avg_item_price"),
        "price_band_index",
        clip(F.col("menu_size"), 0, 500).cast("long").alias("menu_size"),
    )


def item_features(items: DataFrame, index: DataFrame) -> DataFrame:
    """Price z-score, category index and embedding index (-1 without one)."""
    stats = items.agg(
        F.struct(exact_mean(F.col("price")).alias("mean"), F.stddev_samp("price").alias("std"))
    ).scalar()
    joined = items.join(index.select("item_id", F.col("idx").alias("embedding_idx")), "item_id", "left")
    z = (F.col("price") - F.col("_s.mean")) / F.greatest(F.col("_s.std"), F.lit(1.0))
    return joined.withColumn("_s", stats).select(
        "item_id",
        "restaurant_id",
        F.coalesce("embedding_idx", F.lit(-1)).alias("embedding_idx"),
        fixed(F.col("price"), 2).alias("price"),
        fixed(z, 4).alias("normalized_price"),
        F.coalesce("best_seller", F.lit(0)).alias("best_seller"),
        context.category_index(F.coalesce("item_category", F.lit("other"))).alias("category_index"),
        F.coalesce("veg_flag", F.lit(0)).alias("veg_flag"),
    )


# Transform per table and feature; the two parameters are fitted or fixed.
SCALED = {
    "user": {
        "recency_days": "log1p_zscore", "frequency": "log1p_zscore", "monetary_avg": "log1p_zscore",
        "cuisine_entropy": "passthrough", "avg_cart_size": "log1p_zscore", "dessert_ratio": "passthrough",
        "beverage_ratio": "passthrough",
    },
    "restaurant": {
        "delivery_votes": "log1p_zscore", "avg_item_price": "log1p_zscore", "menu_size": "log1p_zscore",
        "smoothed_rating": "minmax", "price_band_index": "divide",
    },
}
FIXED_PARAMETERS = {"passthrough": (None, None), "minmax": (3.0, 5.0), "divide": (4.0, None)}
FIT_DEFAULTS = {"avg_cart_size": 2.0}


def fit_scalers(tables: dict[str, DataFrame]) -> DataFrame:
    """Scaler table (table_name, feature, transform, p1, p2), one aggregate pass per input."""
    result = None
    for table, df in tables.items():
        entries, statistics = [], []
        for feature, transform in SCALED[table].items():
            if transform == "log1p_zscore":
                filled = F.coalesce(F.col(feature).cast("double"), F.lit(FIT_DEFAULTS.get(feature, 0.0)))
                logged = F.log1p(F.greatest(filled, F.lit(0.0)))
                statistics += [F.avg(logged).alias(f"{feature}_1"), F.stddev_samp(logged).alias(f"{feature}_2")]
                p1 = F.col(f"{feature}_1")
                p2 = F.when(F.col(f"{feature}_2") > 0, F.col(f"{feature}_2")).otherwise(1.0)
            else:
                p1, p2 = (F.lit(p).cast("double") for p in FIXED_PARAMETERS[transform])
            entries.append(F.struct(
                F.lit(table).alias("table_name"), F.lit(feature).alias("feature"),
                F.lit(transform).alias("transform"), p1.alias("p1"), p2.alias("p2"),
            ))
        fitted = df.agg(*statistics).select(F.inline(F.array(*entries)))
        result = fitted if result is None else result.unionByName(fitted)
    return result


def apply_scalers(df: DataFrame, scalers: DataFrame, table: str) -> DataFrame:
    """Add ``<feature>_norm`` columns; missing or infinite results become 0."""
    # A dozen parameters at most, so they travel as one scalar map.
    parameters = (
        scalers.filter(F.col("table_name") == table)
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("p1", "p2")))))
        .scalar()
    )
    with_parameters = df.withColumn("_p", parameters)
    norms = {}
    for feature, transform in SCALED[table].items():
        x = F.col(feature).cast("double")
        p1, p2 = (F.col("_p")[feature][p] for p in ("p1", "p2"))
        if transform == "log1p_zscore":
            value = (F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))) - p1) / p2
        elif transform == "passthrough":
            value = F.coalesce(x, F.lit(0.5))
        elif transform == "minmax":
            value = (F.coalesce(x, (p1 + p2) / 2) - p1) / (p2 - p1)
        else:
            value = F.coalesce(x, F.lit(0.0)) / p1
        finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        norms[f"{feature}_norm"] = F.coalesce(finite, F.lit(0.0))
    return with_parameters.withColumns(norms).drop("_p")


def join_features_default(events: DataFrame, users: DataFrame, merchants: DataFrame) -> DataFrame:
    """Attach normalised vectors; unknown users and restaurants get the default vectors."""
    result = events
    for key, table, defaults in (
        ("user_id", users, vocab.DEFAULT_USER_VECTOR),
        ("restaurant_id", merchants, vocab.DEFAULT_RESTAURANT_VECTOR),
    ):
        result = result.join(table.select(key, *defaults), key, "left").withColumns(
            {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
        )
    return result


def cart_lines(steps: DataFrame, items: DataFrame) -> DataFrame:
    """One row per (step, cart position) with the attributes of the cart item."""
    exploded = steps.select("session_id", "step_number", F.posexplode("cart_items").alias("position", "cart_item"))
    return exploded.join(items.withColumnRenamed("item_id", "cart_item"), "cart_item", "left")


def join_cart_items(steps: DataFrame, items: DataFrame) -> DataFrame:
    """Price and category summary of each non-empty cart, from the catalogue."""
    lines = cart_lines(steps, items.select("item_id", "price", "item_category"))
    price = F.coalesce("price", F.lit(vocab.DEFAULT_ITEM_PRICE))
    return lines.groupBy("session_id", "step_number").agg(
        F.count(F.lit(1)).alias("cart_size"),
        F.sum(money(price)).cast("double").alias("cart_value"),
        exact_mean(price).alias("avg_price"),
        F.count_if(F.col("item_category") == "main").alias("mains"),
        F.count_if(F.col("item_category") == "side").alias("sides"),
    )


def cart_embedding_indices(steps: DataFrame, index: DataFrame) -> DataFrame:
    """Embedding indices of the cart in order, unknown items left out."""
    lines = cart_lines(steps, index.select("item_id", F.col("idx"))).filter(F.col("idx").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("position", "idx")))
    return lines.groupBy("session_id", "step_number").agg(
        F.transform(ordered, lambda x: x["idx"]).alias("cart_embedding_indices")
    )


def cart_features(steps: DataFrame, heavy_rule: str = "composition") -> DataFrame:
    """Size, value and gap flags of the cart before each step; a pure projection."""
    categories = F.col("cart_categories")
    return steps.withColumns({
        "cart_size": F.size("cart_items").cast("long"),
        "cart_value": fixed(F.col("cart_total"), 2),
        "missing_beverage": context.lacks(categories, "beverage"),
        "missing_dessert": context.lacks(categories, "dessert"),
        "heavy_meal": context.heavy_meal(categories, heavy_rule),
    })


def cart_features_scaled(steps: DataFrame) -> DataFrame:
    """The six cart inputs of the ranker; an empty cart gives [0, 0, 0, 1, 1, 0]."""
    size = F.size("cart_items")
    average = F.coalesce(F.try_divide(F.col("cart_total"), size), F.lit(0.0))
    return cart_features(steps).withColumns({
        "cart_total_scaled": F.col("cart_total") / 1000.0,
        "cart_size_scaled": size / float(vocab.CART_LIMIT),
        "avg_price_scaled": average / 500.0,
    })


def filter_embedded(events: DataFrame, index: DataFrame) -> DataFrame:
    known = index.select(F.col("item_id").alias("candidate_item"))
    return events.filter(F.col("candidate_item").isNotNull()).join(known, "candidate_item", "left_semi")


def join_item_lookup(events: DataFrame, features: DataFrame) -> DataFrame:
    """Category and embedding index of the candidate; other and -1 when unknown."""
    looked = features.select(
        F.col("item_id").alias("candidate_item"), F.col("embedding_idx").alias("_idx"), F.col("category_index").alias("_cat")
    )
    return events.join(looked, "candidate_item", "left").select(
        *events.columns,
        F.coalesce("_idx", F.lit(-1)).alias("embedding_idx"),
        F.coalesce("_cat", F.lit(vocab.CATEGORY_INDEX["other"])).alias("category_index"),
    )


def training_set(events: DataFrame, steps: DataFrame, features: DataFrame, index: DataFrame) -> DataFrame:
    """One row per shown item with cart, context and embedding references.

    Cart lookups run once per step, not once per shown item. With a broadcast ``index`` and ``features`` that are no more
    than its items, shown items without a vector leave where they are drawn and the others meet their lookups there.
    """
    carts = cart_features(steps, heavy_rule="size").join(
        cart_embedding_indices(steps, index), ["session_id", "step_number"], "left"
    ).select(
        "session_id", "step_number", "cart_size", "cart_value", "missing_beverage", "missing_dessert", "heavy_meal",
        F.coalesce("cart_embedding_indices", F.array().cast("array<bigint>")).alias("cart_embedding_indices"),
    )
    slim = filter_embedded(events, index).select(
        "session_id", "step_number", "user_id", "restaurant_id", "candidate_item", "label",
        "hour", context.meal_type_index(F.col("meal_type")).alias("meal_type_idx"),
        context.user_type_index(F.col("user_type")).alias("user_type_idx"),
    )
    return join_item_lookup(slim, features).drop("category_index").join(carts, ["session_id", "step_number"])


def class_balance(events: DataFrame) -> DataFrame:
    counts = events.agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
    )
    return counts.withColumns({
        "pos_weight": share(F.col("negatives"), F.col("positives")),
        "prior": share(F.col("positives"), F.col("positives") + F.col("negatives")),
    })
