"""Queries on the catalogue: cleaning, categories, filters, menus, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry import vocab
from basketry.functions import cleaning as c, context, keywords
from basketry.operators import catalogue, menu
from basketry.plans.registry import query
from basketry.sources.bindings import CartModel


def rows(m: CartModel) -> DataFrame:
    return catalogue.clean_rows(m["b_raw_menu"])


def restaurant_rows(m: CartModel) -> DataFrame:
    return catalogue.clean_restaurants(m["b_raw_menu"])


def dishes(m: CartModel) -> DataFrame:
    """Dishes with their restaurant's cuisine; the restaurant table has one row per restaurant."""
    cuisines = m["b_merchants"].select("restaurant_id", "cuisine")
    return keywords.with_categories(m["b_dishes"].join(cuisines, "restaurant_id", "left"))


def smoothed(m: CartModel) -> DataFrame:
    return menu.smoothed_rating(m["b_merchants"])


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def cleaned(column: str, build):
    """Each raw spelling with its cleaned value and frequency."""

    def run(m: CartModel) -> DataFrame:
        raw = counted(m["b_raw_menu"].select(F.col(column).alias("raw")), "raw")
        return raw.select("raw", build(F.col("raw")).alias("cleaned"), "n")

    return run


query("clean_city")(cleaned("city", c.clean_city))
query("clean_cuisine")(cleaned("cuisine", c.clean_cuisine))
query("clean_rating")(cleaned("dining_rating", c.clean_rating))
query("clean_votes")(cleaned("dining_votes", c.clean_votes))
query("clean_price")(cleaned("price", c.clean_price))
query("clean_item_name")(cleaned("item_name", c.clean_item_name))
query("clean_bestseller")(cleaned("best_seller", c.clean_bestseller))


@query("merchant_key")
def _(m):
    return counted(catalogue.filter_named(rows(m)), "restaurant_id", "restaurant_name", "city", "place")


@query("item_key")
def _(m):
    return counted(catalogue.filter_priced(rows(m)), "item_id", "restaurant_id", "item_name", "price")


@query("scan_pruned")
def _(m):
    return counted(m["lineitem"].select("l_orderkey"), "l_orderkey")


@query("filter_named")
def _(m):
    return counted(catalogue.filter_named(rows(m)), "restaurant_name")


@query("filter_priced")
def _(m):
    return counted(catalogue.filter_priced(rows(m)), "item_name", "price")


@query("filter_category")
def _(m):
    return m["b_items"].filter(F.col("item_category") == "dessert").select("item_id", "restaurant_id", "price")


@query("dedupe_merchants")
def _(m):
    return catalogue.dedupe_merchants(catalogue.filter_named(restaurant_rows(m)))


@query("impute_median")
def _(m):
    return catalogue.restaurants(restaurant_rows(m))


@query("join_known_merchant")
def _(m):
    known = catalogue.restaurants(restaurant_rows(m))
    return counted(catalogue.join_known_merchant(catalogue.filter_priced(rows(m)), known), "restaurant_id")


@query("dedupe_items")
def _(m):
    return catalogue.menu_items(rows(m), catalogue.restaurants(restaurant_rows(m)))


@query("cleaning_summary")
def _(m):
    merchants = catalogue.restaurants(restaurant_rows(m))
    return catalogue.cleaning_summary(m["b_raw_menu"], merchants, catalogue.menu_items(rows(m), merchants))


@query("category_index")
def _(m):
    return counted(
        m["b_items"].select("item_category", context.category_index(F.col("item_category")).alias("category_index")),
        "item_category", "category_index",
    )


@query("meal_type")
def _(m):
    return counted(m["b_sessions"].select("hour", context.meal_type(F.col("hour")).alias("meal_type")), "hour", "meal_type")


@query("context_encode")
def _(m):
    steps = m["b_adds"].join(m["b_items"], "item_id").join(m["b_sessions"], "session_id")
    meal = context.meal_type(F.col("hour"))
    encoded = context.context_columns(F.col("hour"), meal, F.col("user_type"), F.col("item_category"))
    return counted(steps.select(*[v.alias(k) for k, v in encoded.items()]), *encoded)


@query("cuisine_group")
def _(m):
    return counted(rows(m).select("cuisine", context.cuisine_group(F.col("cuisine")).alias("cuisine_group")),
                   "cuisine", "cuisine_group")


@query("price_fit")
def _(m):
    steps = m["b_adds"].join(m["b_items"], "item_id").join(m["b_sessions"], "session_id")
    user, price = F.col("user_type"), F.col("price")
    fits = steps.select("user_type", context.merchant_price_fit(user, price).alias("merchant_fit"),
                        context.item_price_fit(user, price).alias("item_fit"))
    return counted(fits, "user_type", "merchant_fit", "item_fit")


@query("keyword_matches")
def _(m):
    names = m["b_dishes"].select(F.lit("dish").alias("kind"), F.col("item_id").alias("id"), F.col("item_name").alias("text"))
    texts = m["documents"].select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), "text")
    return keywords.keyword_matches(names.unionByName(texts), keywords.keyword_table(m.spark), ["kind", "id"])


@query("categorize_items")
def _(m):
    return dishes(m).select("item_id", "item_category", "decision_source")


@query("category_confidence")
def _(m):
    return dishes(m).select("item_id", "item_category", "category_confidence")


@query("cuisine_fallback")
def _(m):
    cuisines = counted(rows(m), "cuisine").unionByName(counted(m["b_merchants"], "cuisine"))
    return cuisines.select("cuisine", keywords.cuisine_fallback(F.col("cuisine")).alias("category"), "n")


@query("veg_status")
def _(m):
    return dishes(m).select("item_id", "veg_flag", "veg_confidence")


@query("join_cuisine")
def _(m):
    return m["b_dishes"].join(m["b_merchants"].select("restaurant_id", "cuisine"), "restaurant_id", "left").select(
        "item_id", "restaurant_id", "cuisine"
    )


@query("enrich_menu")
def _(m):
    return dishes(m).select(
        "item_id", "restaurant_id", "item_name", "item_category", "veg_flag", "category_confidence", "veg_confidence"
    )


@query("fallback_stats")
def _(m):
    stats = dishes(m).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("category_confidence") >= 0.5).alias("rule_based"),
        F.count_if(F.col("decision_source") == "cuisine_fallback").alias("cuisine_fallback"),
        F.count_if(F.col("decision_source") == "default_fallback").alias("default_fallback"),
        F.count_if(F.col("category_confidence") < 0.5).alias("low_confidence"),
    )
    return stats.unpivot([], stats.columns, "stat", "n")


@query("category_summary")
def _(m):
    from basketry.operators.reports import category_summary

    return category_summary(dishes(m))


@query("smoothed_rating")
def _(m):
    return smoothed(m).select("restaurant_id", "delivery_rating", "delivery_votes", "smoothed_rating")


@query("smoothing_impact")
def _(m):
    return menu.smoothing_impact(smoothed(m))


@query("vote_minmax")
def _(m):
    return menu.vote_minmax(m["b_items"]).select("item_id", "restaurant_id", "vote_score")


@query("votes_norm_max")
def _(m):
    return menu.votes_norm_max(m["b_items"]).select("item_id", "restaurant_id", "norm_votes")


@query("menu_rank")
def _(m):
    return menu.menu_rank(m["b_items"]).select("item_id", "restaurant_id", "menu_score", "item_rank")


@query("cap_menu")
def _(m):
    return menu.cap_menu(m["b_items"], 50).select("item_id", "restaurant_id", "item_rank")


@query("capping_summary")
def _(m):
    return menu.capping_summary(m["b_items"], 50)


@query("merchant_price_stats")
@query("join_menu_stats")
def _(m):
    return menu.merchant_price_stats(m["b_merchants"], m["b_items"]).select(
        "restaurant_id", "avg_item_price", "price_std", "menu_size"
    )


@query("price_band")
def _(m):
    stats = menu.merchant_price_stats(m["b_merchants"], m["b_items"])
    return menu.price_band(stats).select("restaurant_id", "avg_item_price", "price_band_index")


@query("menu_listing")
def _(m):
    return menu.menu_listing(m["b_items"])


@query("recommend_popular")
def _(m):
    from basketry.operators.recommend import recommend_popular

    return recommend_popular(m["b_items"])


@query("integrity_anti_joins")
def _(m):
    from basketry.operators.reports import integrity_anti_joins

    return integrity_anti_joins(catalogue.dedupe_merchants(catalogue.filter_named(restaurant_rows(m))), catalogue.filter_priced(rows(m)))


@query("id_set_diff")
def _(m):
    merchants = catalogue.filter_named(rows(m)).select("restaurant_id")
    menus = catalogue.filter_priced(rows(m)).select("restaurant_id")
    only_menu = menus.subtract(merchants).withColumn("side", F.lit("menu_only"))
    return only_menu.unionByName(merchants.subtract(menus).withColumn("side", F.lit("restaurant_only")))
