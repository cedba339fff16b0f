"""From the dirty menu export to restaurant and menu tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import cleaning as c
from basketry.operators.ordering import quantile


RESTAURANT_COLUMNS = ["restaurant_name", "city", "place", "cuisine", "delivery_rating", "delivery_votes", "dining_rating",
                      "dining_votes"]


def _restaurant_columns() -> list[Column]:
    return [
        c.strip(F.col("restaurant_name")).alias("restaurant_name"),
        c.clean_city(F.col("city")).alias("city"),
        c.strip(F.col("place")).alias("place"),
        c.clean_cuisine(F.col("cuisine")).alias("cuisine"),
        c.clean_rating(F.col("delivery_rating")).alias("delivery_rating"),
        c.clean_votes(F.col("delivery_votes")).alias("delivery_votes"),
        c.clean_rating(F.col("dining_rating")).alias("dining_rating"),
        c.clean_votes(F.col("dining_votes")).alias("dining_votes"),
    ]


def _with_restaurant_id(df: DataFrame) -> DataFrame:
    return df.withColumn("restaurant_id", c.merchant_key(F.col("restaurant_name"), F.col("city"), F.col("place")))


def clean_restaurants(raw: DataFrame) -> DataFrame:
    """The restaurant columns alone: every distinct spelling is cleaned once, however many menu rows repeat it."""
    return _with_restaurant_id(raw.select(*RESTAURANT_COLUMNS).distinct().select(*_restaurant_columns()))


def clean_rows(raw: DataFrame) -> DataFrame:
    """All cleaned columns and both ids in one projection.

    Restaurants and menu items are both taken from this frame, hence share their keys.
    """
    cleaned = raw.select(
        *_restaurant_columns(),
        c.clean_item_name(F.col("item_name")).alias("item_name"),
        c.clean_price(F.col("price")).alias("price"),
        c.clean_votes(F.col("item_votes")).alias("item_votes"),
        c.clean_bestseller(F.col("best_seller")).alias("best_seller"),
    )
    keyed = _with_restaurant_id(cleaned)
    return keyed.withColumn("item_id", c.item_key(F.col("restaurant_id"), F.col("item_name"), F.col("price")))


def filter_named(df: DataFrame) -> DataFrame:
    return df.filter(F.length("restaurant_name") > 0)


def filter_priced(df: DataFrame) -> DataFrame:
    return df.filter((F.col("price") > 0) & (F.length("item_name") > 0))


def keep_best(df: DataFrame, key: str, priority: list[str]) -> DataFrame:
    """One row per key: the highest by ``priority``.

    An aggregate rather than a window: copies are reduced before the shuffle, so a key that
    holds most of the rows costs one row per task.
    """
    rest = [x for x in df.columns if x != key and x not in priority]
    best = F.max(F.struct(*priority, *rest)).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{x}").alias(x) for x in [*priority, *rest]])


def dedupe_merchants(rows: DataFrame) -> DataFrame:
    columns = ["delivery_votes", "delivery_rating", "dining_rating", "cuisine", "city", "restaurant_name"]
    return keep_best(rows.select("restaurant_id", "dining_votes", *columns), "restaurant_id", ["dining_votes", *columns])


def dedupe_items(rows: DataFrame) -> DataFrame:
    columns = ["item_votes", "best_seller", "price", "item_name", "restaurant_id"]
    return keep_best(rows.select("item_id", *columns), "item_id", columns)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill missing values with the exact median of the column."""
    return df.withColumns({x: F.coalesce(F.col(x), quantile(df, x, 0.5)) for x in columns})


def restaurants(rows: DataFrame) -> DataFrame:
    unique = dedupe_merchants(filter_named(rows))
    return impute_median(unique, ["delivery_rating", "dining_rating"])


def join_known_merchant(items: DataFrame, known: DataFrame) -> DataFrame:
    return items.join(known.select("restaurant_id"), "restaurant_id", "left_semi")


def menu_items(rows: DataFrame, known: DataFrame) -> DataFrame:
    return dedupe_items(join_known_merchant(filter_priced(rows), known))


def cleaning_summary(raw: DataFrame, merchants: DataFrame, items: DataFrame) -> DataFrame:
    """Long table (section, metric, value) of counts, retention and the most frequent values."""
    raw_n = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    merchant = merchants.agg(
        F.count(F.lit(1)).alias("restaurants"),
        F.countDistinct("city").alias("cities"),
        F.countDistinct("cuisine").alias("cuisines"),
        F.max("delivery_rating").alias("max_delivery_rating"),
        F.max("dining_rating").alias("max_dining_rating"),
    )
    menu = items.agg(
        F.count(F.lit(1)).alias("items"),
        F.countDistinct("item_name").alias("item_names"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("best_seller").alias("best_sellers"),
    )
    rows = raw_n.scalar()

    def long(df: DataFrame, section: str) -> DataFrame:
        doubles = df.select(*[F.col(x).cast("double").alias(x) for x in df.columns])
        melted = doubles.unpivot([], doubles.columns, "metric", "value")
        return melted.select(F.lit(section).alias("section"), "metric", "value")

    menu = menu.withColumn("retained_pct", 100.0 * F.col("items") / rows)
    merchant = merchant.withColumn("compression_pct", 100.0 * F.col("restaurants") / rows)

    def top(column: str) -> DataFrame:
        counts = merchants.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        best = counts.orderBy(F.desc("n"), column).limit(5)
        return best.select(
            F.lit(f"top_{column}").alias("section"), F.col(column).alias("metric"), F.col("n").cast("double").alias("value")
        )

    parts = [long(raw_n, "raw"), long(merchant, "restaurants"), long(menu, "menu"), top("city"), top("cuisine")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
