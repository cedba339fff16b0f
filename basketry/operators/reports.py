"""Profiles, distributions, integrity checks and behavioural rates as long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from basketry.functions.numeric import share
from basketry.operators.menu import top_per
from basketry.operators.ordering import quantiles
from basketry.session import cut_lineage


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def melt(df: DataFrame, section: str) -> DataFrame:
    """One-row frame -> (section, metric, value)."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return doubles.unpivot([], doubles.columns, "metric", "value").select(
        F.lit(section).alias("section"), "metric", "value"
    )


def distribution(df: DataFrame, column: str, section: str) -> DataFrame:
    """Percentage of rows per value."""
    counts = df.groupBy(F.col(column).cast("string").alias("metric")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(F.lit(section).alias("section"), "metric", (100.0 * F.col("_n") / total).alias("value"))


def describe(df: DataFrame, column: str, percentiles: dict[str, float], zero_share: bool = False) -> DataFrame:
    x = F.col(column)
    stats = df.agg(
        F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_samp(x).alias("std"),
        *([(100.0 * F.count_if(x == 0) / F.count(F.lit(1))).alias("zero_pct")] if zero_share else []),
    )
    return melt(stats, column).unionByName(melt(quantiles(df, column, percentiles), column))


def profile_merchants(merchants: DataFrame) -> DataFrame:
    return union([
        melt(merchants.agg(F.count(F.lit(1)).alias("restaurants")), "total"),
        distribution(merchants, "city", "city_pct"),
        describe(merchants, "delivery_rating", {"median": 0.5}),
        describe(merchants, "delivery_votes", {"median": 0.5, "p95": 0.95}, zero_share=True),
    ])


def menu_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("menu_size"))


def profile_items(items: DataFrame) -> DataFrame:
    return union([
        melt(items.agg(
            F.count(F.lit(1)).alias("items"),
            (100.0 * F.count_if(F.col("best_seller") == 1) / F.count(F.lit(1))).alias("best_seller_pct"),
        ), "total"),
        describe(menu_sizes(items), "menu_size", {"median": 0.5}),
        describe(items, "price", {"median": 0.5, "p95": 0.95, "p99": 0.99}),
        distribution(items, "item_category", "category_pct"),
        describe(items, "item_votes", {"median": 0.5, "p95": 0.95}, zero_share=True),
    ])


def menu_size_anomalies(items: DataFrame, few: int = 3, many: int = 100) -> DataFrame:
    sizes = menu_sizes(items).filter((F.col("menu_size") < few) | (F.col("menu_size") > many))
    return sizes.withColumn("kind", F.when(F.col("menu_size") < few, "few").otherwise("many"))


def price_bound(items: DataFrame) -> Column:
    """Q3 + 3 IQR as a scalar."""
    edges = quantiles(items, "price", {"q1": 0.25, "q3": 0.75})
    return edges.select(F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).scalar()


def price_outliers(items: DataFrame, cheap: float = 10.0, top: int = 10) -> DataFrame:
    columns = ["item_id", "restaurant_id", "price"]
    marked = items.select(*columns, price_bound(items).alias("_bound"))
    extreme = marked.filter(F.col("price") > F.col("_bound")).select(*columns, F.lit("extreme").alias("kind"))
    low = items.filter(F.col("price") <= cheap).select(*columns, F.lit("cheap").alias("kind"))
    dearest = items.select(*columns).orderBy(F.desc("price"), F.asc("item_id")).limit(top)
    return union([extreme, low, dearest.withColumn("kind", F.lit("dearest"))])


def integrity_anti_joins(merchants: DataFrame, items: DataFrame) -> DataFrame:
    """Restaurant ids of menus without restaurant, and restaurants without menu."""
    sold, known = items.select("restaurant_id").distinct(), merchants.select("restaurant_id").distinct()
    orphans = sold.join(known, "restaurant_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_menus"))
    empty = known.join(sold, "restaurant_id", "left_anti").agg(F.count(F.lit(1)).alias("restaurants_without_menu"))
    return union([melt(orphans, "integrity"), melt(empty, "integrity")])


def category_summary(enriched: DataFrame) -> DataFrame:
    confidence = F.col("category_confidence")
    stats = enriched.agg(
        F.count(F.lit(1)).alias("items"),
        F.avg(confidence).alias("mean_confidence"),
        F.avg("veg_confidence").alias("mean_veg_confidence"),
        (100.0 * F.count_if(F.col("item_category") == "unknown") / F.count(F.lit(1))).alias("unknown_pct"),
        F.count_if(confidence < 0.5).alias("low_confidence"),
    )
    return union([
        melt(stats, "total"),
        melt(quantiles(enriched, "category_confidence", {"median_confidence": 0.5}), "total"),
        distribution(enriched, "item_category", "category_pct"),
        distribution(enriched, "veg_flag", "veg_pct"),
    ])


def session_summary(events: DataFrame) -> DataFrame:
    """Label shares, and the mix of positives by meal, user type, city and hour.

    One pass: rows are counted per combination of attributes before they fan out to the sections.
    """
    attributes = ["meal_type", "user_type", "city", "hour"]
    counts = events.groupBy("label", *attributes).agg(F.count(F.lit(1)).alias("_n"))
    sections = [F.struct(F.lit("label").alias("section"), F.col("label").cast("string").alias("value"))] + [
        F.when(F.col("label") == 1, F.struct(F.lit(a).alias("section"), F.col(a).cast("string").alias("value")))
        for a in attributes
    ]
    long = counts.select("_n", F.explode(F.array(*sections)).alias("_s")).filter(F.col("_s").isNotNull())
    result = long.groupBy("_s.section", "_s.value").agg(F.sum("_n").alias("n"))
    totals = result.groupBy("section").agg(F.sum("n").alias("_total"))
    return result.join(totals, "section").select(
        "section", "value", "n", (100.0 * F.col("n") / F.col("_total")).alias("pct")
    )


def attach_rates(adds: DataFrame) -> DataFrame:
    """Items per category relative to the number of sessions."""
    sessions = adds.agg(F.countDistinct("session_id")).scalar()
    counts = adds.groupBy("item_category").agg(F.count(F.lit(1)).alias("items"))
    return counts.select("item_category", "items", (100.0 * F.col("items") / sessions).alias("rate_pct"))


def _signals(df: DataFrame, signals: dict[str, tuple[Column, Column]], scope: str) -> DataFrame:
    """(condition, outcome) pairs -> base, hits and rate, all in one aggregate."""
    rates = df.agg(*[
        F.struct(
            F.count_if(condition).alias("base"), F.count_if(condition & outcome).alias("hits")
        ).alias(name)
        for name, (condition, outcome) in signals.items()
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("signal"), F.col(f"{n}.base").alias("base"), F.col(f"{n}.hits").alias("hits"))
        for n in signals
    ])
    return rates.select(F.inline(rows)).select(
        F.lit(scope).alias("scope"), "signal", "base", "hits", share(F.col("hits"), F.col("base")).alias("rate")
    )


def conditional_attach(steps: DataFrame) -> DataFrame:
    """How often a gap is filled, per whole session and per single add."""
    category, seen = F.col("item_category"), F.col("cart_categories")
    premium, big_meal = F.col("user_type").isin("premium", "luxury"), F.col("meal_type").isin("lunch", "dinner")

    def number(name: str) -> Column:
        return F.size(F.filter(seen, lambda c: c == name))

    def heavy(mains: Column, sides: Column) -> Column:
        return (mains >= 2) | ((mains >= 1) & (sides >= 1))

    sessions = steps.groupBy("session_id").agg(
        *[F.count_if(category == name).alias(name) for name in ("main", "side", "beverage", "dessert")],
        F.max("user_type").alias("user_type"),
        F.max("meal_type").alias("meal_type"),
    )
    has = {name: F.col(name) > 0 for name in ("main", "beverage", "dessert")}
    whole = _signals(sessions, {
        "main_beverage": (has["main"], has["beverage"]),
        "heavy_dessert": (heavy(F.col("main"), F.col("side")), has["dessert"]),
        "premium_dessert": (premium, has["dessert"]),
        "other_user_dessert": (~premium, has["dessert"]),
        "lunch_dinner_beverage": (big_meal, has["beverage"]),
        "other_meal_beverage": (~big_meal, has["beverage"]),
    }, "session")
    gap = F.array_contains(seen, "main") & ~F.array_contains(seen, "beverage")
    single = _signals(steps, {
        "main_gap_beverage": (gap, category == "beverage"),
        "heavy_dessert": (heavy(number("main"), number("side")), category == "dessert"),
        "premium_dessert": (premium, category == "dessert"),
        "other_user_dessert": (~premium, category == "dessert"),
        "lunch_dinner_beverage": (big_meal, category == "beverage"),
        "other_meal_beverage": (~big_meal, category == "beverage"),
    }, "step")
    return whole.unionByName(single)


def positive_rate_by_category(events: DataFrame) -> DataFrame:
    """Acceptance per candidate category and its share among positives and negatives.

    ``events`` may hold ``n``, the number of like rows that a row stands for.
    """
    n = F.col("n") if "n" in events.columns else F.lit(1)
    counts = events.groupBy("item_category").agg(
        F.sum(n).cast("long").alias("shown"), F.sum(F.col("label") * n).cast("long").alias("positives")
    )
    counts = cut_lineage(counts)  # a row per category, read twice
    totals = counts.agg(F.struct(F.sum("positives").alias("p"), F.sum(F.col("shown") - F.col("positives")).alias("n"))).scalar()
    return counts.withColumn("_t", totals).select(
        "item_category", "shown", "positives",
        share(F.col("positives"), F.col("shown")).alias("positive_rate"),
        share(100 * F.col("positives"), F.col("_t.p")).alias("positive_share_pct"),
        share(100 * (F.col("shown") - F.col("positives")), F.col("_t.n")).alias("negative_share_pct"),
    )


def label_correlations(training: DataFrame) -> DataFrame:
    """Pearson correlation of the label with flags and their interactions."""
    flags = {f"is_{name}": (F.col("category_index") == index).cast("int")
             for name, index in (("beverage", 3), ("dessert", 2), ("main", 0))}
    flags |= {name: F.col(name) for name in ("missing_beverage", "missing_dessert", "heavy_meal")}
    flags |= {
        "missing_bev_x_is_bev": flags["missing_beverage"] * flags["is_beverage"],
        "missing_des_x_is_des": flags["missing_dessert"] * flags["is_dessert"],
        "heavy_x_is_des": flags["heavy_meal"] * flags["is_dessert"],
    }
    label = F.col("label").cast("double")
    row = training.agg(*[F.corr(x.cast("double"), label).alias(n) for n, x in flags.items()])
    long = row.unpivot([], list(flags), "feature", "correlation")
    return long.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))


def null_audit(df: DataFrame) -> DataFrame:
    """Missing values per column; for list columns also the empty ones. One aggregate."""
    entries = []
    for field in df.schema.fields:
        column = F.col(field.name)
        empty = F.count_if(F.size(column) == 0) if isinstance(field.dataType, T.ArrayType) else F.lit(None).cast("long")
        entries.append(F.struct(
            F.lit(field.name).alias("column"), F.count(F.lit(1)).alias("rows"),
            F.count_if(column.isNull()).alias("nulls"), empty.alias("empty_lists"),
        ))
    return df.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))


def recommended_actions(merchants: DataFrame, items: DataFrame) -> DataFrame:
    """Data-quality rules that fire, with the number of affected rows."""
    sizes = menu_sizes(items)
    found = [
        ("filter_small_menus", sizes.agg(F.count_if(F.col("menu_size") < 3)), 0.0),
        ("review_large_menus", sizes.agg(F.count_if(F.col("menu_size") > 100)), 0.0),
        ("review_price_outliers", items.select("price", price_bound(items).alias("_b")).agg(
            F.count_if(F.col("price") > F.col("_b"))), 0.0),
        ("many_restaurants_without_votes", merchants.agg(
            F.when(F.avg((F.col("delivery_votes") == 0).cast("int")) > 0.5,
                   F.count_if(F.col("delivery_votes") == 0)).otherwise(0)), 0.0),
        ("improve_unknown_categories", items.agg(F.count_if(F.col("item_category") == "unknown")), 0.0),
        ("fix_orphan_items", items.select("restaurant_id").distinct().join(
            merchants, "restaurant_id", "left_anti").agg(F.count(F.lit(1))), 0.0),
        ("drop_restaurants_without_menu", merchants.join(
            items, "restaurant_id", "left_anti").agg(F.count(F.lit(1))), 0.0),
    ]
    rows = [df.toDF("affected").select(F.lit(name).alias("action"), F.col("affected").cast("long")) for name, df, _ in found]
    return union(rows).filter(F.col("affected") > 0)
