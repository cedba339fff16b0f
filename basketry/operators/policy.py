"""Replay of logged choices under a ranking policy: acceptance, revenue, lift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from basketry import vocab
from basketry.functions.numeric import money, share
from basketry.operators.evaluate import STEP, rank_labels, step_order


def popularity_scores(events: DataFrame, ranks: DataFrame) -> DataFrame:
    """Score by position in the restaurant's popularity list; unlisted items last."""
    listed = ranks.select(F.col("item_id").alias("candidate_item"), "popularity_rank")
    return events.join(listed, "candidate_item", "left").withColumn(
        "score", -F.col("popularity_rank").cast("double")
    ).drop("popularity_rank")


def accepted_addons(scored: DataFrame, prices: DataFrame | None, k: int = vocab.TOP_RECOMMENDATIONS) -> DataFrame:
    """Per step: items accepted among the first ``k``, their value and the first position.

    An item that is listed more than once counts as often. Without ``prices`` the column of that name in ``scored`` holds
    the prices of an added item's listings, and no row moves.
    """
    ranked = rank_labels(scored)
    accepted = (F.col("rank") <= k) & (F.col("label") == 1)
    line = F.struct("candidate_item") if prices is not None else F.struct("candidate_item", "prices")
    # where the step has been ranked: its first row stands for it, the others are needed if accepted
    ranked = ranked.filter(F.col("rank") <= max(k, 1)).filter((F.col("rank") == 1) | (F.col("label") == 1))
    step = step_order(STEP).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = ranked.select(*STEP, "rank", F.when(accepted, line).alias("_line"), F.when(accepted, F.col("rank")).alias("_at"), "score", "candidate_item")
    taken = taken.withColumns({
        "_taken": F.collect_list("_line").over(step),
        "first_position": F.coalesce(F.min("_at").over(step), F.lit(-1)),
    }).filter("rank = 1").select(*STEP, "first_position", "_taken")
    if prices is None:
        # an item without a listing counts once, at the default price
        unlisted = F.array(F.lit(None).cast("double"))
        each = F.flatten(F.transform("_taken", lambda x: F.when(F.size(x["prices"]) > 0, x["prices"]).otherwise(unlisted)))
        nothing = F.lit(0).cast("decimal(38,2)")
        amounts = F.transform(each, lambda x: F.coalesce(money(F.coalesce(x, F.lit(vocab.DEFAULT_ITEM_PRICE))), F.lit(0).cast("decimal(28,2)")))
        value = F.aggregate(amounts, nothing, lambda a, x: (a + x).cast("decimal(38,2)"))
        return taken.select(*STEP, F.size(each).cast("long").alias("accepted"), value.cast("double").alias("value"), "first_position")
    lines = taken.select(*STEP, "first_position", F.explode_outer("_taken").alias("_line"))
    lines = lines.select(*STEP, "first_position", F.col("_line").isNotNull().alias("_any"), F.col("_line.candidate_item").alias("candidate_item"))
    # only accepted items move to their price
    priced = lines.join(prices.select(F.col("item_id").alias("candidate_item"), "price"), "candidate_item", "left")
    price = F.coalesce("price", F.lit(vocab.DEFAULT_ITEM_PRICE))
    return priced.groupBy(*STEP).agg(
        F.count_if("_any").alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("_any"), money(price))).cast("double"), F.lit(0.0)).alias("value"),
        F.min("first_position").alias("first_position"),
    )


def policy_metrics(accepted: DataFrame) -> DataFrame:
    took = F.col("accepted") > 0
    totals = accepted.groupBy("policy").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(took).alias("_accepting"),
        F.sum("accepted").alias("_addons"),
        F.sum(money(F.col("value"))).cast("double").alias("revenue"),
        F.avg(F.when(took, F.col("first_position"))).alias("_position"),
    )
    zero = F.lit(0.0)
    return totals.select(
        "policy",
        "steps",
        share(F.col("_accepting"), F.col("steps")).alias("attach_rate"),
        F.coalesce(share(F.col("_addons"), F.col("_accepting")), zero).alias("addons_per_accepting"),
        F.coalesce(share(F.col("revenue"), F.col("_addons")), zero).alias("avg_addon_price"),
        "revenue",
        share(F.col("revenue"), F.col("steps")).alias("revenue_per_step"),
        share(F.col("_addons"), F.col("steps")).alias("items_per_step"),
        F.coalesce("_position", zero).alias("avg_position"),
    )


def policy_lift(metrics: DataFrame, baseline: str) -> DataFrame:
    """Percentage change of every metric against the baseline policy."""
    names = [c for c in metrics.columns if c not in ("policy", "steps")]
    long = metrics.select("policy", *[F.col(x).cast("double").alias(x) for x in names]).unpivot(
        ["policy"], names, "metric", "value"
    )
    base = long.filter(F.col("policy") == baseline).select("metric", F.col("value").alias("base_value"))
    others = long.filter(F.col("policy") != baseline)
    lift = 100.0 * F.try_divide(F.col("value") - F.col("base_value"), F.col("base_value"))
    return others.join(base, "metric").select("policy", "metric", "value", "base_value", lift.alias("lift_pct"))


def revenue_projection(metrics: DataFrame, baseline: str, daily_sessions: float = 960000.0) -> DataFrame:
    """Daily revenue at the measured rates and the daily and annual uplift over the baseline."""
    price = F.col("avg_addon_price")
    base = metrics.filter(F.col("policy") == baseline).agg(F.max("attach_rate")).scalar()
    revenue, base_revenue = daily_sessions * F.col("attach_rate") * price, daily_sessions * base * price
    return metrics.select(
        "policy",
        revenue.alias("daily_revenue"),
        (revenue - base_revenue).alias("daily_uplift"),
        ((revenue - base_revenue) * 365).alias("annual_uplift"),
    )
