"""Queries on offline evaluation, policies, reports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry.functions import context, keywords
from basketry.operators import catalogue, cooccurrence as co, evaluate as ev, features as ft, menu, policy, reports
from basketry.operators.recommend import recommend_cooc
from basketry.plans.cart_queries import LINES_PER_TASK, dense_edges, events, line_tasks, steps, typed_adds
from basketry.plans.catalogue_queries import counted, dishes, restaurant_rows, rows
from basketry.plans.feature_queries import item_table, training
from basketry.plans.registry import query
from basketry.session import cut_lineage, scratch_path
from basketry.sources import sinks
from basketry.sources.bindings import CartModel
from basketry.streaming import jobs


STEPS_PER_TASK = LINES_PER_TASK


def step_tasks(m: CartModel) -> int:
    """Tasks that hold the sort of all shown items, and of carts before, in memory."""
    return line_tasks(m, STEPS_PER_TASK)


def scored_policies(m: CartModel, *names: str, priced: bool = False) -> DataFrame:
    """Every shown item scored by three policies, or by those named; the events are generated once.

    ``priced``: added items bring the prices of their listings as ``prices``.

    Added items meet their listing among the adds, shown ones are of the capped menus, which are few: no shown item moves
    to its listing, and all of a step stay in the task of their session.
    """
    listed = menu.popularity_rank(m["b_items"]).select("item_id", "popularity_rank", "item_category", "price")
    listings = cut_lineage(listed.groupBy("item_id").agg(F.collect_list(F.struct("popularity_rank", "item_category", "price")).alias("listing")))
    capped = menu.small_pools(listings.join(menu.cap_menu(m["b_items"]), "item_id", "left_semi"), 1)
    capped = capped.select(F.col("item_id").alias("candidate_item"), F.col("listing").alias("_capped"))
    slim = events(m, listings, tasks=step_tasks(m)).select(
        "session_id", "step_number", "candidate_item", "label", context.lacks(F.col("cart_categories"), "beverage").alias("_lacks"),
        F.when(F.col("label") == 1, F.col("listing")).alias("_own"))
    found = F.when(F.col("label") == 1, F.col("_own")).otherwise(F.col("_capped"))
    prices = [F.col("_own.price").alias("prices")] if priced else []
    joined = slim.join(capped, "candidate_item", "left").select(
        "session_id", "step_number", "candidate_item", "label", "_lacks", *prices, F.inline_outer(found))
    gap = F.col("_lacks") * (F.col("item_category") == "beverage").cast("int")
    scores = {
        "heuristic": F.coalesce(gap, F.lit(0)).cast("double"),
        "popularity": (-F.col("popularity_rank")).cast("double"),
        "random": ev.random_score(),
    }
    entries = [F.struct(F.lit(name).alias("policy"), scores[name].alias("score")) for name in names or scores]
    return joined.select("session_id", "step_number", "candidate_item", "label", *(["prices"] if priced else []), F.inline(F.array(*entries)))


def one_policy(m: CartModel, name: str) -> DataFrame:
    return scored_policies(m, name)


def popularity_steps(m: CartModel) -> DataFrame:
    return ev.step_metrics(ev.rank_labels(one_policy(m, "popularity")))


@query("rank_labels")
def _(m):
    return counted(ev.rank_labels(one_policy(m, "popularity")), "label", "rank")


for _metric in ("precision", "recall", "ndcg", "acceptance"):

    @query(f"{_metric}_at_k")
    def _(m, metric=_metric):
        return popularity_steps(m).select("session_id", "step_number", *[f"{metric}_{k}" for k in ev.KS])


@query("mrr")
def _(m):
    return popularity_steps(m).select("session_id", "step_number", "mrr")


@query("metrics_table")
def _(m):
    return ev.metrics_table(scored_policies(m, "popularity", "random"), "popularity", "random")


@query("random_baseline")
def _(m):
    return ev.policy_means(one_policy(m, "random"))


@query("popularity_ranking")
def _(m):
    scored = policy.popularity_scores(events(m), menu.popularity_rank(m["b_items"]))
    ranked = ev.rank_labels(scored.withColumn("policy", F.lit("popularity")))
    return ranked.filter(F.col("rank") == 1).select("session_id", "step_number", "candidate_item", "label")


@query("accepted_addons")
def _(m):
    return policy.accepted_addons(scored_policies(m, "popularity", priced=True), None, 3)


def measured(m: CartModel) -> DataFrame:
    """One row per policy, computed once: what compares policies reads them more than once."""
    return cut_lineage(policy.policy_metrics(policy.accepted_addons(scored_policies(m, priced=True), None, 3)))


@query("policy_metrics")
def _(m):
    return measured(m)


@query("policy_lift")
def _(m):
    return policy.policy_lift(measured(m), "popularity")


@query("revenue_projection")
def _(m):
    return policy.revenue_projection(measured(m), "popularity")


@query("auc_exact")
def _(m):
    return ev.auc_exact(scored_policies(m), ["policy"])


@query("average_precision")
def _(m):
    return ev.average_precision(scored_policies(m), ["policy"])


@query("profile_merchants")
def _(m):
    return reports.profile_merchants(catalogue.restaurants(restaurant_rows(m)))


@query("profile_items")
def _(m):
    return reports.profile_items(m["b_items"])


@query("menu_size_anomalies")
def _(m):
    return reports.menu_size_anomalies(catalogue.menu_items(rows(m), catalogue.restaurants(restaurant_rows(m))))


@query("price_outliers")
def _(m):
    return reports.price_outliers(catalogue.menu_items(rows(m), catalogue.restaurants(restaurant_rows(m))))


@query("session_summary")
def _(m):
    return reports.session_summary(events(m))


@query("attach_rates")
def _(m):
    return reports.attach_rates(typed_adds(m))


@query("conditional_attach")
def _(m):
    return reports.conditional_attach(steps(m))


def typed_events(m: CartModel) -> DataFrame:
    """Shown items with their category, like ones counted (``n``) before they move to their item."""
    categories = m["b_items"].select(F.col("item_id").alias("candidate_item"), "item_category")
    return counted(events(m), "candidate_item", "label").join(categories, "candidate_item", "left")


@query("positive_rate_by_category")
def _(m):
    return reports.positive_rate_by_category(typed_events(m))


@query("label_correlations")
def _(m):
    looked = ft.join_item_lookup(training(m).drop("embedding_idx"), item_table(m))
    return reports.label_correlations(looked)


@query("null_audit")
def _(m):
    return reports.null_audit(training(m))


@query("recommended_actions")
def _(m):
    merchants = catalogue.restaurants(restaurant_rows(m))
    items = keywords.with_categories(catalogue.filter_priced(rows(m)))
    return reports.recommended_actions(merchants, catalogue.keep_best(
        items.select("item_id", "restaurant_id", "price", "item_category"), "item_id", ["price"]))


@query("stream_enrich")
def _(m):
    stream = jobs.stream_table(m.spark, m.sf_dir, "lineitem")
    return jobs.run_to_table(jobs.enrich(stream, m), "enriched")


@query("stream_attach_rate")
def _(m):
    return jobs.run_to_table(jobs.attach_rate(jobs.stream_table(m.spark, m.sf_dir, "events")), "attach")


@query("stream_top_items")
def _(m):
    windows = jobs.item_windows(jobs.stream_table(m.spark, m.sf_dir, "events"))
    return jobs.run_batches(windows, "top-items", jobs.top_items)


@query("stream_sessions")
def _(m):
    return jobs.run_to_table(jobs.activity_sessions(jobs.stream_table(m.spark, m.sf_dir, "events")), "visits")


def recommend_stream(m: CartModel, lines: DataFrame, delay: str = "10000 days") -> DataFrame:
    """Answers to carts that arrive as order lines; a cart may be cut over many files.

    The order table has no arrival order, so by default a line may come any time after its order's date and carts
    close when the input ends. The graph is stored once and read by every batch.
    """
    graph = sinks.write_table(dense_edges(m).select("src", "dst", "prob"), scratch_path(m.spark, "graph"))
    names = m["b_items"].select("item_id", "item_name")
    dated = m["b_sessions"].select("session_id", F.col("ts").cast("timestamp").alias("ts"))
    placed = lines.join(names, lines["l_partkey"] == names["item_id"]).join(dated, lines["l_orderkey"] == dated["session_id"])
    adds = placed.select(F.col("session_id").alias("request_id"), F.col("item_name").alias("item_id"), "ts")

    def answer(batch: DataFrame) -> DataFrame:
        return recommend_cooc(batch.select("request_id", F.explode("items").alias("item_id")), graph)

    return jobs.run_closed(adds, "answers", answer, lambda stream: jobs.carts(stream, delay))


@query("stream_recommend")
def _(m):
    return recommend_stream(m, jobs.stream_table(m.spark, m.sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
