"""Rows that move less: small lookups go to the rows, steps move before their items are shown, state leaves the heap."""

import os

from pyspark.sql import functions as F

from basketry.operators import policy, ranker, recommend, sampling
from basketry.plans import cart_queries, evaluation_queries as eq, feature_queries as fq
from basketry.plans.registry import QUERIES
from basketry.sources import sinks
from basketry.streaming import jobs
from tests.test_growth import no_size_checks, plan, small_menu, some_steps  # noqa: F401


def moves(df):
    return [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]


def test_shown_items_meet_their_vectors_where_they_are_drawn(spark, model):
    with no_size_checks(spark):
        found = moves(fq.training(model))
    assert found and not any("candidate_item#" in x or "cart_item#" in x for x in found)


def test_no_shown_item_moves_to_its_vector_for_the_ranker(spark, model, monkeypatch):
    """Neither for the split nor for the inputs; steps without a candidate do not move either."""
    cut, plans = ranker.cut_lineage, []

    def spy(df):
        plans.append(df)
        return cut(df)

    monkeypatch.setattr(ranker, "cut_lineage", spy)
    with no_size_checks(spark):
        fq.split_inputs(model)
        shown = [moves(x) for x in plans if "label" in x.columns]
        inputs = fq.model_inputs(model)
        held = [x for x in plan(inputs).splitlines() if "LeftSemi" in x]
    assert shown and not any("candidate_item#" in x for found in shown for x in found)
    assert held and all("BroadcastHashJoin" in x for x in held)


def test_added_items_without_a_vector_leave_before_carts_are_looked_up(spark, model):
    with no_size_checks(spark):
        found = moves(QUERIES["interaction_features"](model))
    assert found and not any("cart_item#" in x for x in found)


def test_graph_and_carts_come_from_adds_read_once(spark, model, monkeypatch):
    asked = []
    whole = recommend.recommend_cooc
    monkeypatch.setattr(recommend, "recommend_cooc", lambda carts, *more, **how: asked.append(carts) or whole(carts, *more, **how))
    with no_size_checks(spark):
        best = QUERIES["recommend_cooc"](model)
        assert "l_orderkey" not in plan(best)
        found = [x for x in plan(best).splitlines() if "Exchange" in x and "request_id#" in x]
        assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0]
    want = cart_queries.typed_adds(model).select(F.col("session_id").alias("request_id"), F.col("item_name").alias("item_id")).distinct()
    assert asked[0].exceptAll(want).isEmpty() and want.exceptAll(asked[0]).isEmpty()


def test_steps_move_to_their_period_before_items_are_drawn(spark, small_menu, some_steps, monkeypatch, tmp_path):  # noqa: F811
    days = some_steps.withColumn("ts", F.expr("timestamp_seconds(1000000000 + session_id * 86400)"))
    whole = sinks.write_events(sampling.cart_events(days, small_menu), str(tmp_path / "whole"), "month")
    written, write = [], sinks.write_table
    monkeypatch.setattr(sinks, "write_table", lambda df, *more, **how: written.append(df) or write(df, *more, **how))
    first = sinks.write_events(days, str(tmp_path / "first"), "month", tasks=3, show=lambda x: sampling.cart_events(x, small_menu))
    steps = plan(written[0])
    assert "REPARTITION_BY_NUM" in steps.split("ArrowEvalPython")[1] and "Exchange" not in steps.split("ArrowEvalPython")[0]
    assert first.columns == whole.columns and whole.count() > days.count()
    assert sorted(map(str, first.collect())) == sorted(map(str, whole.collect()))


def test_prices_that_come_with_an_item_give_the_same_values(spark):
    rows = [("p", 1, 0, 7, 1, 0.9, [2.5, 2.5]), ("p", 1, 0, 8, 0, 0.1, None), ("p", 2, 0, 7, 1, 0.1, [2.5, 2.5]), ("p", 2, 0, 8, 0, 0.9, None),
            ("p", 3, 0, 9, 1, 0.5, None), ("p", 4, 0, 5, 1, None, [None]), ("p", 4, 0, 6, 1, 0.2, [4.0]), ("q", 4, 0, 6, 1, 0.2, [4.0]), ("q", 5, 0, 8, 0, 0.3, None)]
    scored = spark.createDataFrame(rows, "policy string, session_id long, step_number int, candidate_item long, label int, score double, prices array<double>")
    prices = spark.createDataFrame([(7, 2.5), (8, 4.0), (7, 2.5), (5, None), (6, 4.0)], "item_id long, price double")
    with no_size_checks(spark):
        own = policy.accepted_addons(scored, None, 2)
        assert not any("candidate_item#" in x for x in moves(own))
    for k in (1, 2):
        by = [sorted(map(str, policy.accepted_addons(scored, p, k).collect())) for p in (None, prices)]
        assert by[0] == by[1] and len(by[0]) == 6


def test_policies_are_measured_once(model):
    assert "Window" not in plan(eq.measured(model))


def test_open_carts_are_kept_in_files_not_on_the_heap(spark, model, monkeypatch):
    """Changelogs of RocksDB stand in the stream's log; the session's own settings come back."""
    made, key = [], "spark.sql.streaming.stateStore.providerClass"
    path = jobs.scratch_path
    monkeypatch.setattr(jobs, "scratch_path", lambda *names: made.append(path(*names)) or made[-1])
    before = spark.conf.get(key)
    answers = eq.recommend_stream(model, jobs.stream_table(spark, model.sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey % 50 = 0"))
    assert answers.count() > 0 and spark.conf.get(key) == before
    files = [f for _, _, names in os.walk(f"{made[0]}-log/state") for f in names]
    assert any(f.endswith((".changelog", ".zip")) for f in files) and not any(f.endswith(".delta") for f in files)
