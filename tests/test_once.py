"""Work that is done once a row, and rows that are counted before they move."""

import itertools

import pytest
from pyspark.sql import functions as F

from basketry.functions import cleaning
from basketry.operators import evaluate, menu, ranker, reports, sampling
from basketry.plans import cart_queries, evaluation_queries as eq, feature_queries as fq
from basketry.plans.registry import QUERIES
from tests.test_growth import no_size_checks, plan, small_menu, some_steps  # noqa: F401


def test_both_event_tables_come_from_one_draw(model):
    assert "ArrowEvalPython" not in plan(QUERIES["union_events"](model))


def test_a_step_carries_the_number_of_its_pool(spark, small_menu, some_steps, monkeypatch):  # noqa: F811
    drawn = sampling.with_negatives(some_steps, small_menu, n=5, cap=15)
    assert plan(drawn).count("pool#") == 1  # where pools are read
    monkeypatch.setattr(sampling, "BROADCAST_ENTRIES", 0)  # pools too many to send: they ride in the rows
    moved = sampling.with_negatives(some_steps, small_menu, n=5, cap=15)
    assert plan(moved).count("pool#") > 1
    assert sorted(map(str, drawn.collect())) == sorted(map(str, moved.collect()))


def test_like_events_are_counted_before_they_meet_their_item(model):
    tallied = eq.typed_events(model)
    assert tallied.agg(F.sum("n")).first()[0] == cart_queries.events(model).count() > tallied.count()
    with no_size_checks(model.spark):
        moves = [x for x in plan(QUERIES["gap_heuristic_score"](model)).splitlines() if "hashpartitioning(candidate_item#" in x]
    assert not any("cart_categories" in x for x in moves)


def test_category_rates_count_what_a_row_stands_for(spark):
    rows = [("main", 1, 3), ("main", 0, 5), ("side", 0, 2)]
    tallied = spark.createDataFrame(rows, "item_category string, label int, n long")
    every = tallied.select("item_category", "label", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("one")).drop("one")
    both = [sorted(map(str, reports.positive_rate_by_category(x).collect())) for x in (tallied, every)]
    assert both[0] == both[1] and "shown=8, positives=3" in both[0][0]


def test_only_the_named_policy_is_scored(spark, model):
    assert "random" not in plan(eq.one_policy(model, "popularity"))
    assert "REPARTITION_BY_NUM" in plan(eq.one_policy(model, "popularity"))


def test_area_reads_its_rows_once(spark):
    rows = [("a", s, y) for s, y in [(0.5, 1), (0.5, 0), (0.9, 0), (0.1, 1), (0.7, 1), (0.7, 0), (0.2, 0)]] + [("b", 0.3, 1)]
    scored = spark.createDataFrame(rows, "policy string, score double, label int")
    area = evaluate.auc_exact(scored, ["policy"])
    assert "Join" not in plan(area)
    got = {r.policy: r.auc for r in area.collect()}
    pos, neg = ([s for p, s, y in rows if p == "a" and y == label] for label in (1, 0))
    want = sum((x > y) + (x == y) / 2 for x, y in itertools.product(pos, neg)) / len(pos) / len(neg)
    assert got["a"] == pytest.approx(want) and got["b"] is None


def test_carts_of_steps_without_candidates_get_no_vector(spark, model):
    shown = fq.model_inputs(model)
    assert "LeftSemi" in plan(shown)
    steps = cart_queries.steps(model)
    vectors = fq.fixed_vectors(model)
    keys = cart_queries.events(model).join(vectors, F.col("candidate_item") == vectors["item_id"], "left_semi")
    assert shown.count() == keys.count() and steps.count() > 0


def test_a_text_is_cleaned_once_a_row(spark):
    raw = spark.createDataFrame([("₹ 1,020",), ("30-80",), ("-5",), ("free",), (None,), ("x",)], "t string")
    priced = raw.select(cleaning.clean_price(F.col("t")).alias("p"), cleaning.clean_votes(F.col("t")).alias("v"))
    assert plan(priced).count("regexp_extract(") == 2  # one for each column
    assert [r.p for r in priced.collect()] == [1020.0, 30.0, 5.0, None, None, None]
