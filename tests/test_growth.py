"""Plans and results of the steps that must not grow faster than their input."""

import io
import re
from contextlib import contextmanager, redirect_stdout

import pytest
from pyspark.sql import functions as F

from basketry.functions.hashing import digest, hash28, pairwise_uniform, race_key
from basketry.operators import affinity, sampling
from basketry.operators.menu import cap_menu


@contextmanager
def no_size_checks(spark):
    """Only hinted tables are broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def small_menu(spark):
    rows = [(i, f"r{i % 2}", 10.0 * i, "main" if i % 3 else "beverage", i * 7 % 11, i % 2) for i in range(40)]
    rows += [(4, "r0", 40.0, "main", 6, 0), (None, "r0", None, "side", 3, 1)]  # twice, and without an id
    return spark.createDataFrame(rows, "item_id long, restaurant_id string, price double, item_category string, item_votes long, best_seller long")


@pytest.fixture(scope="module")
def some_steps(spark):
    rows = [(s, s % 4, s % 40, f"r{s % 40 % 2}", [(s * 3 + j) % 40 for j in range(s % 30)]) for s in range(200)]
    rows += [(900, 0, 3, "unlisted", []), (901, 1, 4, "r0", list(range(40)))]
    steps = spark.createDataFrame(rows, "session_id long, step_number int, item_id long, restaurant_id string, cart_items array<long>")
    return steps.withColumns({
        "cart_categories": F.transform("cart_items", lambda x: F.when(x % 3 == 0, "beverage").otherwise("main")),
        "cart_total": F.size("cart_items") * 10.0, "user_type": F.lit("premium"), "meal_type": F.lit("lunch"),
        "avg_order_value": F.lit(250.0)})


def test_negatives_win_the_race_and_steps_stay_in_place(spark, small_menu, some_steps):
    with no_size_checks(spark):
        got = sampling.with_negatives(some_steps, small_menu, n=5, cap=15)
        assert "hashpartitioning(restaurant_id" not in plan(got)
        got = {r.session_id: r.negatives for r in got.collect()}
    md5 = digest(F.col("item_id"), seed=0)
    pool = cap_menu(small_menu, 15).select("restaurant_id", F.col("item_id").alias("other"), "item_votes",
                                           (hash28(md5, 1) + 1).alias("m"), hash28(md5, 8).alias("o"))
    key = hash28(digest(F.col("session_id"), F.col("step_number"), seed=0))
    pairs = some_steps.withColumn("k", key).join(pool, "restaurant_id").where("other != item_id and not array_contains(cart_items, other)")
    raced = pairs.select("session_id", race_key(pairwise_uniform(F.col("m"), F.col("o"), F.col("k")), F.log1p(F.col("item_votes") + 1.0)).alias("key"), "other")
    want = {s: [] for s in got}
    for r in sorted(raced.collect(), key=lambda r: (r.session_id, r.key, r.other)):
        want[r.session_id] += [r.other]
    assert got == {s: x[:5] for s, x in want.items()}


def test_affinity_of_a_menu_comes_from_packed_pools(spark, small_menu, some_steps):
    with no_size_checks(spark):
        scored = affinity.next_item_affinity(some_steps, small_menu, cap=15)
        assert "hashpartitioning(restaurant_id" not in plan(scored)
        rows = scored.collect()
    assert len(rows) == 201 and all(len(r.affinity) == 15 for r in rows)
    for r in rows:
        assert r.affinity_total == pytest.approx(sum(x.weight for x in r.affinity))
        assert all((x.weight == 0) == (x.item_id in r.cart_items) for x in r.affinity)


def test_free_items_need_no_menu_per_step(spark, small_menu):
    from basketry.operators import menu, sequences

    adds = spark.createDataFrame([(1, 0, 2, "r0"), (1, 1, 4, "r0"), (1, 2, 6, "r0"), (1, 3, 5, "r1"), (2, 0, 8, "r0"), (2, 1, 9, "r1")],
                                 "session_id long, step_number long, item_id long, restaurant_id string")
    homes = small_menu.groupBy("item_id").agg(F.collect_set("restaurant_id").alias("homes"))
    state = sequences.step_state(adds.join(homes, "item_id").withColumns({"item_category": F.lit("main"), "price": F.lit(1.0)}), extra=["homes"])
    got = {(r.session_id, r.step_number): (r.free_items, r.free_id_sum) for r in menu.free_items(state, small_menu).collect()}
    even, odd = set(range(0, 40, 2)), set(range(1, 40, 2))
    want = {(1, 0): even, (1, 1): even - {2}, (1, 2): even - {2, 4}, (1, 3): odd, (2, 0): even, (2, 1): odd}
    assert got == {k: (len(v), sum(v)) for k, v in want.items()}


def test_requests_are_scored_where_their_carts_are(spark):
    from basketry.operators.recommend import cooc_scores

    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25), ("b", "c", 0.25)], "src string, dst string, prob double")
    carts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z"), (4, None)], "request_id long, item_id string")
    with no_size_checks(spark):
        scores = cooc_scores(carts, edges)
        assert "hashpartitioning(request_id#" in plan(scores) and "_candidate#" not in "".join(
            line for line in plan(scores).splitlines() if "Exchange hashpartitioning" in line)
        got = {(r.request_id, r.item_id): r.score for r in scores.collect()}
    assert got == {(1, "c"): 0.5, (2, "b"): 0.5, (2, "c"): 0.25}


def test_only_accepted_items_move_to_their_price(spark):
    from basketry.operators import policy

    scored = spark.createDataFrame([("p", 1, 0, 7, 1, 0.9), ("p", 1, 0, 8, 0, 0.1), ("p", 2, 0, 7, 1, 0.1), ("p", 2, 0, 8, 0, 0.9), ("p", 3, 0, 9, 1, 0.5)],
                                   "policy string, session_id long, step_number int, candidate_item long, label int, score double")
    prices = spark.createDataFrame([(7, 2.5), (8, 4.0), (7, 2.5)], "item_id long, price double")  # an item listed twice counts twice
    with no_size_checks(spark):
        accepted = policy.accepted_addons(scored, prices, 1)
        assert "collect_list" in plan(accepted)  # what is accepted, before the prices
        got = {r.session_id: (r.accepted, r.value, r.first_position) for r in accepted.collect()}
    assert got[1] == (2, 5.0, 1) and got[2] == (0, 0.0, -1)
    assert got[3][0] == 1 and got[3][2] == 1


def test_a_step_is_ranked_in_the_task_of_its_session(spark, model):
    from basketry.operators.evaluate import rank_labels
    from basketry.plans.evaluation_queries import one_policy

    with no_size_checks(spark):
        moves = [x for x in plan(rank_labels(one_policy(model, "popularity"))).splitlines() if "Exchange hashpartitioning" in x]
    assert moves and not any("candidate_item#" in x or "policy#" in x or "step_number#" in x for x in moves)


def test_sorts_by_session_are_bounded_by_order_lines(spark, model, monkeypatch):
    """Lines move once to their session, in as many tasks as their number asks for, before carts are built and items ranked."""
    from basketry.operators.evaluate import rank_labels
    from basketry.plans import evaluation_queries as eq

    monkeypatch.setattr(eq, "STEPS_PER_TASK", 300)
    tasks = eq.step_tasks(model)
    assert tasks > 10
    with no_size_checks(spark):
        moves = [x for x in plan(rank_labels(eq.one_policy(model, "popularity"))).splitlines() if "Exchange hashpartitioning" in x]
    for key, times in (("l_orderkey", 1), ("session_id", 2)):
        assert len([x for x in moves if re.search(rf"hashpartitioning\({key}#\d+L?, {tasks}\), REPARTITION", x)]) == times
    assert not any("l_orderkey#" in x and "l_partkey#" in x for x in moves)
