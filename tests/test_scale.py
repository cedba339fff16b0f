"""Properties, brute-force checks and skewed inputs."""

import itertools
import random
import statistics

from pyspark.sql import functions as F

from basketry.functions.numeric import order_bucket
from basketry.operators import cooccurrence as co, evaluate, features, menu, ordering, ranker, sampling, sequences as seq, walks
from basketry.plans import feature_queries as fq
from basketry.plans.cart_queries import dense_edges, events, steps


def test_running_totals_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randint(-50, 1000) / 4, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = {r["id"]: r["rank"] for r in ordering.ranked(df, ["g"], F.col("v"), [F.col("id")]).collect()}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[1], r[2])), key=lambda r: r[0]):
        for position, row in enumerate(group, 1):
            assert got[row[2]] == position


def test_order_bucket_is_monotone(spark):
    values = sorted([-1e9, -3.5, -0.001, 0.0, 0.001, 1.0, 1.0001, 2.0, 999.9, 1e12])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[0] for r in df.orderBy("v").select(order_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_quantiles_equal_brute_force(spark):
    values = [random.Random(2).choice([0.0, 1.5, 2.0, 7.25, 900.0]) * i % 101 for i in range(501)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = ordering.quantiles(df, "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}).first()
    expected = statistics.quantiles(values, n=4, method="inclusive")
    assert [round(x, 9) for x in row] == [round(x, 9) for x in expected]


def test_dense_index_of_text_keys(spark):
    keys = [f"ITEM_{i * 7919 % 1000:04d}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "item_id string")
    got = {r[0]: r[1] for r in ordering.dense_index(df, "item_id", F.substring("item_id", 1, 7)).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_pairs_of_a_session_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(co, "STEP_BLOCK", 4)
    rng = random.Random(3)
    carts = {s: [rng.randint(0, 12) for _ in range(n)] for s, n in ((1, 23), (2, 3), (3, 1))}
    rows = [(s, i, item) for s, items in carts.items() for i, item in enumerate(items)]
    df = spark.createDataFrame(rows, "session_id long, step_number long, item_id long")
    expected = {}
    for items in carts.values():
        for a, b in itertools.combinations(items, 2):
            if a != b:
                expected[a, b] = expected.get((a, b), 0) + 1
    assert {(r[0], r[1]): r[2] for r in co.pair_counts(df).collect()} == expected


def test_keep_best_of_many_copies(spark):
    from basketry.operators.catalogue import keep_best

    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 37 % 5000).alias("v"))
    assert keep_best(df, "k", ["v"]).filter("k = 0").first()["v"] == df.filter("k = 0").agg(F.max("v")).first()[0]


def test_negatives_are_valid_and_repeatable(model):
    sampled = sampling.with_negatives(steps(model), model["b_items"])
    wrong = sampled.filter(F.array_contains("negatives", F.col("item_id")) | (F.size(F.array_intersect("negatives", "cart_items")) > 0)
                           | (F.size("negatives") > 5) | (F.size(F.array_distinct("negatives")) < F.size("negatives")))
    assert wrong.count() == 0
    again = sampling.with_negatives(steps(model).repartition(7), model["b_items"])
    total = F.sum(F.xxhash64("session_id", "step_number", "negatives") % 1000003)
    assert sampled.agg(total).first() == again.agg(total).first()


def test_negatives_follow_the_weights(spark):
    items = spark.createDataFrame([(i, "r", 0 if i < 5 else 10**6, 0) for i in range(10)],
                                  "item_id long, restaurant_id string, item_votes long, best_seller long")
    adds = spark.range(4000).select(F.col("id").alias("session_id"), F.lit(0).alias("step_number"), F.lit("r").alias("restaurant_id"),
                                    F.lit(99).cast("long").alias("item_id"), F.array().cast("array<bigint>").alias("cart_items"))
    drawn = sampling.with_negatives(adds, items, n=1).select(F.explode("negatives").alias("i"))
    popular = drawn.filter("i >= 5").count() / drawn.count()
    expected = 13.8155 / (13.8155 + 0.6931 * 1.585)
    assert abs(popular - expected) < 0.03


def test_affinity_sums_to_one(model):
    from basketry.operators.affinity import first_item_affinity

    sums = first_item_affinity(steps(model), model["b_items"]).groupBy("restaurant_id", "user_type", "meal_type").agg(F.sum("probability").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_time_split_keeps_sessions_whole(model):
    split = seq.time_split(events(model))
    assert split.groupBy("session_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    share = split.filter("split = 'train'").agg(F.sum("rows")).first()[0] / split.agg(F.sum("rows")).first()[0]
    assert 0.89 < share <= 0.9


def test_random_order_matches_closed_form(model):
    scored = events(model).withColumn("policy", F.lit("random")).withColumn("score", evaluate.random_score())
    six = evaluate.rank_labels(scored)
    full = six.groupBy("session_id", "step_number").count().filter("count = 6").select("session_id", "step_number")
    row = evaluate.step_metrics(six.join(full, ["session_id", "step_number"]), [5]).agg(
        F.avg("precision_5"), F.avg("acceptance_5"), F.avg("mrr"), F.avg("ndcg_5")).first()
    for got, expected in zip(row, (1 / 6, 5 / 6, 0.4083, 0.4914)):
        assert abs(got - expected) < 0.02


def test_walk_hops_are_edges(model):
    graph = co.symmetrize_edges(dense_edges(model))
    for p, q in ((1.0, 1.0), (0.25, 4.0)):
        paths = walks.random_walks(graph, walks_per_node=2, length=5, p=p, q=q)
        assert paths.filter(F.size("path") != 5).count() == 0
        assert paths.count() == 2 * graph.select("src").distinct().count()
        hops = paths.select(F.explode(F.arrays_zip(F.slice("path", 1, 4).alias("a"), F.slice("path", 2, 4).alias("b"))).alias("h"))
        hops = hops.select(F.col("h.a").alias("src"), F.col("h.b").alias("dst"))
        assert hops.join(graph, ["src", "dst"], "left_anti").count() == 0


def test_rejection_fallback_is_used_and_valid(model):
    graph = co.symmetrize_edges(dense_edges(model))
    slots = walks.transition_slots(graph)
    start = walks.start_walkers(slots, 1).withColumn("path", F.array("cur"))
    first = walks._advance(walks.draw(start, slots, 1, 5, F.lit(0)))
    moved = walks.biased_step(first, slots, graph, 2, 0.001, 1000.0, 5, trials=1)
    assert moved.count() == first.count()
    assert moved.filter(F.element_at("path", 1) == F.element_at("path", 3)).count() > 0.9 * first.count()


def test_assembled_width(model):
    assert ranker.WIDTH == 218
    assembled = ranker.assemble(fq.model_inputs(model)).limit(1).collect()
    assert assembled[0]["features"].size == 218


def test_ranker_kinds_learn_a_signal(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(600).select(
        F.col("id").alias("session_id"), F.lit(0).alias("step_number"), F.col("id").alias("candidate_item"),
        (F.col("id") % 6 == 0).cast("int").alias("label"),
        array_to_vector(F.array(*[((F.col("id") % 6 == 0).cast("double") + i / 500) for i in range(218)])).alias("features"))
    for kind in ("logistic", "gbt"):
        scored = ranker.score_candidates(ranker.train_ranker(rows, kind), rows)
        assert evaluate.auc_exact(scored).first()["auc"] > 0.95


def test_default_vectors(spark):
    from basketry import vocab

    users = spark.range(1).select(F.lit("u").alias("user_id"), *[F.lit(9.0).alias(c) for c in vocab.DEFAULT_USER_VECTOR])
    shops = spark.range(1).select(F.lit("r").alias("restaurant_id"), *[F.lit(9.0).alias(c) for c in vocab.DEFAULT_RESTAURANT_VECTOR])
    rows = spark.createDataFrame([("u", "x"), ("y", "r")], "user_id string, restaurant_id string")
    got = {r["user_id"]: r for r in features.join_features_default(rows, users, shops).collect()}
    assert got["u"]["recency_days_norm"] == 9.0 and got["u"]["smoothed_rating_norm"] == 0.25
    assert got["y"]["cuisine_entropy_norm"] == 0.5 and got["y"]["menu_size_norm"] == 9.0


def test_stream_equals_batch(model):
    from basketry.streaming import jobs

    stream = jobs.stream_table(model.spark, model.sf_dir, "lineitem")
    streamed = jobs.run_to_table(jobs.enrich(stream, model), "test-enriched")
    batch = jobs.enrich(model["lineitem"], model)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_popularity_pool_fills_up_despite_a_large_cart(spark):
    items = spark.range(40).select(F.col("id").alias("item_id"), F.lit("r").alias("restaurant_id"), (100 - F.col("id")).alias("item_votes"))
    requests = spark.createDataFrame([(1, "r", list(range(25))), (2, "r", [])], "request_id int, restaurant_id string, cart_items array<bigint>")
    pool = menu.popularity_pool(requests, items, 10)
    assert [r["item_id"] for r in pool.filter("request_id = 1").orderBy("pool_rank").collect()] == list(range(25, 35))
    assert pool.filter("request_id = 2").count() == 10
