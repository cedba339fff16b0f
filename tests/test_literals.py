"""Edge cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from basketry.functions import cleaning as c, context, keywords, numeric
from basketry.operators import catalogue, embeddings, evaluate, features, menu, ordering, sampling
from basketry.sources import readers


def apply(spark, build, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


@pytest.mark.parametrize("build, cases", [
    (c.clean_city, {" bombay,": "Mumbai", "BLR": "Bangalore", "chef's town": "Chef'S Town", None: "Unknown"}),
    (c.clean_cuisine, {"Fastfood, Pizza": "Fast Food", "tex-mex": "Tex-Mex", None: "Other"}),
    (c.clean_rating, {"4.25/5": 4.25, "NEW": None, "7.1": None, "--": None}),
    (c.clean_votes, {"1,234": 1234, "2.5K": 2500, "1M": 1000000, "new": 0, "9" * 25: 0, None: 0}),
    (c.clean_price, {"₹ 1,299": 1299.0, "150-200": 150.0, "free": None, "-5": 5.0, "100000000000000000": 1e17, "12345678901234567890": 12345678901234567890.0}),
    (c.clean_item_name, {'  "Masala   Dosa." ': "masala dosa", None: ""}),
    (c.clean_bestseller, {"MUST TRY": 1, "1": 1, "x": 0, None: 0}),
    (keywords.cuisine_fallback, {"Cafe": "beverage", "Royal North Indian": "main", "Nordic": None, None: None}),
    (context.cuisine_group, {"Thai Street": "chinese", "Nordic": "indian", "Ice Cream": "dessert"}),
])
def test_cleaning(spark, build, cases):
    assert apply(spark, build, list(cases)) == list(cases.values())


def test_categories(spark):
    rows = [
        ("chocolate shake", None, "beverage", -1), ("garlic naan", None, "side", -1), ("chicken biryani", None, "main", 0),
        ("gulab jamun", None, "dessert", -1), ("xyz", "Cafe", "beverage", -1), ("xyz", None, "main", -1), ("", None, "main", -1),
        ("paneer tikka", None, "side", 0), ("veg roll", None, "side", 1), ("steakhouse", None, "main", -1), ("théa", None, "main", -1),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, item_name string, cuisine string")
    got = keywords.with_categories(df).orderBy("i").collect()
    assert [(r["item_category"], r["veg_flag"]) for r in got] == [r[2:] for r in rows]
    assert [r["category_confidence"] for r in got][4:7] == [0.5, 0.4, 0.3]


def test_keywords_from_a_table(spark):
    table = spark.createDataFrame([("beverage", "Kombucha")], "class string, keyword string")
    df = spark.createDataFrame([("kombucha", None)], "item_name string, cuisine string")
    assert keywords.with_categories(df, table=table).first()["item_category"] == "beverage"


def test_keyword_matching_is_whole_word_leftmost_and_longest(spark):
    table = spark.createDataFrame(
        [("side", "Garlic Naan"), ("side", "naan"), ("side", "garlic"), ("main", "naan curry rice"), ("main", "curry"), ("main", "curry rice plate"),
         ("main", "7-up"), ("veg", "sandwich"), ("veg", "a"), ("veg", ".x")], "class string, keyword string")
    rows = [(1, "Garlic naan, naan & NAANS"), (2, "garlic  naan"), (3, "naan curry rice plate"), (4, "un7-up 7-up é7-up"), (5, "Sandwiches a_b a"),
            (6, None), (7, ""), (8, "!!"), (9, "garlic naan" * 3), (1_000, " ".join(["garlic naan curry"] * 20_000))]
    got = keywords.keyword_matches(spark.createDataFrame(rows, "id long, text string"), table, ["id"]).collect()
    found = {r.id: {c: r[c] for c in keywords.CLASSES if r[c]} for r in got}
    assert found == {
        1: {"side": ["garlic naan", "naan", "naans"]}, 2: {"side": ["garlic", "naan"]}, 3: {"side": ["naan"], "main": ["naan curry rice"]},
        4: {"main": ["7-up"]}, 5: {"veg": ["a", "sandwiches"]}, 6: {}, 7: {}, 8: {}, 9: {"side": ["garlic", "naan"]},
        1_000: {"side": ["garlic naan"], "main": ["curry"]}}


def test_a_table_of_many_keywords(spark):
    """No bound on the number of words: they are the rows of a join."""
    table = spark.range(50_000).select(F.lit("main").alias("class"), F.concat(F.lit("dish"), "id").alias("keyword"))
    df = spark.createDataFrame([(1, "dish7 and dish49999s and dish50000")], "id long, text string")
    assert keywords.keyword_matches(df, table, ["id"]).first()["main"] == ["dish49999s", "dish7"]


def test_smoothed_rating(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 5.0, 50), ("c", None, 10)], "restaurant_id string, delivery_rating double, delivery_votes long")
    got = {r[0]: r[3] for r in menu.smoothed_rating(df, global_mean=4.0).collect()}
    assert got == {"a": 4.0, "b": 4.5, "c": 4.0}


def test_cart_flags(spark):
    df = spark.createDataFrame([([],), (["main", "side"],), (["main"],)], "cart_categories array<string>").withColumns(
        {"cart_items": F.transform("cart_categories", lambda x: F.lit(1)), "cart_total": F.lit(0.0)})
    got = features.cart_features_scaled(df).select(
        "cart_total_scaled", "cart_size_scaled", "avg_price_scaled", "missing_beverage", "missing_dessert", "heavy_meal").collect()
    assert tuple(got[0]) == (0.0, 0.0, 0.0, 1, 1, 0)
    assert [r["heavy_meal"] for r in got] == [0, 1, 0]


def ranked(spark, labels):
    return spark.createDataFrame([("p", 1, 1, i, l, i + 1) for i, l in enumerate(labels)],
                                 "policy string, session_id int, step_number int, candidate_item int, label int, rank long")


def test_ranking_metrics(spark):
    row = evaluate.step_metrics(ranked(spark, [0, 1, 0, 0, 0, 0]), [5]).first()
    assert (row["precision_5"], row["recall_5"], row["mrr"]) == (0.2, 1.0, 0.5)
    assert math.isclose(row["ndcg_5"], 1 / math.log2(3))
    row = evaluate.step_metrics(ranked(spark, [0, 0]), [5]).first()
    assert (row["precision_5"], row["recall_5"], row["ndcg_5"], row["mrr"]) == (0.0, 0.0, 0.0, 0.0)


def test_auc(spark):
    def auc(rows):
        return evaluate.auc_exact(spark.createDataFrame(rows, "score double, label int")).first()["auc"]

    assert auc([(0.5, 1), (0.5, 0), (0.5, 0)]) == 0.5
    assert auc([(0.9, 1), (0.1, 0)]) == 1.0
    assert auc([(0.9, 1)]) is None


def test_keys_are_shared_by_both_tables(spark):
    raw = spark.createDataFrame(
        [(" Spice ", "4.1", None, "12", None, "thai", "x", "Bengaluru", "Pad Thai", "Popular", "3", "₹200"),
         ("Spice", None, "4", "7", None, "thai", " x", "blr", "pad  thai", None, "9", "200.00")],
        "restaurant_name string, dining_rating string, delivery_rating string, dining_votes string, delivery_votes string, "
        "cuisine string, place string, city string, item_name string, best_seller string, item_votes string, price string")
    rows = catalogue.clean_rows(raw)
    merchants = catalogue.restaurants(rows)
    assert merchants.count() == 1 and merchants.first()["dining_votes"] == 12
    items = catalogue.menu_items(rows, merchants).collect()
    assert len(items) == 1 and items[0]["item_votes"] == 9 and items[0]["price"] == 200.0


def test_large_values_are_kept(spark):
    df = spark.createDataFrame([(1e13,), (-1e13,), (2.5e300,), (1.2345675,), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(numeric.fixed(F.col("x"))).collect()]
    assert got[:4] == [1e13, -1e13, 2.5e300, 1.234568] and math.isnan(got[4]) and got[5] is None
    price = df.limit(1).select(F.lit(1e17).alias("p"))
    assert price.select(c.item_key(F.lit("r"), F.lit("n"), F.col("p")), numeric.money(F.col("p"))).first()[1] == 10**17
    assert price.agg(numeric.exact_mean(F.col("p"))).first()[0] == 1e17


def test_text_index_uses_many_buckets(spark):
    ids = spark.createDataFrame([(f"ITEM_{i * 7919 % 4096:03X}{i:06X}",) for i in range(600)], "item_id string")
    assert ids.select(F.substring("item_id", 1, 8)).distinct().count() > 500
    got = {r.item_id: r.idx for r in ordering.dense_index(ids, "item_id").collect()}
    assert got == {x: k for k, x in enumerate(sorted(got))}


def test_similar_items_has_no_query_limit(spark):
    rows = [(i, [math.cos(i), math.sin(i)] + [0.0] * 62) for i in range(60)]
    vectors = spark.createDataFrame(rows, "item_id long, vector array<double>")
    keys = vectors.select("item_id")
    blocks = embeddings.similar_items(vectors, keys, 3, block=7).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, embeddings.similar_items(vectors, keys, 3).collect()))
    assert len(blocks) == 180


def test_csv_with_line_breaks_and_corrupt_rows(spark, tmp_path):
    (tmp_path / "menu.csv").write_text('item_name,price\n"masala\ndosa",80\n"a ""b""",5\nx,1,2\n')
    raw = readers.read_raw_csv(spark, str(tmp_path / "menu.csv")).cache()
    assert [r.item_name for r in raw.collect()][:2] == ["masala\ndosa", 'a "b"']
    assert tuple(readers.corrupt_rows(raw).first()) == (3, 1)


def test_union_of_event_tables(spark):
    one = spark.createDataFrame([(1, 0, 5, 1)], "session_id long, step_number int, candidate_item long, label int")
    two = spark.createDataFrame([(1, 0, 6, 0, "x"), (1, 0, 5, 0, "y")],
                                "session_id long, step_number int, candidate_item long, label int, meal_type string")
    both = sampling.union_events(one, two)
    assert sorted((r.candidate_item, r.label, r.meal_type) for r in both.collect()) == [(5, 0, "y"), (5, 1, None), (6, 0, "x")]
    assert [tuple(r) for r in sampling.repeated_events(both).collect()] == [(1, 0, 5, 2)]
