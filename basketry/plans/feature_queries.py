"""Queries on features, vectors, training set, ranker and recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry import vocab
from basketry.functions import context, vectors as v
from basketry.operators import (
    cooccurrence as co, embeddings as emb, features as ft, menu, model_store, ordering, ranker, recommend, sampling,
    sequences as seq, vector_index, walks,
)
from basketry.plans.cart_queries import dense_edges, edges, events, line_tasks, steps, typed_adds
from basketry.plans.catalogue_queries import counted, smoothed
from basketry.plans.registry import query
from basketry.session import cut_lineage, scratch_path
from basketry.sources import readers, sinks
from basketry.sources.bindings import CartModel

REFERENCE_DATE = "2001-08-02"


def index(m: CartModel) -> DataFrame:
    """Items that own a vector, with their dense index."""
    return ordering.dense_index(m["b_vectors"].join(m["b_items"], "item_id", "left_semi").select("item_id"), "item_id")


def users(m: CartModel, carts: DataFrame | None = None) -> DataFrame:
    return ft.user_rfm(steps(m) if carts is None else carts, m["b_users"], REFERENCE_DATE)


def merchants(m: CartModel) -> DataFrame:
    return ft.merchant_features(smoothed(m), m["b_items"])


def scalers(m: CartModel, carts: DataFrame | None = None) -> DataFrame:
    return ft.fit_scalers({"user": users(m, carts), "restaurant": merchants(m)})


def scaled(m: CartModel, carts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature tables with ``_norm`` columns. ``carts``: the steps, where they are stored already.

    Features and scalers are stored once: the scalers are fitted on, and applied to, the stored tables.
    """
    user_table = sinks.write_table(users(m, carts), scratch_path(m.spark, "users"))
    merchant_table = sinks.write_table(merchants(m), scratch_path(m.spark, "merchants"))
    fitted = ft.fit_scalers({"user": user_table, "restaurant": merchant_table})
    stored = sinks.write_scalers(fitted, scratch_path(m.spark, "scalers"))
    return ft.apply_scalers(user_table, stored, "user"), ft.apply_scalers(merchant_table, stored, "restaurant")


def item_table(m: CartModel) -> DataFrame:
    return ft.item_features(m["b_items"], index(m))


def training(m: CartModel) -> DataFrame:
    """Only items with a vector are looked up: their index and features are stored, and broadcast while they are few."""
    known = ranker.stored_small(index(m), ranker.BROADCAST_KEYS)
    looked = ft.item_features(m["b_items"], known).join(known.select("item_id"), "item_id", "left_semi")
    return ft.training_set(events(m), steps(m), ranker.stored_small(looked, ranker.BROADCAST_VECTORS), known)


def fixed_vectors(m: CartModel) -> DataFrame:
    return emb.fix_zero_embeddings(m["b_vectors"])


@query("user_rfm")
def _(m):
    return users(m)


@query("merchant_features")
def _(m):
    return merchants(m)


@query("item_features")
def _(m):
    return item_table(m)


@query("fit_scalers")
def _(m):
    return scalers(m)


@query("apply_scalers")
def _(m):
    return scaled(m)[0].select("user_id", *vocab.DEFAULT_USER_VECTOR)


@query("apply_scalers_restaurant")
def _(m):
    return scaled(m)[1].select("restaurant_id", *vocab.DEFAULT_RESTAURANT_VECTOR)


@query("join_features_default")
def _(m):
    """Rare users and restaurants take the default vectors."""
    user_table, merchant_table = scaled(m)
    frequent = user_table.filter(F.col("frequency") >= 8)
    large = merchant_table.filter(F.col("delivery_votes") > 2400)
    joined = ft.join_features_default(steps(m), frequent, large)
    return joined.select("session_id", "step_number", *vocab.DEFAULT_USER_VECTOR, *vocab.DEFAULT_RESTAURANT_VECTOR)


@query("join_item_lookup")
def _(m):
    looked = ft.join_item_lookup(events(m), item_table(m))
    return counted(looked, "candidate_item", "embedding_idx", "category_index")


@query("join_cart_items")
def _(m):
    return ft.join_cart_items(steps(m), m["b_items"])


@query("filter_embedded")
def _(m):
    return counted(ft.filter_embedded(events(m), index(m)), "candidate_item", "label")


@query("cart_features")
def _(m):
    return ft.cart_features(steps(m)).select(
        "session_id", "step_number", "cart_size", "cart_value", "missing_beverage", "missing_dessert", "heavy_meal"
    )


@query("cart_features_scaled")
def _(m):
    return ft.cart_features_scaled(steps(m)).select("session_id", "step_number", *ranker.CART_INPUTS)


@query("training_set")
def _(m):
    return training(m)


@query("class_balance")
def _(m):
    return ft.class_balance(events(m))


@query("alignment_check")
def _(m):
    return emb.alignment_check(training(m), index(m))


@query("category_centroids")
def _(m):
    return emb.category_centroids(m["b_vectors"])


@query("fix_zero_embeddings")
def _(m):
    return fixed_vectors(m)


@query("aligned_embeddings")
def _(m):
    catalogue = ordering.dense_index(m["b_items"].select("item_id"), "item_id")
    return emb.aligned_embeddings(catalogue, m["b_vectors"])


@query("similar_items")
def _(m):
    known = typed_adds(m).join(m["b_vectors"].select("item_id"), "item_id", "left_semi")
    popular = menu.top_items(co.item_counts(known), 5)
    return emb.similar_items(fixed_vectors(m), popular)


@query("similar_items_indexed")
def _(m):
    """Ten nearest items of every twentieth item, from the index."""
    vectors = fixed_vectors(m)
    return vector_index.nearest(vector_index.build_index(vectors), vectors.where("item_id % 20 = 0"))


@query("cart_vector")
def _(m):
    carts = emb.cart_vectors(seq.step_state(typed_adds(m)), fixed_vectors(m))
    return carts.select("session_id", "step_number", "cart_vector")


@query("interaction_features")
def _(m):
    """Dot and absolute difference of cart and added item, the latter summed.

    Steps whose item has no vector leave before carts are looked up; few vectors go to the carts.
    """
    vectors = ranker.stored_small(fixed_vectors(m).select("item_id", "vector"), ranker.BROADCAST_VECTORS)
    known = seq.step_state(typed_adds(m)).join(vectors.select("item_id"), "item_id", "left_semi")
    carts = emb.cart_vectors(known, vectors)
    joined = carts.join(vectors, "item_id")
    columns = emb.interaction_columns(F.col("cart_vector"), F.col("vector"))
    return joined.select(
        "session_id", "step_number", "item_id", columns["interaction_dot"].alias("interaction_dot"),
        F.aggregate(columns["interaction_abs"], F.lit(0.0), lambda a, x: a + x).alias("abs_sum"),
    )


def model_inputs(m: CartModel, shown: DataFrame | None = None, carts: DataFrame | None = None) -> DataFrame:
    user_table, merchant_table = scaled(m, carts)
    shown, carts = events(m) if shown is None else shown, steps(m) if carts is None else carts
    return ranker.ranker_inputs(shown, carts, m["b_items"], user_table, merchant_table, fixed_vectors(m))


@query("assemble_218")
def _(m):
    from pyspark.ml.functions import vector_to_array

    sampled = sampled_steps(m)
    assembled = ranker.assemble(model_inputs(m, sampling.shown_items(sampled), sampled)).withColumn("features", vector_to_array("features"))
    return assembled.select(
        "session_id", "step_number", "candidate_item", "label", F.size("features").alias("width"),
        F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("feature_sum"),
    )


def sampled_steps(m: CartModel) -> DataFrame:
    """Steps with their negatives, stored: events, carts and user features are all read from them."""
    sampled = sampling.with_negatives(steps(m), m["b_items"]).drop("item_category", "price", "city")
    return sinks.write_table(sampled, scratch_path(m.spark, "sampled"))


def split_inputs(m: CartModel, sampled: DataFrame | None = None) -> DataFrame:
    """Assembled rows with their time split, stored once for fitting and scoring.

    The split counts every shown item; only those with a vector move to the split of their session.
    """
    sampled = sampled_steps(m) if sampled is None else sampled
    shown = sampling.shown_items(sampled).drop("cart_items", "cart_categories", "cart_total")
    split = seq.time_split(shown).select("session_id", "split")
    vectors = ranker.stored_small(fixed_vectors(m).select(F.col("item_id").alias("candidate_item")), ranker.BROADCAST_KEYS)
    known = shown.join(vectors, "candidate_item", "left_semi")
    assembled = ranker.assemble(model_inputs(m, known.join(split, "session_id"), sampled))
    return cut_lineage(assembled.select("session_id", "step_number", "candidate_item", "label", "split", "features"))


@query("train_ranker")
def _(m):
    rows = split_inputs(m)
    model = ranker.train_ranker(rows.filter(F.col("split") == "train"))
    scored = ranker.score_candidates(model, rows)
    return ranker.train_eval(scored, ["split"])


@query("train_ranker_validated")
def _(m):
    """Boosted trees that stop by the validation part."""
    rows = split_inputs(m)
    model = model_store.train_validated(rows, trees=20)
    return ranker.train_eval(ranker.score_candidates(model, rows), ["split"])


@query("score_candidates")
def _(m):
    """Scores of a stored version; the fitted model itself is not used any more."""
    sampled = sampled_steps(m)
    rows = split_inputs(m, sampled)
    version = scratch_path(m.spark, "ranker")
    model_store.save_version(ranker.train_ranker(rows.filter(F.col("split") == "train")), scalers(m, sampled), version, "logistic")
    model, _ = model_store.load_version(m.spark, version)
    return ranker.score_candidates(model, rows.filter(F.col("split") == "validation"))


@query("train_eval")
def _(m):
    """Gap heuristic as the score."""
    scored = ft.join_item_lookup(events(m), item_table(m)).withColumn(
        "score",
        F.when(context.lacks(F.col("cart_categories"), "beverage") * (F.col("category_index") == 3).cast("int") == 1, 0.8)
        .otherwise(0.2),
    )
    return ranker.train_eval(scored).withColumn("run", F.lit("heuristic"))


def requests(m: CartModel) -> DataFrame:
    """The last known cart of every session asks for its next item."""
    latest = seq.step_state(typed_adds(m)).withColumn("size", F.size("cart_items"))
    last = latest.groupBy("session_id").agg(
        F.max_by(F.struct("restaurant_id", "cart_items", "cart_categories", "cart_total"), "step_number").alias("_c")
    )
    return last.join(m["b_sessions"], "session_id").select(
        F.col("session_id").alias("request_id"), "user_id", "_c.*", "hour", "user_type",
        context.meal_type(F.col("hour")).alias("meal_type"),
    )


@query("recommend_batch")
def _(m):
    sampled = sampled_steps(m)
    rows = split_inputs(m, sampled)
    model = ranker.train_ranker(rows.filter(F.col("split") == "train"))
    user_table, merchant_table = scaled(m, sampled)
    asked = cut_lineage(requests(m))

    def score(candidates: DataFrame) -> DataFrame:
        keyed = candidates.select(
            F.col("request_id").alias("session_id"), F.lit(0).alias("step_number"), "user_id", "restaurant_id",
            F.col("item_id").alias("candidate_item"), "hour", "meal_type", "user_type",
        )
        carts = asked.withColumnRenamed("request_id", "session_id").withColumn("step_number", F.lit(0))
        inputs = ranker.ranker_inputs(keyed, carts, m["b_items"], user_table, merchant_table, fixed_vectors(m))
        scored = ranker.score_candidates(model, ranker.assemble(inputs))
        return scored.select(F.col("session_id").alias("request_id"), F.col("candidate_item").alias("item_id"), "score")

    return recommend.recommend_batch(asked, m["b_items"], m["b_vectors"].select("item_id"), score)


@query("recommend_cooc")
def recommend_cooc(m):
    # read once: graph and carts come from the stored adds
    adds = typed_adds(m).select("session_id", "step_number", "item_name")
    adds = sinks.write_table(adds, scratch_path(m.spark, "adds"))
    carts = adds.select(F.col("session_id").alias("request_id"), F.col("item_name").alias("item_id"))
    carts = carts.repartition(line_tasks(m), "request_id").distinct()
    return recommend.recommend_cooc(carts, cut_lineage(dense_edges(m, adds)), dealt=True)


@query("recommend_topk")
def _(m):
    carts = m["b_adds"].select(F.col("session_id").alias("request_id"), "item_id")
    return recommend.recommend_cooc(carts, cut_lineage(edges(m)), m["b_items"])


@query("gap_heuristic_score")
def _(m):
    # like rows are counted before they move to their item
    shown = events(m).select("candidate_item", "label", context.lacks(F.col("cart_categories"), "beverage").alias("_lacks"))
    tallied = counted(shown, "candidate_item", "label", "_lacks")
    scored = ft.join_item_lookup(tallied, item_table(m)).withColumn(
        "score", F.col("_lacks") * (F.col("category_index") == 3).cast("int")
    )
    return scored.groupBy("candidate_item", "label", "score").agg(F.sum("n").alias("n"))


def walk_graph(m: CartModel) -> DataFrame:
    return co.symmetrize_edges(dense_edges(m))


@query("random_walk_first_step")
def _(m):
    slots = walks.transition_slots(walk_graph(m), F.substring("dst", 1, 1))
    return walks.draw(walks.start_walkers(slots, 10), slots, 1, 42, F.lit(0)).select(
        "walk_id", F.col("cur").alias("src"), "dst"
    )


@query("random_walks")
def _(m):
    return walks.random_walks(walk_graph(m))


@query("random_walks_biased")
def _(m):
    return walks.random_walks(walk_graph(m), walks_per_node=4, length=10, p=0.5, q=2.0)


@query("join_prev_neighbors")
def _(m):
    """Hops of a walk, with whether the next node is a neighbour of the previous one."""
    graph = walk_graph(m)
    paths = walks.random_walks(graph, walks_per_node=2, length=6)
    hops = paths.select("walk_id", "path", F.explode(F.sequence(F.lit(3), F.size("path"))).alias("i")).select(
        "walk_id", "i", *[F.element_at("path", F.col("i") - d).alias(n) for d, n in ((2, "prev"), (1, "cur"), (0, "next"))]
    )
    near = graph.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(1).alias("near"))
    return hops.join(near, ["prev", "next"], "left").withColumn("near", F.coalesce("near", F.lit(0)))


@query("item_embeddings")
def _(m):
    graph = walk_graph(m)
    nodes = graph.select("src").distinct().count()
    return walks.item_embeddings(walks.random_walks(graph), nodes, partitions=1)


# ---- Sources and sinks: written to scratch storage, read back ---------------------------------


@query("read_parquet")
def _(m):
    table = readers.read_table(m.spark, f"{m.sf_dir}/part.parquet", require=["p_partkey", "p_retailprice"])
    return table.select("p_partkey", "p_brand", "p_retailprice")


@query("read_raw_csv")
def _(m):
    path = scratch_path(m.spark, "raw")
    sinks.write_table(m["b_raw_menu"], path, "csv")
    return counted(readers.read_raw_csv(m.spark, path), "restaurant_name", "city", "item_name", "price")


@query("normalize_headers")
def _(m):
    raw = m["b_raw_menu"].select(
        F.col("restaurant_name").alias(" Restaurant Name"), F.col("cuisine").alias("Cuisine "),
        F.col("place").alias("PLACE NAME"), F.lit(None).cast("string").alias("Place"), F.col("city").alias("City Name"),
        F.col("item_name").alias("Item Name"), F.col("price").alias("Prices"), F.lit("x").alias("Notes"),
    )
    return counted(readers.normalize_headers(raw), *readers.RAW_COLUMNS)


@query("write_tables")
def _(m):
    stored = sinks.write_table(m["b_items"], scratch_path(m.spark, "items"), "csv")
    return stored


@query("write_training_set")
def _(m):
    return sinks.write_training_set(training(m), scratch_path(m.spark, "training"))


@query("write_events")
def _(m):
    # steps move to their period before their items are drawn
    stored = sinks.write_events(steps(m), scratch_path(m.spark, "events"), "month", tasks=line_tasks(m),
                                show=lambda dealt: sampling.cart_events(dealt, m["b_items"]))
    return counted(stored.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd")), "event_date", "label")


@query("write_edges")
def _(m):
    return sinks.write_edges(dense_edges(m), scratch_path(m.spark, "edges")).drop("bucket")


@query("write_embeddings")
def _(m):
    vectors = emb.aligned_embeddings(index(m), m["b_vectors"])
    return sinks.write_embeddings(vectors, scratch_path(m.spark, "vectors"))


@query("write_scalers")
def _(m):
    return sinks.write_scalers(scalers(m), scratch_path(m.spark, "scalers"))
