"""Add-to-cart ranker on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from basketry import vocab
from basketry.functions import context
from basketry.functions.hashing import uniform
from basketry.operators.embeddings import cart_vectors, interaction_columns
from basketry.operators.evaluate import score_quality
from basketry.operators.features import cart_features_scaled, class_balance, join_features_default
from basketry.session import cut_lineage

CART_INPUTS = [
    "cart_total_scaled", "cart_size_scaled", "avg_price_scaled", "missing_beverage", "missing_dessert", "heavy_meal",
]
CONTEXT_INPUTS = ["hour_norm", "meal_type_idx", "user_type_idx", "is_main", "is_dessert", "is_beverage", "is_side"]
VECTOR_INPUTS = ["cart_vector", "candidate_vector", "interaction_abs"]
BROADCAST_VECTORS = 1 << 17  # vectors of some 512 bytes that every task may hold
BROADCAST_KEYS = 1 << 20  # rows of two or three numbers that every task may hold
WIDTH = 3 * vocab.EMBEDDING_DIM + 1 + len(vocab.DEFAULT_USER_VECTOR) + len(vocab.DEFAULT_RESTAURANT_VECTOR) + 13


def stored_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` computed once, marked for broadcast while it has no more than ``rows``."""
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= rows else stored


def ranker_inputs(
    events: DataFrame, steps: DataFrame, items: DataFrame, users: DataFrame, merchants: DataFrame, vectors: DataFrame
) -> DataFrame:
    """Named model inputs per (step, candidate). Candidates without a vector drop out.

    Cart vectors and cart features are computed once per step that has a candidate left, and joined to its candidates.
    """
    # wide vectors come last: rows move to users and carts while they are narrow
    vectors = stored_small(vectors.select("item_id", "vector"), BROADCAST_VECTORS)
    merchants = stored_small(merchants.select("restaurant_id", *vocab.DEFAULT_RESTAURANT_VECTOR), BROADCAST_VECTORS)
    candidates = vectors.select(F.col("item_id").alias("candidate_item"), F.col("vector").alias("candidate_vector"))
    categories = items.select(F.col("item_id").alias("candidate_item"), "item_category")
    known = cut_lineage(events.join(candidates.select("candidate_item"), "candidate_item", "left_semi"))
    keys = known.select("session_id", "step_number").distinct()
    keys = F.broadcast(keys) if known.count() <= BROADCAST_KEYS else keys  # steps without a candidate leave where they are
    kept = steps.join(keys, ["session_id", "step_number"], "left_semi")
    carts = cart_vectors(cart_features_scaled(kept), vectors).select(
        "session_id", "step_number", "cart_vector", *CART_INPUTS
    )
    joined = join_features_default(known.join(categories, "candidate_item", "left"), users, merchants)
    joined = joined.join(carts, ["session_id", "step_number"]).join(candidates, "candidate_item")
    encoded = context.context_columns(F.col("hour"), F.col("meal_type"), F.col("user_type"), F.col("item_category"))
    return joined.withColumns(
        {**encoded, **interaction_columns(F.col("cart_vector"), F.col("candidate_vector"))}
    )


def assemble(inputs: DataFrame) -> DataFrame:
    """One dense feature vector of 218 values."""
    columns = ["cart_vector", "candidate_vector", "interaction_dot", "interaction_abs",
               *vocab.DEFAULT_USER_VECTOR, *vocab.DEFAULT_RESTAURANT_VECTOR, *CART_INPUTS, *CONTEXT_INPUTS]
    as_vectors = inputs.withColumns({c: array_to_vector(F.col(c)) for c in VECTOR_INPUTS})
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(as_vectors)
    return assembled.drop(*[c for c in columns if c in inputs.columns])


def train_ranker(training: DataFrame, kind: str = "logistic", seed: int = 42):
    """Class-balanced binary ranker; ``training`` holds features and label."""
    balance = class_balance(training).first()
    if not balance["positives"] or not balance["negatives"]:
        raise ValueError("training needs both classes")
    ratio = float(balance["pos_weight"])
    labelled = training.withColumn("label", F.col("label").cast("double"))
    weighted = labelled.withColumn("weight", F.when(F.col("label") == 1, ratio).otherwise(1.0))
    if kind == "logistic":
        learner = LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-4)
        return learner.fit(weighted)
    if kind == "gbt":
        return GBTClassifier(weightCol="weight", maxIter=30, maxDepth=5, subsamplingRate=0.8, seed=seed).fit(weighted)
    if kind == "mlp":
        # No weight column: positives are repeated, the fractional copy decided by their key.
        key = uniform(F.col("session_id"), F.col("step_number"), F.col("candidate_item"), seed=seed)
        copies = F.when(F.col("label") == 1, F.floor(F.lit(ratio) + key)).otherwise(1).cast("int")
        repeated = labelled.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))))
        layers = [WIDTH, 256, 128, 2]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=60, blockSize=256, seed=seed).fit(repeated)
    raise ValueError(f"unknown ranker {kind}")


def score_candidates(model, assembled: DataFrame) -> DataFrame:
    """Probability of being added."""
    scored = model.transform(assembled).withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def train_eval(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Loss, ROC-AUC and PR-AUC, per group (such as the split) in one pass."""
    return score_quality(scored, group)
