"""Stored rankers score as fitted ones do."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from basketry.operators import model_store, ranker
from basketry.sources import readers


@pytest.fixture(scope="module")
def rows(spark):
    """Candidates whose label follows the first feature, with noise."""
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    df = spark.range(600).select(F.col("id").alias("session_id"), F.lit(0).alias("step_number"), F.col("id").alias("candidate_item"), *[
        noise(k).alias(f"x{k}") for k in range(3)], F.when(F.col("id") % 5 == 0, "validation").otherwise("train").alias("split"))
    values = F.array("x0", "x1", *[F.lit(0.0)] * (ranker.WIDTH - 2))
    return df.select("session_id", "step_number", "candidate_item", "split", (F.col("x0") + F.col("x2") > 1).cast("int").alias("label"),
                     array_to_vector(values).alias("features")).cache()


def test_versions_score_without_fitting(spark, rows, tmp_path):
    scalers = spark.createDataFrame([("user", "frequency", "log1p_zscore", 1.0, 2.0)], "table_name string, feature string, transform string, p1 double, p2 double")
    for kind, model in (("logistic", ranker.train_ranker(rows)), ("gbt", model_store.train_validated(rows, trees=15, depth=2))):
        path = str(tmp_path / kind)
        model_store.save_version(model, scalers, path, kind)
        stored, kept = model_store.load_version(spark, path)
        score = lambda x: sorted((r.candidate_item, r.score) for r in ranker.score_candidates(x, rows).collect())
        assert score(stored) == score(model) and kept.collect() == scalers.collect()
    assert model_store.train_validated(rows, trees=40, depth=4).getNumTrees < 40  # noise: the validation loss rises early


def test_other_inputs_are_refused(spark, rows, tmp_path, monkeypatch):
    scalers = spark.createDataFrame([("user", "x")], "table_name string, feature string")
    model_store.save_version(ranker.train_ranker(rows), scalers, str(tmp_path / "v"), "logistic")
    monkeypatch.setattr(model_store, "CART_INPUTS", ["other"])
    with pytest.raises(ValueError, match="other inputs"):
        model_store.load_version(spark, str(tmp_path / "v"))


def test_feature_tables_without_their_scaled_columns_are_refused(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "users"))
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_features(spark, str(tmp_path / "users"), "user")
