"""Offline ranking metrics and exact area measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from basketry.functions.hashing import uniform
from basketry.functions.numeric import order_bucket, share
from basketry.operators.ordering import running

KS = (1, 3, 5, 8)
STEP = ["policy", "session_id", "step_number"]


def random_score(seed: int = 42) -> Column:
    """Shuffled order that is the same on every run."""
    return uniform(F.col("session_id"), F.col("step_number"), F.col("candidate_item"), seed=seed)


def rank_labels(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Position of every shown item within its step, best score first, unscored last."""
    return scored.withColumn("rank", F.row_number().over(step_order(keys or STEP)).cast("long"))


def step_order(keys: list[str]) -> WindowSpec:
    """Shown items of a step, best first. The policy comes last in the sort, as the session tells rows apart sooner."""
    return Window.partitionBy(*sorted(keys, key="policy".__eq__)).orderBy(F.desc_nulls_last("score"), F.asc("candidate_item"))


def step_metrics(ranked: DataFrame, ks=KS, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, NDCG and acceptance at each k, and reciprocal rank, per step.

    Labels are 0/1, so the ideal gain depends on their number only and needs no second ranking.
    """
    keys = keys or STEP
    label, rank = F.col("label"), F.col("rank")
    aggregates = [F.sum(label).alias("relevant"), F.max(label / rank).alias("mrr")]
    for k in ks:
        inside = F.when(rank <= k, label).otherwise(0)
        aggregates += [F.sum(inside).alias(f"hits_{k}"), F.sum(inside / F.log2(rank + 1)).alias(f"dcg_{k}")]
    steps = ranked.groupBy(*keys).agg(*aggregates)
    columns = {}
    for k in ks:
        ideal = [0.0]
        for position in range(1, k + 1):
            ideal.append(ideal[-1] + 1 / math.log2(position + 1))
        best = F.get(F.array(*map(F.lit, ideal)), F.least(F.col("relevant"), F.lit(k)).cast("int"))
        columns[f"precision_{k}"] = F.col(f"hits_{k}") / float(k)
        columns[f"recall_{k}"] = F.coalesce(share(F.col(f"hits_{k}"), F.col("relevant")), F.lit(0.0))
        columns[f"ndcg_{k}"] = F.coalesce(F.try_divide(F.col(f"dcg_{k}"), best), F.lit(0.0))
        columns[f"acceptance_{k}"] = (F.col(f"hits_{k}") > 0).cast("double")
    return steps.withColumns(columns).select(*keys, "relevant", *columns, "mrr")


def policy_means(scored: DataFrame, ks=KS) -> DataFrame:
    """Mean of every step metric per policy, one row per (policy, metric)."""
    steps = step_metrics(rank_labels(scored), ks)
    metrics = [c for c in steps.columns if c not in (*STEP, "relevant")]
    means = steps.groupBy("policy").agg(*[F.avg(x).alias(x) for x in metrics])
    return means.unpivot(["policy"], metrics, "metric", "value")


def metrics_table(scored: DataFrame, model: str, baseline: str, ks=KS) -> DataFrame:
    """Model and baseline side by side with the relative improvement (null on a zero base)."""
    means = policy_means(scored.filter(F.col("policy").isin(model, baseline)), ks)
    table = means.groupBy("metric").pivot("policy", [model, baseline]).agg(F.first("value"))
    better = 100.0 * F.try_divide(F.col(model) - F.col(baseline), F.col(baseline))
    return table.select("metric", F.col(model).alias("model"), F.col(baseline).alias("baseline"), better.alias("improvement_pct"))


def class_counts(scored: DataFrame, group: list[str]) -> DataFrame:
    """Class counts per distinct score."""
    return scored.groupBy(*group, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def score_bucket() -> Column:
    return order_bucket(-F.col("score"), 4096)


def score_counts(scored: DataFrame, group: list[str]) -> DataFrame:
    """Class counts per distinct score with running totals from the highest score down.

    Everything below works on these counts; shown items are read once.
    """
    return running(class_counts(scored, group), group, score_bucket(), [F.desc("score")], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})


def score_quality(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """ROC-AUC (ties half), average precision and class-weighted log loss per group.

    AUC is null when a class is missing. The loss weighs positives by negatives / positives.
    """
    group = group or []
    pos, neg = F.col("pos"), F.col("neg")
    p = F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    sums = score_counts(scored, group).groupBy(*group).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(pos.cast("double") * (F.col("neg_upto") - neg / 2.0)).alias("_above"),
        F.sum(pos * (F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto")))).alias("_gain"),
        F.sum(pos * -F.log(p)).alias("_pos_loss"),
        F.sum(neg * -F.log(1 - p)).alias("_neg_loss"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    weight = share(F.col("negatives"), F.col("positives"))
    return sums.select(
        *group,
        "positives",
        "negatives",
        (F.lit(1.0) - F.try_divide(F.col("_above"), pairs)).alias("auc"),
        share(F.col("_gain"), F.col("positives")).alias("average_precision"),
        F.try_divide(
            F.col("_pos_loss") * weight + F.col("_neg_loss"), (F.col("positives") + F.col("negatives")).cast("double")
        ).alias("loss"),
    )


def auc_exact(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """ROC-AUC with ties counted half; null when a class is missing.

    A bucket of scores adds its own pairs and, for each of its positives, the negatives of the buckets above it: rows
    are read once, and only the buckets' sums meet. Buckets come first in the sort, as they tell rows apart sooner than the group.
    """
    group = group or []
    pos, neg = F.col("pos"), F.col("neg")
    counts = class_counts(scored, group).withColumn("_b", score_bucket())
    inside = Window.partitionBy("_b", *group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    buckets = counts.withColumn("_upto", F.sum("neg").over(inside)).groupBy(*group, "_b").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(pos.cast("double") * (F.col("_upto") - neg / 2.0)).alias("_inside"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    higher = F.coalesce(F.sum("neg").over(before), F.lit(0))
    sums = buckets.withColumn("_above", F.col("_inside") + pos.cast("double") * higher).groupBy(*group).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("_above").alias("_above"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(*group, "positives", "negatives", (F.lit(1.0) - F.try_divide(F.col("_above"), pairs)).alias("auc"))


def average_precision(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall curve as a step sum over distinct scores."""
    return score_quality(scored, group).select(*(group or []), "positives", "average_precision")
