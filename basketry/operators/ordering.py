"""Ranks, running totals and quantiles that never gather a group, or the table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions.numeric import order_bucket


def running(
    df: DataFrame,
    group: list[str],
    bucket: Column | list[Column],
    order: list[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add inclusive running totals along ``order`` within ``group`` (empty: the whole table).

    Rows are filed into order-preserving buckets. Bucket totals are pre-aggregated and accumulated
    on their own (few rows); rows are accumulated inside their bucket only, so a hot group spreads
    over as many tasks as it has buckets.
    """
    buckets = bucket if isinstance(bucket, list) else [bucket]
    names = [f"_b{i}" for i in range(len(buckets))]
    filed = df.withColumns({**dict(zip(names, buckets)), **{f"_v_{k}": v for k, v in totals.items()}})
    keys = [*group, *names]
    sums = filed.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in totals])
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in totals],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = filed.withColumns({f"_in_{k}": F.sum(f"_v_{k}").over(inside) for k in totals})
    joined = local.join(offsets, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    return joined.select(
        *df.columns, *[(F.col(f"_in_{k}") + F.col(f"_before_{k}")).alias(k) for k in totals]
    )


def ranked(df: DataFrame, group: list[str], score: Column, ties: list[Column], name: str = "rank") -> DataFrame:
    """Exact rank 1..n by descending score, ties broken by ``ties``."""
    return running(df, group, order_bucket(-score), [score.desc(), *ties], {name: F.lit(1).cast("long")})


def dense_index(df: DataFrame, key: str, bucket: Column | None = None) -> DataFrame:
    """Index 0..n-1 in key order. ``bucket`` must be monotone in the key.

    Text keys go by their first eight characters, three beyond the prefix that ids of one kind share.
    """
    text = dict(df.dtypes)[key] == "string"
    where = bucket if bucket is not None else (F.substring(key, 1, 8) if text else order_bucket(F.col(key), 4096))
    indexed = running(df, [], where, [F.col(key)], {"idx": F.lit(1).cast("long")})
    return indexed.withColumn("idx", F.col("idx") - 1)


def quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], group: list[str] | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles, one column per name.

    Equal values are counted first; positions come from the counts, so no task holds a column.
    """
    group = group or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, group, order_bucket(F.col(value)), [F.col(value)], {"_upto": F.col("_n")})
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    if group:
        both = placed.join(sizes, group)
        total = F.col("_total")
    else:
        both, total = placed, sizes.scalar()
    # One copy of the size per row, so that a scalar subquery is not repeated per expression.
    both = both.withColumn("_size", total)

    def at(position: Column) -> Column:
        hit = (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position)
        return F.max(F.when(hit, F.col(value).cast("double")))

    picks = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_size") - 1)
        picks += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_f_{name}"),
        ]
    found = both.groupBy(*group).agg(*picks)
    return found.select(
        *group,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probabilities
        ],
    )


def quantile(df: DataFrame, value: str, p: float) -> Column:
    """One exact quantile as a scalar subquery."""
    return quantiles(df, value, {"q": p}).scalar()
