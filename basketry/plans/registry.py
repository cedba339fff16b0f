"""Registered queries and the common shape of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from basketry.functions.numeric import fixed
from basketry.sources.bindings import CartModel

QUERIES: dict[str, Callable[[CartModel], DataFrame]] = {}


def query(name: str):
    def register(build: Callable[[CartModel], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        return build

    return register


def canonical(df: DataFrame) -> DataFrame:
    """Long integers, doubles with six decimals, arrays as comma-separated text."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            col = col.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = fixed(col.cast("double"))
        elif isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
                col = F.transform(col, lambda x: F.floor(x * 1e6 + 0.5))
            col = F.array_join(col.cast("array<string>"), ",")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(field.name))
    return df.select(*out)


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: canonical(build(CartModel(spark, sf_dir)))

    return {name: bind(build) for name, build in QUERIES.items()}
