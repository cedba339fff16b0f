"""Reproducible pseudo-random numbers from keys, equal on every retry and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRIME = 2147483647  # 2^31 - 1


def digest(*parts: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash28(md5: Column, start: int = 1) -> Column:
    """28-bit integer from seven hex digits of a digest."""
    return F.conv(F.substring(md5, start, 7), 16, 10).cast("long")


def uniform(*parts: Column, seed: int = 0) -> Column:
    """Value in (0, 1) derived from the keys."""
    return (hash28(digest(*parts, seed=seed)) + 0.5) / F.lit(268435456.0)


def pairwise_uniform(multiplier: Column, offset: Column, key: Column) -> Column:
    """Value in (0, 1) for a (row, item) pair from one hash per row and two per item.

    A linear map modulo a prime is pairwise independent, so no digest is needed per pair.
    """
    return (((multiplier * key + offset) % F.lit(PRIME)) + 1).cast("double") / F.lit(float(PRIME + 1))


def race_key(u: Column, weight: Column) -> Column:
    """Exponential race: the smallest keys are a weighted sample without replacement."""
    return -F.log(u) / weight
