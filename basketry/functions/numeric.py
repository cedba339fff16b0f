"""Numeric Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(col: Column, digits: int = 6) -> Column:
    """Round half up at ``digits`` decimals with plain double arithmetic.

    Where the scaled value has no fraction left in a double (2^53 and more), and for NaN, the value stays as it is.
    """
    scale = float(10**digits)
    exact = F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(F.abs(col) * F.lit(scale) < F.lit(float(2**53)), exact).otherwise(col)


def money(col: Column) -> Column:
    """Exact amount: sums no longer depend on the order in which rows arrive."""
    return col.try_cast("decimal(28,2)")


def clip(col: Column, low: float, high: float) -> Column:
    """Bound a value; missing stays missing."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def share(part: Column, whole: Column) -> Column:
    """Ratio that is null when the base is empty or zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def order_bucket(col: Column, resolution: int = 1024) -> Column:
    """Coarse, order-preserving bucket of a number (relative width 1/resolution).

    A fixed function of the value: every scan and every retried task files a row alike.
    """
    x = col.cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(float(resolution))).cast("long")


def exact_mean(col: Column, scale: int = 4) -> Column:
    """Mean from an exact decimal sum, so the result does not depend on row order."""
    return F.try_divide(F.sum(col.try_cast(f"decimal(28,{scale})")).cast("double"), F.count(col).cast("double"))
