"""Encodings of session context and catalogue attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from basketry import vocab
from basketry.functions.cleaning import lookup


def category_index(category: Column) -> Column:
    return F.coalesce(lookup(F.lower(category), vocab.CATEGORY_INDEX), F.lit(vocab.CATEGORY_INDEX["other"]))


def meal_type(hour: Column) -> Column:
    branch = F.when(F.lit(False), F.lit(None).cast("string"))
    for meal, (first, last) in vocab.MEAL_HOURS.items():
        branch = branch.when(hour.between(first, last), meal)
    return branch.otherwise("late_night")


def meal_type_index(meal: Column) -> Column:
    return F.coalesce(lookup(meal, vocab.MEAL_TYPE_INDEX), F.lit(1))


def user_type_index(user_type: Column) -> Column:
    return F.coalesce(lookup(user_type, vocab.USER_TYPE_INDEX), F.lit(1))


def context_columns(hour: Column, meal: Column, user_type: Column, category: Column) -> dict[str, Column]:
    """The seven context inputs of the ranker."""
    flags = {
        f"is_{name}": F.coalesce((F.lower(category) == name).cast("double"), F.lit(0.0))
        for name in ("main", "dessert", "beverage", "side")
    }
    return {
        "hour_norm": hour / F.lit(24.0),
        "meal_type_idx": meal_type_index(meal).cast("double"),
        "user_type_idx": user_type_index(user_type).cast("double"),
        **flags,
    }


def cuisine_group(cuisine: Column) -> Column:
    """First group with a cuisine that contains, or is contained in, the given text."""
    text = F.lower(cuisine)
    branch = F.when(F.lit(False), F.lit(None).cast("string"))
    for group, members in vocab.CUISINE_GROUPS.items():
        for member in members:
            name = member.lower()
            branch = branch.when(text.contains(name) | F.lit(name).contains(text), group)
    return branch.otherwise("indian")


def price_fit(user_type: Column, price: Column, inside: float, below: float, above: float) -> Column:
    """Score of a price against the user's spending bracket."""
    low = lookup(user_type, {k: v[0] for k, v in vocab.PRICE_BRACKETS.items()})
    high = lookup(user_type, {k: v[1] if v[1] is not None else float("inf") for k, v in vocab.PRICE_BRACKETS.items()})
    return F.when(price < low, below).when(price > high, above).otherwise(inside)


def merchant_price_fit(user_type: Column, price: Column) -> Column:
    return price_fit(user_type, price, inside=1.2, below=0.7, above=0.5)


def item_price_fit(user_type: Column, price: Column) -> Column:
    return price_fit(user_type, price, inside=1.0, below=0.6, above=0.3)


def heavy_meal(categories: Column, rule: str = "composition") -> Column:
    """1 when the cart is already a full meal.

    ``composition``: two mains, or a main with a side. ``size``: two mains, or four items.
    """
    mains = F.size(F.filter(categories, lambda c: c == "main"))
    if rule == "size":
        full = (mains >= 2) | (F.size(categories) >= 4)
    else:
        full = (mains >= 2) | ((mains >= 1) & F.array_contains(categories, "side"))
    return full.cast("int")


def lacks(categories: Column, category: str) -> Column:
    return (~F.array_contains(categories, category)).cast("int")
