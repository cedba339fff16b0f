"""Cleaning of dirty menu text: Column -> Column, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from basketry import vocab
from basketry.functions.numeric import fixed

NUMBER = r"([0-9]+\.?[0-9]*)"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def title_case(col: Column) -> Column:
    """Capital after every non-letter ("chef's" -> "Chef'S"), unlike ``initcap``."""
    runs = F.regexp_extract_all(F.lower(col), F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def lookup(col: Column, table: dict) -> Column:
    """Value of a small constant table, null when absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), col)


def clean_city(col: Column) -> Column:
    def known(stripped: Column) -> Column:
        key = F.regexp_replace(F.lower(stripped), r"^[\s,]+|[\s,]+$", "")
        return F.coalesce(lookup(key, vocab.CITY_ALIASES), title_case(stripped))

    return F.when(col.isNull(), F.lit("Unknown")).otherwise(let(strip(col), known))


def clean_cuisine(col: Column) -> Column:
    primary = strip(F.element_at(F.split(col, ","), 1))
    return F.when(col.isNull(), F.lit("Other")).otherwise(
        F.coalesce(lookup(F.lower(primary), vocab.CUISINE_ALIASES), title_case(primary))
    )


def first_number(col: Column) -> Column:
    return F.regexp_extract(col, NUMBER, 1).try_cast("double")


def clean_rating(col: Column) -> Column:
    def rated(text: Column) -> Column:
        return F.when(~text.isin(vocab.RATING_MISSING), let(first_number(text), lambda x: F.when(x.between(0.0, 5.0), fixed(x, 2))))

    return let(F.lower(strip(col)), rated)


def clean_votes(col: Column) -> Column:
    """Vote count; 0 where there is none or it exceeds a long."""
    def number(compact: Column) -> Column:
        unit = F.when(compact.endswith("k"), 1e3).when(compact.endswith("m"), 1e6).otherwise(1.0)
        return (first_number(compact) * unit).try_cast("long")

    def votes(text: Column) -> Column:
        return F.when(~text.isin(vocab.VOTES_MISSING), let(F.regexp_replace(text, "[, ]", ""), number))

    return F.coalesce(let(F.lower(strip(col)), votes), F.lit(0).cast("long"))


def clean_price(col: Column) -> Column:
    def number(compact: Column) -> Column:
        lower_bound = F.when(compact.startswith("-"), compact).otherwise(F.element_at(F.split(compact, "-"), 1))
        return let(first_number(lower_bound), lambda x: fixed(x, 2))

    def price(text: Column) -> Column:
        return F.when(~text.isin(vocab.PRICE_MISSING), let(F.regexp_replace(text, "[₹$€£,\\s]", ""), number))

    return let(F.lower(strip(col)), price)


def clean_item_name(col: Column) -> Column:
    spaced = F.regexp_replace(strip(F.lower(col)), r"\s+", " ")
    return F.coalesce(F.btrim(spaced, F.lit(".-_,;:'\"")), F.lit(""))


def clean_bestseller(col: Column) -> Column:
    """1 for a best-seller tag or a literal flag."""
    tagged = let(F.lower(strip(col)), lambda x: x.rlike("|".join(vocab.BESTSELLER_TAGS)) | x.isin(vocab.BESTSELLER_FLAGS))
    return F.coalesce(tagged.cast("long"), F.lit(0).cast("long"))


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)))


def merchant_key(name: Column, city: Column, place: Column) -> Column:
    """Restaurant id. Always built from cleaned columns, so menu and restaurant rows agree."""
    return short_id(
        "REST_", F.lower(strip(name)), F.lower(strip(city)), F.coalesce(F.lower(strip(place)), F.lit(""))
    )


def item_key(restaurant_id: Column, name: Column, price: Column) -> Column:
    price_text = F.coalesce(price.try_cast("decimal(38,2)").cast("string"), F.lit("0"))
    return short_id("ITEM_", F.lower(restaurant_id), F.lower(strip(name)), price_text)
