"""Whole-word keyword matching and rule-based item categories."""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry import vocab
from basketry.functions.cleaning import strip

KEYWORDS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data", "keywords.csv")
BROADCAST_ROWS = 1 << 18  # keywords sent to every task at most
CLASSES = ("beverage", "dessert", "side", "main", "non_veg", "veg")
WORD_CHARS = r"\p{L}\p{N}_"  # letters of any script count as part of a word
#: What a keyword may end with beside itself, by its last letters: "dosa" also finds "dosas", "sandwich" "sandwiches".
PLURALS = (("(?:s|x|z|ch|sh)$", "es"), ("[^sxzy]$", "s"))


def default_words() -> list[tuple[str, str]]:
    """The shipped (class, keyword) rows, singular forms."""
    with open(KEYWORDS, newline="", encoding="utf-8") as file:
        return [(row["class"], row["keyword"]) for row in csv.DictReader(file)]


def keyword_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(class, keyword) rows of a CSV file of any length, or the shipped ones."""
    if path is not None:
        return spark.read.schema("class string, keyword string").option("header", True).csv(path)
    return spark.createDataFrame(default_words(), "class string, keyword string")


def with_plurals(table: DataFrame) -> DataFrame:
    """Keywords in lower case with the plural of their last word, each form once a class; forms that do not begin and end with a word are dropped."""
    word = F.lower(F.trim("keyword"))
    plural = F.lit(None).cast("string")
    for ending, added in reversed(PLURALS):
        plural = F.when(word.rlike(ending), F.concat(word, F.lit(added))).otherwise(plural)
    forms = table.select("class", F.explode(F.array(word, plural)).alias("keyword"))
    whole = F.col("keyword").rlike(r"^[\p{L}\p{N}_](?s:.*[\p{L}\p{N}_])?$")
    return forms.filter(whole).distinct()


def word_runs(text: str, longest: int) -> Column:
    """For every word of a text in order: the text from it to the end of the ``longest`` th word on, or of the last one."""
    word, gap = f"[{WORD_CHARS}]++", f"[^{WORD_CHARS}]++"
    return F.regexp_extract_all(text, F.lit(rf"(?<![{WORD_CHARS}])(?=({word}(?:{gap}{word}){{0,{longest - 1}}}))"), F.lit(1))


def keyword_matches(texts: DataFrame, table: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Keywords of each class that occur in a text as whole words, one row per row of ``texts``: key and one sorted array a class.

    ``key`` tells the rows apart. Words meet the first words of the table in an equi-join, whatever the number of keywords;
    the few that meet compare the words that follow. Of overlapping matches of a class the leftmost counts, of those that begin together the longest,
    so "garlic naan" is no "naan". A null text holds nothing.
    """
    forms = with_plurals(table)
    words = F.regexp_extract_all("keyword", F.lit(f"([{WORD_CHARS}]+)"), F.lit(1))
    forms = forms.select("class", "keyword", F.get(words, F.lit(0)).alias("first"), F.size(words).alias("words"))
    size = forms.agg(F.count("*").alias("rows"), F.max("words").alias("longest")).first()
    # words stay where they are while the table is small; a larger one meets them by a shuffle
    forms = F.broadcast(forms) if size.rows <= BROADCAST_ROWS else forms
    low = texts.select(*key, F.lower(F.col(text)).alias("_text"))
    runs = F.transform(word_runs("_text", size.longest or 1), lambda x: F.struct(F.regexp_extract(x, f"^[{WORD_CHARS}]+", 0).alias("first"), x.alias("run")))
    each = low.select(*key, F.posexplode(runs).alias("pos", "_run")).select(*key, "pos", "_run.*")
    after = F.substring("run", F.length("keyword") + 1, F.lit(1))
    found = each.join(forms, "first").filter(F.startswith("run", "keyword") & ~after.rlike(f"[{WORD_CHARS}]"))
    # one pass in order of (class, pos, longest first): a match stays unless an earlier one of its class reaches over it
    match = F.struct("class", "pos", (-F.col("words")).alias("order"), "keyword")
    kept = F.aggregate(
        F.sort_array(F.collect_list(match)),
        F.struct(F.lit("").alias("class"), F.lit(0).alias("free"), F.array().cast("array<struct<class:string,keyword:string>>").alias("kept")),
        lambda done, x: F.when((done["class"] == x["class"]) & (x["pos"] < done["free"]), done).otherwise(F.struct(
            x["class"].alias("class"), (x["pos"] - x["order"]).alias("free"),
            F.when(F.array_contains(done["kept"], F.struct(x["class"].alias("class"), x["keyword"].alias("keyword"))), done["kept"])
            .otherwise(F.array_append(done["kept"], F.struct(x["class"].alias("class"), x["keyword"].alias("keyword")))).alias("kept"))),
        lambda done: done["kept"],
    )
    hits = found.groupBy(*key).agg(kept.alias("_kept"))
    none = F.array().cast("array<string>")
    joined = texts.select(*key).join(hits, key, "left")

    def of_class(name: str) -> Column:
        own = F.transform(F.filter("_kept", lambda x: x["class"] == name), lambda x: x["keyword"])
        return F.coalesce(F.sort_array(F.array_distinct(own)), none).alias(name)

    return joined.select(*key, *[of_class(name) for name in CLASSES])


def cuisine_fallback(cuisine: Column) -> Column:
    """Category implied by the cuisine: exact name first, else the first name it contains."""
    text = strip(F.lower(cuisine))
    pairs = [(name, category) for category, names in vocab.CUISINE_CATEGORY.items() for name in names]
    exact = F.when(F.lit(False), F.lit(None).cast("string"))
    partial = exact
    for category, names in vocab.CUISINE_CATEGORY.items():
        exact = exact.when(text.isin(names), category)
    for name, category in pairs:
        partial = partial.when(text.contains(name), category)
    return F.coalesce(exact, partial)


def with_categories(df: DataFrame, name: str = "item_name", cuisine: str = "cuisine", table: DataFrame | None = None) -> DataFrame:
    """Add category, veg flag, their confidences and the path that decided.

    Each distinct name is matched once; ``table`` holds (class, keyword), by default the shipped words.
    """
    words = keyword_table(df.sparkSession) if table is None else table
    names = df.select(F.coalesce(F.col(name), F.lit("")).alias("_name")).distinct()
    hits = keyword_matches(names, words, ["_name"], "_name")
    counts = hits.select("_name", *[F.size(c).alias(f"n_{c}") for c in CLASSES])
    counted = df.withColumn("_name", F.coalesce(F.col(name), F.lit(""))).join(counts, "_name")
    counted = counted.withColumn("_by_cuisine", cuisine_fallback(F.col(cuisine)))
    n = {c: F.col(f"n_{c}") for c in CLASSES}
    empty = F.col("_name") == ""
    main_wins = (n["side"] > 0) & (n["main"] > n["side"])

    category = (
        F.when(empty, "main")
        .when(n["beverage"] > 0, "beverage")
        .when(n["dessert"] > 0, "dessert")
        .when(main_wins, "main")
        .when(n["side"] > 0, "side")
        .when(n["main"] > 0, "main")
        .otherwise(F.coalesce("_by_cuisine", F.lit("main")))
    )
    source = (
        F.when(empty, "default_fallback")
        .when(n["beverage"] + n["dessert"] + n["side"] + n["main"] > 0, "keyword")
        .when(F.col("_by_cuisine").isNotNull(), "cuisine_fallback")
        .otherwise("default_fallback")
    )

    def sure(base: float, step: float, hits: Column) -> Column:
        return F.least(F.lit(1.0), F.lit(base) + F.lit(step) * hits)

    confidence = (
        F.when(empty, 0.3)
        .when(n["beverage"] > 0, sure(0.7, 0.1, n["beverage"]))
        .when(n["dessert"] > 0, sure(0.7, 0.1, n["dessert"]))
        .when(main_wins, sure(0.6, 0.1, n["main"]))
        .when(n["side"] > 0, sure(0.6, 0.1, n["side"]))
        .when(n["main"] > 0, sure(0.6, 0.1, n["main"]))
        .when(F.col("_by_cuisine").isNotNull(), 0.5)
        .otherwise(0.4)
    )
    veg_flag = F.when(n["non_veg"] > 0, 0).when(n["veg"] > 0, 1).otherwise(-1)
    veg_confidence = (
        F.when(n["non_veg"] > 0, sure(0.8, 0.05, n["non_veg"]))
        .when(n["veg"] > 0, sure(0.7, 0.05, n["veg"]))
        .otherwise(0.0)
    )
    return counted.withColumns({
        "item_category": category,
        "veg_flag": veg_flag,
        "category_confidence": confidence,
        "veg_confidence": veg_confidence,
        "decision_source": source,
    }).drop("_name", "_by_cuisine", *[f"n_{c}" for c in CLASSES])
