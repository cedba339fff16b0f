"""Quality rules with robust multivariate outliers, all in DataFrame expressions.

Every document has a vector of transformed statistics. For each language and source the minimum-covariance-determinant
estimate is approached by concentration steps: the share of rows nearest to the present centre gives the next mean and
scatter. Two starts are tried and the one of smaller determinant goes on. Documents far from the estimate in
Mahalanobis distance are rejected. Means, scatters and thresholds are grouped aggregates with partial results per task;
group tables are stored, so the planner sees their true size when it joins them to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.shared import store

# The white space of the word rule, and the symbols counted.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
FEATURES = 5
CHI2_MEDIAN, CHI2_FAR = 4.351, 30.856  # quantiles 0.5 and 0.99999 of five degrees of freedom
GROUP = ["lang", "source"]
CELLS = list(combinations_with_replacement(range(FEATURES), 2))


@dataclass
class Settings:
    share: float = 0.75  # rows of a group that a concentration step keeps
    first_steps: int = 2
    last_steps: int = 4
    ridge: float = 0.05  # added to each variance, in units of the robust scale
    prior_rows: float = 20.0  # weight of the unit scatter, which small groups fall back to
    cutoff: float = CHI2_FAR  # squared distance over the consistency factor
    accuracy: int = 2000  # of approximate quantiles


def word_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text; null counts as empty."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("w", F.array_remove(F.split("text", BLANKS), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK_CHARS))) > 0))
    rows = rows.select(
        "doc_id", "lang", "source", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("p", places)
    # windows are told apart by 64-bit hashes
    rows = rows.withColumn("h", F.transform("p", lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(repeats, F.sort_array(F.arrays_zip("h", "p"))))
    same = lambda x, i: (x.h == F.get("s", i - 1).h) | (x.h == F.get("s", i + 1).h)
    rows = rows.withColumn("first", F.filter("s", lambda x, i: F.coalesce(same(x, i), F.lit(False))).getField("p"))
    covered = F.concat("first", F.transform("first", lambda x: x + 1), F.transform("first", lambda x: x + 2))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("first").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long").alias("n_repeat_words"))


def with_vector(stats: DataFrame) -> DataFrame:
    """base_failed, and x0..x4: log length, log word length, roots of the shares of symbols, equal lines, repeated words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumns({
        "base_failed": failed, "x0": F.log(words.cast("double")), "x1": 4 * F.log(chars / words),
        "x2": F.sqrt(F.col("n_symbols") / chars), "x3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x4": F.sqrt(F.col("n_repeat_words") / words)})


#: Least robust scale of each feature; a feature that hardly varies is not measured more finely. With ridge and cutoff, a large
#: group without symbols keeps documents of up to 1.6 % symbols, one without repeats up to 3.5 % equal lines or repeated words.
LEAST_SCALE = (0.3, 0.2, 0.1, 0.15, 0.15)


def same_group(one: str, two: str) -> Column:
    left = [F.col(f"{one}.{g}").eqNullSafe(F.col(f"{two}.{g}")) for g in GROUP]
    return left[0] & left[1]


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the columns of their group (null groups count as groups)."""
    more = [c for c in groups.columns if c not in GROUP]
    return rows.alias("r").join(groups.alias("g"), same_group("r", "g"), "left").select("r.*", *[f"g.{c}" for c in more])


def scales(rows: DataFrame, settings: Settings) -> DataFrame:
    """Median and interquartile scale of every feature by group."""
    out = [F.percentile_approx(f"x{k}", [0.25, 0.5, 0.75], settings.accuracy).alias(f"q{k}") for k in range(FEATURES)]
    groups = rows.groupBy(*GROUP).agg(*out)
    return groups.select(*GROUP, *[F.col(f"q{k}")[1].alias(f"c{k}") for k in range(FEATURES)],
                         *[F.greatest((F.col(f"q{k}")[2] - F.col(f"q{k}")[0]) / 1.349, F.lit(LEAST_SCALE[k])).alias(f"s{k}")
                           for k in range(FEATURES)])


def moments(rows: DataFrame, keys: list[str], values: list[Column], settings: Settings) -> DataFrame:
    """Mean m0.. and scatter v00.. of each group; the unit scatter weighs as ``prior_rows`` rows."""
    sums = [F.count("*").alias("n")] + [F.sum(v).alias(f"t{k}") for k, v in enumerate(values)]
    sums += [F.sum(values[a] * values[b]).alias(f"u{a}{b}") for a, b in CELLS]
    mean = {f"m{k}": F.col(f"t{k}") / F.col("n") for k in range(FEATURES)}
    scatter = {}
    for a, b in CELLS:
        own = F.col(f"u{a}{b}") - F.col(f"t{a}") * F.col(f"t{b}") / F.col("n")
        unit = settings.prior_rows if a == b else 0.0
        scatter[f"v{a}{b}"] = (own + unit) / (F.col("n") + settings.prior_rows) + (settings.ridge if a == b else 0.0)
    return rows.groupBy(*keys).agg(*sums).select(*keys, *[c.alias(k) for k, c in {**mean, **scatter}.items()])


def inverted(groups: DataFrame) -> DataFrame:
    """Inverse scatter q00.. and log determinant by Cholesky factors, one projection a row of the factor."""
    keep = groups.columns
    for i in range(FEATURES):
        for j in range(i + 1):
            rest = F.col(f"v{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(FEATURES):  # inverse of the factor, row by row
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                value = -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}")
            groups = groups.withColumn(f"w{i}{j}", value)
    inverse = {f"q{a}{b}": sum((F.col(f"w{k}{a}") * F.col(f"w{k}{b}") for k in range(b, FEATURES)), F.lit(0.0)) for a, b in CELLS}
    logdet = 2 * sum((F.log(f"l{i}{i}") for i in range(FEATURES)), F.lit(0.0))
    return groups.select(*[c for c in keep if c[0] != "v"], *[c.alias(k) for k, c in inverse.items()], logdet.alias("logdet"))


def distance() -> Column:
    """Squared Mahalanobis distance of z0.. under m0.. and q00.."""
    off = [F.col(f"z{k}") - F.col(f"m{k}") for k in range(FEATURES)]
    return sum((off[a] * off[b] * F.col(f"q{a}{b}") * (1 if a == b else 2) for a, b in CELLS), F.lit(0.0))


def concentrate(rows: DataFrame, estimate: DataFrame, settings: Settings) -> DataFrame:
    """One concentration step for every group and start."""
    keys = [*GROUP, "start"]
    near = with_groups(rows, estimate).withColumn("d", distance())
    limits = store(near.groupBy(*keys).agg(F.percentile_approx("d", settings.share, settings.accuracy).alias("limit")), "mcd-limits")
    both = estimate.alias("e").join(limits.alias("k"), same_group("e", "k") & (F.col("e.start") == F.col("k.start")))
    both = both.select("e.*", "k.limit")
    chosen = with_groups(rows, both).where(distance() <= F.col("limit"))
    return store(inverted(moments(chosen, keys, [F.col(f"z{k}") for k in range(FEATURES)], settings)), "mcd-estimate")


def estimates(rows: DataFrame, settings: Settings) -> DataFrame:
    """The estimate (m0.., q00.., consistency factor) of each group of rows with z0..."""
    plain = rows.select(*GROUP).distinct().withColumn("start", F.lit(0))
    unit = plain.select("*", *[F.lit(0.0).alias(f"m{k}") for k in range(FEATURES)],
                        *[F.lit(1.0 if a == b else 0.0).alias(f"q{a}{b}") for a, b in CELLS], F.lit(0.0).alias("logdet"))
    bent = inverted(moments(rows.withColumn("start", F.lit(1)), [*GROUP, "start"],
                            [F.tanh(f"z{k}") for k in range(FEATURES)], settings))
    found = store(unit.unionByName(bent), "mcd-starts")
    for _ in range(settings.first_steps):
        found = concentrate(rows, found, settings)
    best = F.min_by(F.struct(*found.columns), F.struct("logdet", "start")).alias("best")
    found = store(found.groupBy(*GROUP).agg(best).select("best.*"), "mcd-best")
    for _ in range(settings.last_steps):
        found = concentrate(rows, found, settings)
    spread = with_groups(rows, found).groupBy(*GROUP).agg(
        F.percentile_approx(distance(), 0.5, settings.accuracy).alias("middle"))
    # a normal group has its median distance at the chi-square median; no group is measured more finely than that
    factor = F.greatest(F.col("g.middle") / CHI2_MEDIAN, F.lit(1.0)).alias("factor")
    return found.alias("e").join(spread.alias("g"), same_group("e", "g")).select("e.*", factor)


def standardised(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[((F.col(f"x{k}") - F.col(f"c{k}")) / F.col(f"s{k}")).alias(f"z{k}") for k in range(FEATURES)])


def robust_outliers(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance; a row per row.

    Estimates are made from the documents that pass the base rules, by (lang, source), null values forming groups of
    their own. ``kept`` is false where base_failed, or where the squared distance exceeds the cutoff. A group of few
    rows leans on the unit scatter around its median, so that a row is not an outlier for want of company. Null and empty texts
    have no words and fail the base rules; ``distance`` is null where the whole group failed. Repeated rows count each.
    """
    stats = store(with_vector(word_stats(docs)), "text-stats")
    sound = stats.where(~F.col("base_failed")).select(*GROUP, *[f"x{k}" for k in range(FEATURES)])
    levels = store(scales(sound, settings), "mcd-scales")
    rows = store(standardised(with_groups(sound, levels)).select(*GROUP, *[f"z{k}" for k in range(FEATURES)]), "mcd-rows")
    found = store(estimates(rows, settings), "mcd-final")
    measured = with_groups(standardised(with_groups(stats, levels)), found)
    measured = measured.withColumn("distance", distance() / F.col("factor"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= settings.cutoff)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           kept.alias("kept"), "distance")
