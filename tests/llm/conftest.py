import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


def words(rng: random.Random, n: int) -> list[str]:
    syllables = ["ba", "ko", "mi", "tur", "ne", "sol", "ri", "da", "lem", "fo", "gra", "pi"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = words(rng, n)
    lines = [" ".join(out[k:k + 12]).capitalize() + "." for k in range(0, n, 12)]
    return "\n".join(lines)


def odd_rows(rng: random.Random) -> list[tuple]:
    """Null, empty, blank, very long, repeated and tied rows, and null keys."""
    text = prose(rng, 90)
    return [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (None, text, "en", None, 9),
            (5, text, "en", "a", 9), (5, text, "en", "a", 9), (6, text, None, None, None), (7, prose(rng, 60_000), "de", "b", 9),
            (8, "one", "en", "a", 3), (9, "ΑΣ café İ \U0001f600 naïve\x85x\x1cy <|endoftext|> it's", "fr", "b", 5)]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with more columns, named like columns that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(random.Random(3)), SCHEMA)
    return df.withColumns({n: F.lit(7) for n in ("score", "component", "print", "key", "row", "bucket", "removed", "w", "sig")})


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Prose, copies, near copies, junk and toxic words, with labels."""
    rng = random.Random(11)
    rows, labels = [], []
    base = prose(rng, 80)
    for i in range(240):
        text, quality, toxic = prose(rng, rng.randint(55, 160)), 1, 0
        if i % 6 == 1:
            text, quality = " ".join(w.upper() + "!!" for w in text.split()), 0
        if i % 6 == 2:
            text, quality = " ".join(w + rng.choice(["###", "%%%", "***"]) for w in text.split()), 0
        if i % 4 == 3:
            parts = text.split(" ")
            for bad in ("idiot", "moron", "scum"):
                parts.insert(rng.randrange(len(parts)), bad)
            text, toxic = " ".join(parts), 1
        if i % 20 == 0:
            text = base
        if i % 20 == 10:
            text = base.replace("\n", "  ", 1)
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 3}", len(text)))
        labels.append((i, quality, toxic))
    labels += [(3, None, None), (None, 1, 1), (10_000, 1, 0)]
    return (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
