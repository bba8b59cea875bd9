"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = words(20_000, 1)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 5), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3), (6, "one", "en", "b", 3),
        (7, long, "en", "a", len(long)), (8, long + " more", "en", None, None), (9, words(200, 2), "en", "a", 1), (9, words(200, 2), "en", "a", 1), (None, words(50, 3), "en", "c", 1),
        (10, "ÄÖÜ Straße 北京 \U0001f600", "de", "c", 9), (11, words(200, 2).upper(), "en", "b", 1),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """df with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names})
