"""Small document tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties and a very long text."""
    rng = random.Random(5)
    long = prose(rng, 30_000, 5_000)
    plain = [(i, prose(rng, 40 + i), "en", f"s{i % 3}", 9) for i in range(12)]
    return [
        *plain, plain[0], plain[0], (None, plain[1][1], None, None, None), (None, None, None, None, None),
        (50, None, "en", "s0", 0), (51, "", "en", "s0", 0), (52, " \n\t\r\n ", "en", "s1", 6), (53, "One", "en", "s1", 3),
        (54, "one two", "en", None, 7), (55, "É ñ x \x1c y", "fr", "s2", 9), (56, long, "en", "s2", len(long)),
        (57, "a@b.co 1.2.3.4\n" * 5, "en", "s2", 75), (58, long, "en", "s0", len(long)),
    ]


def table(spark, rows, extra=()):
    """The rows as a documents table; ``extra`` names further columns."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


CLASHING = ("size", "shard", "target", "place", "host", "line", "set", "root", "n", "words", "hits", "spans", "base",
            "candidates", "chunk", "item", "text_crc32", "kept", "bin", "score", "__times")
