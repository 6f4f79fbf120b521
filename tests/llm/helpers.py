"""Fixture rows shared by the operator tests."""

import random

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows, extra=False):
    """``rows`` of (doc_id, text, lang, source); ``extra`` adds columns under names that operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
    df = spark.createDataFrame(full, schema)
    if extra:
        from pyspark.sql import functions as F

        for name in ("size", "rate", "copies", "fp", "t", "n", "key", "hash", "score", "chunk", "kind", "copy",
                     "host", "line", "label", "words", "target", "source_size", "seg", "a", "b"):
            df = df.withColumn(name, F.lit(f"x-{name}"))
    return df


def odd_rows():
    """Null, empty, blank, one-word, repeated and very long texts; null source and lang; null id."""
    long = prose(9, 30_000)
    return [(1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \t\n ", None, "s2"), (4, "one", "en", None),
            (5, prose(5, 60), "en", "s2"), (5, prose(5, 60), "en", "s2"), (6, prose(5, 60), "de", "s1"),
            (7, long, "de", "s1"), (8, long, "de", None), (None, prose(8, 80), "fr", "s3"),
            (10, "a\n\nb\na\nÄ ß 漢字", "fr", "s3")]
