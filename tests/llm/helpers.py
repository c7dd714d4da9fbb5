"""Small tables and rules by hand for the tests of the training-data operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **columns):
    """texts: a list (doc_ids count from 0) or a dict by doc_id."""
    rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
    full = [(d, t, columns.get("lang", {}).get(d, "en"), columns.get("source", {}).get(d, "s"), None if t is None else len(t)) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(rng):
    """Nulls, empty and blank texts, ties, a very long text, and letters of several bytes."""
    long = sentence(rng, 20_000)
    return [None, "", " \n\t ", "a", "ß é 日本 😀", "same text here", "same text here", long, "x" * 5000, "\n\n\n", "# * $ & |", "tail\n"]


def clash(df):
    """df with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("size", "h1", "drop__", "n_lines", "taken", "rank", "key", "bands", "k", "u1", "s", "start__", "bin", "word"):
        df = df.withColumn(name, F.lit("extra"))
    return df
