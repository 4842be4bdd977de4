"""Documents that are hard to handle, and small brute-force versions."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("fp", "grp", "_id", "_key", "_k1", "_k2", "_text", "_cuts", "row", "score", "rank", "length", "start", "key", "h1", "words", "predicted", "doc_key", "line", "packed", "cuts", "keeper", "id")


def documents(spark, texts, ids=None, langs=None):
    ids = ids or list(range(len(texts)))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", len(t) if t is not None else None) for i, t, g in zip(ids, texts, langs)], DOCS)


def clashing(df):
    """df with extra columns of names that operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def awkward_texts():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [None, "", " ", "\n\n", "one", "two words", "é́   漢字 🙂", long, long, "\x00 a \x1f b", "a\nb\nc\nd\ne\nf\ng\nh" * 20]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
