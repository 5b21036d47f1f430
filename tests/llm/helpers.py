"""Frames with what every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

CLASHES = ("id", "text_", "host", "class", "label", "shingles", "key", "block", "pos", "n", "row", "at", "h", "top", "target_id", "judged_text", "marks")


def clashing(df):
    """Extra columns named as operators name theirs, for names the frame doesn't have."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


def odd_documents(spark):
    long = "the quick brown fox jumps over the lazy dog " * 3000
    rows = [(1, "One two three four five six seven."), (1, "One two three four five six seven."), (2, None), (3, ""), (4, " \n\t "), (None, "A text without an id, but with words."),
            (None, None), (5, long), (6, "x"), (7, "12 34 !!"), (8, "One two three four five six seven.")]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
