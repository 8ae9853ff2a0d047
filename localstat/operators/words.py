"""Word counts over text columns."""

from pyspark.sql import functions as F


def word_count(df, col="text", by=()):
    """Occurrences of each word, splitting on single spaces.

    Spaces at the end produce no words, inner runs of spaces produce empty ones, and an
    empty line is one empty word. ``by`` adds grouping keys such as ``batch``.
    """
    text = F.col(col)
    trimmed = F.rtrim(text)
    lines = df.where((F.length(text) == 0) | (trimmed != ""))
    words = lines.select(*by, F.explode(F.split(trimmed, " ")).alias("word"))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))
