"""Small column expressions shared by the operators."""

from pyspark.sql import functions as F


def node_key(col):
    """Number of an id such as ``node12``; null where there is none."""
    return F.regexp_extract(col, r"(\d+)$", 1).try_cast("bigint")


def score(value, mean, sd):
    """Standard score; NaN where all values are equal."""
    return F.when(sd != 0, (value - mean) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(float("nan")))


def close(x, y, tol):
    """Equality up to a relative tolerance."""
    return (x == y) | (F.abs(x - y) <= 0.5 * tol * (F.abs(x) + F.abs(y)))


def tuple_text(*cols):
    """Render columns as ``(a,b,...)``."""
    return F.concat(F.lit("("), F.concat_ws(",", *[F.col(c).cast("string") for c in cols]), F.lit(")"))
