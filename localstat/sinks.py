"""Result sinks: tables or tuple text, one folder per batch."""

from pyspark.sql import functions as F

from localstat.functions.scalars import tuple_text

# The names results are stored under.
VALUES, LISA = "allValues", "finalLisaValues"
POSITIONS, SETS = "measuredValuesPositions", "randomNeighbourTuples"
# Readings that came after their batch had closed.
LATE = "lateValues"
# The batches that each micro-batch held.
BATCHES = "batchesSeen"


def write_batch(df, path, name, batch_id):
    """Replace the result of one micro-batch."""
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")


def _by_batch(out):
    """Writer that replaces the batches it has rows for and leaves the others alone."""
    return out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")


def write_batches(df, path, name, fmt="parquet", columns=("node", "value")):
    """Write all batches below ``path/name/batch=...``, as Parquet or ``(id,value)`` lines.

    A batch that is written again is replaced; other batches stay.

    Rows are rebalanced by batch before writing: small batches give one file each, and a
    batch that holds most rows is split over many tasks.
    """
    out = df.hint("rebalance", F.col("batch"))
    if fmt == "text":
        out = out.select("batch", tuple_text(*columns).alias("value"))
    _by_batch(out).format(fmt).save(f"{path}/{name}")


def write_sets(sets, path, name):
    """Write random sets as ``(id,List(a, b, c))`` lines, one folder per batch."""
    members = F.array_join(F.col("members").cast("array<string>"), ", ")
    line = F.concat(F.lit("("), F.col("node").cast("string"), F.lit(",List("), members, F.lit("))"))
    out = sets.hint("rebalance", F.col("batch")).select("batch", line.alias("value"))
    _by_batch(out).text(f"{path}/{name}")
