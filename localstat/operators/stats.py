"""Per-batch statistics, spatial lag and the local Moran statistic.

``obs`` has columns ``batch, node, value`` (others pass through ``standardise``).
"""

from pyspark.sql import functions as F

from localstat.functions.scalars import score
from localstat.plans.scale import materialise, sized, staged


def batch_stats(obs, by=("batch",), col="value"):
    """Count, sum, mean and population standard deviation per batch.

    One pass with map-side partials, so a batch holding most rows is no hot spot.
    """
    v = F.col(col)
    return obs.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sd"),
    )


def scored(df, by, col="value", name="z"):
    """Add standard scores of ``col`` within the groups ``by``.

    The per-group summary is staged and broadcast when small, so the rows themselves
    are not shuffled by group.
    """
    summary = materialise(batch_stats(df, by, col).select(*by, "mean", "sd"), "summary")
    return (
        df.join(sized(summary), list(by))
        .withColumn(name, score(F.col(col), F.col("mean"), F.col("sd")))
        .drop("mean", "sd")
    )


def standardise(obs):
    """Add ``z``, the standard score of ``value`` within its batch."""
    return scored(obs, ["batch"])


def map_to_neighbours(df, edges):
    """Re-key every row to each neighbour of its node; the payload is kept.

    The edges are broadcast when they are few enough, and joined by shuffle otherwise.
    """
    return _fan_out(df, sized(edges))


def _fan_out(df, edges):
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    return df.join(links, "node").drop("node").withColumnRenamed("_to", "node")


def neighbour_mean(df, edges, col, name="mean"):
    """Mean of ``col`` over all rows of a node's neighbours that are present.

    The rows are summed per (batch, node) before they fan out, so that many readings of one
    node travel to its neighbours as a single row, however many neighbours it has.
    """
    parts = [F.sum("_s").alias("_s"), F.sum("_n").alias("_n")]
    own = df.select(
        "batch", "node", F.col(col).alias("_s"), F.col(col).isNotNull().cast("bigint").alias("_n")
    )
    own = own.groupBy("batch", "node").agg(*parts)
    return (
        _fan_out(own, sized(edges))
        .groupBy("batch", "node")
        .agg(*parts)
        .where("_n > 0")
        .select("batch", "node", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias(name))
    )


def spatial_lag(z, edges):
    """Mean ``z`` of the reporting neighbours of each node."""
    return neighbour_mean(z, edges, "z", "lag")


def lisa_from_z(z, edges):
    """Local statistic ``z * lag``; nodes without a reporting neighbour give no row."""
    return z.join(spatial_lag(z, edges), ["batch", "node"]).withColumn("lisa", F.col("z") * F.col("lag"))


def spatial_lisa(obs, edges):
    """Local Moran statistic of every reading.

    Several readings of a node in a batch stay separate rows: all enter the mean, the
    deviation and the neighbours' lag, and each gets its own value. Extra columns of
    ``obs``, such as a row id, are kept.
    """
    return lisa_from_z(standardise(obs), staged(edges, "edges"))


def one_per_node(obs, order):
    """The last reading of each node and batch in the order of the given columns."""
    last = F.max_by("value", F.struct(*order)).alias("value")
    return obs.groupBy("batch", "node").agg(last)


def result_counts(obs, lisa):
    """Number of readings and of results per batch."""
    given = obs.groupBy("batch").agg(F.count(F.lit(1)).alias("n_values"))
    found = lisa.groupBy("batch").agg(F.count(F.lit(1)).alias("n_lisa"))
    return given.join(found, "batch", "left").select(
        "batch", "n_values", F.coalesce("n_lisa", F.lit(0)).alias("n_lisa")
    )
