"""Mergeable moments, and the spatial statistic out of them.

Moments are a count, a mean and a sum of squared deviations (``n, mean, m2``). Those of parts of a
group merge to those of the group, in any split and order. Scores are linear in the value, so the
moments of each (batch, node) hold all that the statistic needs: they merge to those of the
batch, and the sum of a node's scores is ``n * (mean - batch mean) / batch deviation``. One table of
(batch, node) serves both, and the readings themselves are joined once, where each of them is to
get a result of its own.
"""

from pyspark.sql import functions as F

from localstat.functions.scalars import score
from localstat.operators.stats import map_to_neighbours
from localstat.plans.scale import materialise, sized, staged


def node_moments(obs, by=("batch", "node"), col="value"):
    """Moments of the readings of each (batch, node); null values do not count."""
    v = F.col(col)
    found = obs.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")
    )
    return found.where("n > 0")


def merged(parts, by):
    """Moments of each group ``by`` out of moments of its parts.

    Deviations are taken from the mean of the whole group, so nothing cancels. Both sums combine
    per task first: a group that holds most parts is no hot spot. ``parts`` should be staged.
    """
    by = list(by)
    means = parts.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("mean")).alias("_s"))
    means = means.select(*by, (F.col("_s") / F.col("_n")).alias("_mean"))
    gap = F.col("mean") - F.col("_mean")
    return (
        parts.join(sized(materialise(means, "means")), by)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            F.first("_mean").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"),
        )
    )


def _scored(nodes):
    """Add the batch's ``_mean`` and ``_sd`` to staged (batch, node) moments; also those alone."""
    whole = merged(nodes, ["batch"]).select(
        "batch", F.col("mean").alias("_mean"), F.sqrt(F.col("m2") / F.col("n")).alias("_sd")
    )
    whole = sized(materialise(whole, "summary"))
    return nodes.join(whole, "batch"), whole


def lags_from_moments(scored, edges):
    """Mean score of the readings of each node's neighbours, by sums over the nodes."""
    z = score(F.col("mean"), F.col("_mean"), F.col("_sd"))
    sums = scored.select("batch", "node", (F.col("n") * z).alias("_s"), "n")
    around = map_to_neighbours(sums, edges).groupBy("batch", "node")
    around = around.agg(F.sum("_s").alias("_s"), F.sum("n").alias("_n"))
    return around.select("batch", "node", (F.col("_s") / F.col("_n")).alias("lag"))


def lisa_of_nodes(nodes, edges):
    """Spatial statistic of the mean reading of each (batch, node), each node counting once.

    ``nodes`` are moments of (batch, node); without a reporting neighbour there is no row.
    """
    nodes = materialise(nodes.select("batch", "node", "mean", F.lit(1).alias("n"), F.lit(0.0).alias("m2")), "nodes")
    scored, _ = _scored(nodes)
    z = score(F.col("mean"), F.col("_mean"), F.col("_sd")).alias("z")
    found = scored.select("batch", "node", z).join(lags_from_moments(scored, staged(edges, "edges")), ["batch", "node"])
    return found.withColumn("lisa", F.col("z") * F.col("lag"))


def lisa_of_readings(readings, nodes, edges):
    """Spatial statistic of every reading: all enter the moments and the lags.

    ``nodes`` are the moments of (batch, node) over the same readings. Extra columns are kept.
    """
    nodes = staged(nodes, "nodes")
    scored, whole = _scored(nodes)
    around = lags_from_moments(scored, staged(edges, "edges"))
    z = score(F.col("value"), F.col("_mean"), F.col("_sd"))
    rows = readings.join(whole, "batch").withColumn("z", z).drop("_mean", "_sd")
    return rows.join(around, ["batch", "node"]).withColumn("lisa", F.col("z") * F.col("lag"))
