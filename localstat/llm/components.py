"""Connected components of an edge table, as alternating star joins.

Every round replaces the edges by edges towards smaller ids; the table never gets more
rows than it had, plus one per node. Minima are combined before the shuffle, so a node
with a third of all edges is no hot spot; the rounds are staged as tables, so nothing is
recomputed when an executor is lost.
"""

from pyspark.sql import functions as F

from localstat.plans.scale import materialise

MAX_ROUNDS = 60


def _large_star(edges):
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges):
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
    )


def components(edges):
    """``(u, v)`` links to ``(id, component)``: the smallest id reachable from each linked id.

    Ids without a link to another id have no row. Self links and repeated links change
    nothing; rows with a null end are dropped. An empty table gives an empty one.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = materialise(edges.distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        step = _small_star(_large_star(edges)).where("u <> v").distinct()
        edges = materialise(step, "links")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError("components did not settle")
