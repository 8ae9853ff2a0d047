"""Independent recomputation of results, and their comparison.

Written as SQL over the raw tables, apart from the operators it checks.
"""

from pyspark.sql import functions as F

from localstat.functions.scalars import close
from localstat.plans import scale
from localstat.plans.scale import group_sizes, materialise, sized

# Members of a drawn set, at most.
LARGEST_SET = 4
# Nodes up to which a batch's scores are one array, slots per reading, and sets that one task handles.
ARRAY_NODES, SPARSE, SETS_PER_TASK = 2_000_000, 8, 2_000_000

_MEANS = "SELECT batch, avg(value) AS mean FROM {obs} GROUP BY batch"

_DEVIATIONS = """
SELECT o.batch, any_value(m.mean) AS mean, sqrt(avg((o.value - m.mean) * (o.value - m.mean))) AS sd
FROM {obs} o JOIN {means} m ON o.batch = m.batch
GROUP BY o.batch
"""

_EXPECTED_LISA = """
WITH scores AS (
  SELECT o.batch, o.node,
    CASE WHEN m.sd = 0 THEN double('NaN') ELSE try_divide(o.value - m.mean, m.sd) END AS z
  FROM {obs} o JOIN {moments} m ON o.batch = m.batch
), degrees AS (
  SELECT src, count(*) AS degree FROM {edges} GROUP BY src
), around AS (
  SELECT e.src AS node, s.batch, sum(s.z / d.degree) AS lag
  FROM {edges} e JOIN scores s ON s.node = e.dst JOIN degrees d ON d.src = e.src
  GROUP BY e.src, s.batch
)
SELECT s.batch, s.node, s.z * a.lag AS lisa
FROM scores s JOIN around a ON a.batch = s.batch AND a.node = s.node
"""

_EXPECTED_POSITIONS = """
WITH members AS (
  SELECT batch, node, draw, explode(members) AS member FROM {sets}
), means AS (
  SELECT m.batch, m.node, m.draw, avg(z.z) AS mean
  FROM members m LEFT JOIN {z} z ON z.batch = m.batch AND z.node = m.member
  GROUP BY m.batch, m.node, m.draw
), smaller AS (
  SELECT m.batch, m.node, l.lisa - z.z * m.mean > 1e-9 AS is_smaller
  FROM means m
  JOIN {z} z ON z.batch = m.batch AND z.node = m.node
  JOIN {lisa} l ON l.batch = m.batch AND l.node = m.node
)
SELECT batch, node, (count_if(is_smaller) + 1) / (count(*) + 1) AS position
FROM smaller GROUP BY batch, node
"""


def expected_lisa(obs, edges):
    """Statistic per reading, dividing the neighbours' sum by the degree.

    Equal to the operator's result wherever all neighbours of a node reported; a
    neighbour that did not report adds nothing here but still counts in the degree.
    """
    sql = obs.sparkSession.sql
    means = sized(materialise(sql(_MEANS, obs=obs), "means"))
    moments = sized(materialise(sql(_DEVIATIONS, obs=obs, means=means), "moments"))
    return sql(_EXPECTED_LISA, obs=obs, moments=moments, edges=edges)


_OWN = """
SELECT z.batch, z.node, z.z, l.lisa, l.batch IS NOT NULL AS known
FROM {z} z LEFT JOIN {lisa} l ON l.batch = z.batch AND l.node = z.node
"""

_CELLS = """
WITH places AS (
  SELECT batch, explode(sequence(1L, bigint({nodes}))) AS node FROM (SELECT DISTINCT batch FROM {own} WHERE batch IS NOT NULL)
), sorted AS (
  SELECT p.batch, sort_array(collect_list(struct(p.node, o.z, o.lisa, o.known))) AS cells
  FROM places p LEFT JOIN {own} o ON o.batch = p.batch AND o.node = p.node
  GROUP BY p.batch
)
SELECT batch, cells.z AS scores, cells.lisa AS lisas, cells.known AS known FROM sorted
"""


def _looked_up_positions(own, sets, n_nodes):
    """Positions with the scores of a batch in an array by node, next to its sets.

    The arrays are broadcast when small together; else a copy of a batch's arrays is placed with every
    few million of its sets, which are shuffled once. Their members never become rows.
    """
    spark, count = own.sparkSession, sets.count()
    cells = materialise(spark.sql(_CELLS, own=own, nodes=n_nodes), "cells")
    keys = ["batch", "node"]
    if 2 * cells.count() * n_nodes <= 4 * scale.BROADCAST_ROWS:
        found = sets.join(F.broadcast(cells), "batch")
    else:
        salts = -(-n_nodes * count // (max(own.count(), 1) * SETS_PER_TASK)) or 1
        n = max(2 * spark.sparkContext.defaultParallelism, -(-count // SETS_PER_TASK))
        copies = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = sets.withColumn("_salt", F.coalesce(F.pmod("node", F.lit(salts)).cast("int"), F.lit(0)))
        by, keys = ["batch", "_salt"], [*keys, "_salt"]
        found = salted.repartition(n, *by).join(copies.repartition(n, *by).hint("shuffle_hash"), by)
    at = lambda array, node: f"get({array}, IF({node} BETWEEN 1 AND {n_nodes}, int({node} - 1), NULL))"
    slots = range(LARGEST_SET)
    several = f"IF(size(members) > {LARGEST_SET}, raise_error('a drawn set has too many members'), size(members)) AS _size"
    found = found.selectExpr(
        *keys, f"{at('known', 'node')} AS _known", f"{at('scores', 'node')} AS _z", f"{at('lisas', 'node')} AS _lisa", several,
        *[f"{at('scores', f'get(members, {i})')} AS _v{i}" for i in slots],
    ).where("_known AND _size > 0")
    total = " + ".join(f"coalesce(_v{i}, 0.0D)" for i in slots)
    n = " + ".join(f"int(_v{i} IS NOT NULL)" for i in slots)
    smaller = F.expr(f"_lisa - _z * (({total}) / nullif({n}, 0)) > 1e-9")
    counts = found.groupBy(*keys).agg(F.count_if(smaller).alias("_below"), F.count(F.lit(1)).alias("_n"))
    return counts.selectExpr("batch", "node", "(_below + 1) / (_n + 1) AS position")


def expected_positions(z, sets, lisa, drawn=False):
    """Monte Carlo positions recomputed from stored sets (batch, node, draw, members).

    ``drawn`` says that the sets are as ``random_sets`` draws them: a row each, of one to four members.
    Their members are then looked up in arrays of the scores, which ``z`` should be a staged table for;
    they are joined one by one for other sets, for keys that repeat, and where the arrays would be too
    large or sparse.
    """
    sql = z.sparkSession.sql
    if drawn:
        own = materialise(sql(_OWN, z=z, lisa=lisa), "own")
        most, readings = group_sizes(own.where("batch IS NOT NULL AND node IS NOT NULL"), ["batch", "node"])
        row = own.agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count_distinct("batch").alias("n")).first()
        if most == 1 and row.low >= 1 and row.high <= ARRAY_NODES and row.n * row.high <= SPARSE * readings:
            return _looked_up_positions(own, sets, row.high)
    return sql(_EXPECTED_POSITIONS, z=z, sets=sets, lisa=lisa)


def mismatches(actual, expected, keys, col, tol=1e-10, digits=None):
    """Rows that differ, or are on one side only.

    Values agree within a relative tolerance or, with ``digits``, after rounding.
    """
    keys = list(keys)
    both = actual.select(*keys, F.col(col).alias("actual"), F.lit(True).alias("_a")).join(
        expected.select(*keys, F.col(col).alias("expected"), F.lit(True).alias("_e")), keys, "full"
    )
    x, y = F.col("actual"), F.col("expected")
    same = F.round(x, digits) == F.round(y, digits) if digits is not None else close(x, y, tol)
    return both.where(
        F.col("_a").isNull() | F.col("_e").isNull() | ~F.coalesce(same, x.isNull() & y.isNull())
    ).drop("_a", "_e")


def compare_results(actual, expected, keys, col, tol=1e-10, digits=None):
    """Number of rows that differ, as ``bad``."""
    return mismatches(actual, expected, keys, col, tol, digits).agg(F.count(F.lit(1)).alias("bad"))
