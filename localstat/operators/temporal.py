"""Bounded histories and the temporal variant of the local statistic.

A history is an array of at most ``k`` values of one node, oldest first. Position 0
is the anchor whose statistic is computed; positions 1, 2, ... are its past.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from localstat.operators.stats import map_to_neighbours, scored
from localstat.plans.scale import HOT_ROWS, group_sizes, running_weight, staged


def history_arrays(obs, k, order=("batch",), hot_rows=None):
    """Add ``vals``: the last ``k`` values of the node up to and including this row.

    ``order`` must be unique within a node. When a node has more rows than one task
    should sort, its timeline is numbered and cut into pieces; the last ``k - 1`` rows
    of a piece are repeated at the head of the next one to complete the frames there.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    frame = (-(k - 1), Window.currentRow)
    if group_sizes(obs, ["node"])[0] <= hot_rows:
        window = Window.partitionBy("node").orderBy(*order).rowsBetween(*frame)
        return obs.withColumn("vals", F.collect_list("value").over(window))

    size = max(hot_rows, k)
    pos, piece = F.col("_pos") - 1, F.floor((F.col("_pos") - 1) / size)
    numbered = running_weight(obs, ["node"], order, "_pos", hot_rows=hot_rows)
    pieces = numbered.withColumn(
        "_piece",
        F.explode(
            F.when(pos % size > size - k, F.array(piece, piece + 1)).otherwise(F.array(piece))
        ),
    )
    window = Window.partitionBy("node", "_piece").orderBy("_pos").rowsBetween(*frame)
    return (
        pieces.withColumn("vals", F.collect_list("value").over(window))
        .where(F.col("_piece") == piece)
        .drop("_pos", "_piece")
    )


def anchored(hist, anchor):
    """Histories rearranged so that position 0 is the anchor.

    ``oldest``: the array as it is, the anchor is its first value. ``latest``: newest
    first, so the anchor is the current value and position i lies i readings back.
    """
    if anchor not in ("oldest", "latest"):
        raise ValueError("anchor is 'oldest' or 'latest'")
    return hist if anchor == "oldest" else hist.withColumn("vals", F.reverse("vals"))


def split_history(hist, anchor="oldest"):
    """Split ``vals`` into the anchor ``value`` and the ``past`` array."""
    vals = F.col("vals")
    rest = F.slice(vals, 2, F.greatest(F.size(vals) - 1, F.lit(0)))
    return anchored(hist, anchor).select(
        "batch", "node", F.element_at(vals, 1).alias("value"), rest.alias("past")
    )


def history_flat(hist):
    """One row per stored value, labelled ``k-0`` (oldest), ``k-1``, ..."""
    return hist.select("batch", "node", F.posexplode("vals").alias("_pos", "value")).select(
        "batch", "node", F.concat(F.lit("k-"), F.col("_pos").cast("string")).alias("label"), "value"
    )


def lag_rows(hist, anchor="oldest"):
    """One row per position: lag 0 is the anchor, lags 1, 2, ... its past."""
    return anchored(hist, anchor).select("batch", "node", F.posexplode("vals").alias("lag", "value"))


def lag_stats(rows):
    """Mean and population deviation per batch and past position over all nodes."""
    return rows.groupBy("batch", "lag").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )


def past_standardise(rows):
    """Add ``z``, the score of each value among all nodes' values at the same position."""
    return scored(rows, ["batch", "lag"])


def past_neighbour_values(z_rows, edges):
    """Past scores that reach each node from its neighbours.

    For every neighbour with a history, the node's own past once more and that
    neighbour's past; sums and counts stand for the concatenated lists.
    """
    own = past_sums(z_rows)
    return (
        map_to_neighbours(own.select("batch", "node", "past_sum", "past_n"), edges)
        .groupBy("batch", "node")
        .agg(
            F.count(F.lit(1)).alias("reporting"),
            F.sum("past_sum").alias("_ps"),
            F.sum("past_n").alias("_pn"),
        )
        .join(own, ["batch", "node"])
        .select(
            "batch",
            "node",
            (F.col("_ps") + F.col("reporting") * F.col("past_sum")).alias("total"),
            (F.col("_pn") + F.col("reporting") * F.col("past_n")).alias("n"),
        )
    )


def past_sums(z_rows):
    """Anchor score, and sum and number of past scores, per batch and node."""
    past = F.col("lag") > 0
    return z_rows.groupBy("batch", "node").agg(
        F.max(F.when(~past, F.col("z"))).alias("z"),
        F.sum(F.when(past, F.col("z")).otherwise(F.lit(0.0))).alias("past_sum"),
        F.count_if(past).alias("past_n"),
    )


def temporal_lag(z_rows, edges):
    """Average over neighbours' anchors, own past and neighbours' past.

    With d reporting neighbours the own past counts d times, so the average is
    (sum z_j + d * own_sum + sum past_sum_j) / (d * (1 + own_n) + sum past_n_j):
    one pass over the edges and one aggregation.
    """
    own = past_sums(z_rows)
    around = (
        map_to_neighbours(own, edges)
        .groupBy("batch", "node")
        .agg(
            F.count(F.lit(1)).alias("_d"),
            F.sum(F.col("z") + F.col("past_sum")).alias("_s"),
            F.sum("past_n").alias("_n"),
        )
    )
    total = F.col("_s") + F.col("_d") * F.col("past_sum")
    n = F.col("_d") * (1 + F.col("past_n")) + F.col("_n")
    return own.join(around, ["batch", "node"]).select(
        "batch", "node", "z", "past_n", (total / n).alias("lag")
    )


def lisa_from_history(hist, edges, anchor="oldest"):
    """Temporal statistic from ready-made history arrays."""
    z_rows = past_standardise(lag_rows(hist, anchor))
    lagged = temporal_lag(z_rows, staged(edges, "edges"))
    return lagged.withColumn("lisa", F.col("z") * F.col("lag"))


def temporal_lisa(obs, edges, k, anchor="oldest"):
    """Temporal statistic over the last ``k`` readings of every node."""
    return lisa_from_history(history_arrays(obs, k), edges, anchor)
