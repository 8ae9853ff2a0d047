"""Run analytics: batch durations out of scheduler logs, and their summaries.

Durations are rows with ``seconds`` and whatever keys the summary groups by, such as
``run``, ``base`` (number of stations), ``k`` and ``topology``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from localstat.plans.scale import null_safe_join, quantiles, running_weight

# Fixed text that marks a duration line in the scheduler's log.
DELAY_MARK = "JobScheduler: Total delay"
# The station counts that runs are made with.
STATION_COUNTS = [1, 2, 4, 8, 16]


def parse_delays(lines, col="value"):
    """Batch time and execution seconds of every duration line, with its other columns.

    Counted from the end of the line, token 5 is the batch and token 2 the seconds.
    """
    tokens = F.split(F.trim(F.col(col)), r"\s+")
    return (
        lines.where(F.col(col).contains(DELAY_MARK))
        .withColumn("batch", F.try_element_at(tokens, F.lit(-5)))
        .withColumn("seconds", F.try_element_at(tokens, F.lit(-2)).cast("double"))
        .drop(col)
    )


def batches_with_data(lines, min_rows=10, max_total=None):
    """Batches that have a part file of more than ``min_rows`` lines.

    ``lines`` has one row per line with ``batch`` and ``file``. ``max_total`` also drops
    batches whose such files hold more lines together (a history run stores at most
    nodes * k). Column ``n`` is that total.
    """
    files = lines.groupBy("batch", "file").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows)
    totals = files.groupBy("batch").agg(F.sum("_n").alias("n"))
    return totals if max_total is None else totals.where(F.col("n") <= max_total)


def run_durations(delays, batches, on=("batch",)):
    """Durations of the batches that have data."""
    return delays.join(batches.select(*on).distinct(), list(on), "left_semi")


def duration_summary(durations, by, hot_rows=None):
    """Minimum, quartiles, maximum, mean and population deviation per group.

    Grouping by run gives one line per run, grouping by station count pools repetitions.
    """
    by = list(by)
    basic = durations.groupBy(*by).agg(
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
        F.avg("seconds").alias("avg"),
        F.stddev_pop("seconds").alias("std_dev"),
    )
    quartiles = quantiles(durations, by, "seconds", [0.25, 0.5, 0.75], hot_rows)
    return null_safe_join(basic, quartiles, by, "left").select(
        *by,
        "min",
        F.col("q0").alias("p25"),
        F.col("q1").alias("p50"),
        F.col("q2").alias("p75"),
        "max",
        "avg",
        "std_dev",
    )


def _unlisted(what):
    return F.raise_error(F.lit(f"{what} without a column of its own; use the long form"))


def run_averages(durations):
    """Average of every run, numbered from 1 per station count in order of the run."""
    averages = durations.groupBy("base", "run").agg(F.avg("seconds").alias("avg"))
    order = Window.partitionBy("base").orderBy("run")
    return averages.select("base", F.row_number().over(order).alias("no"), "avg")


def run_averages_wide(durations, n_runs):
    """The same side by side, as ``avg1 .. avgN``; more than ``n_runs`` runs are an error."""
    columns = [F.max(F.when(F.col("no") == i, F.col("avg"))).alias(f"avg{i}") for i in range(1, n_runs + 1)]
    wide = run_averages(durations).groupBy("base").agg(F.max("no").alias("_runs"), *columns)
    base = F.when(F.col("_runs") <= n_runs, F.col("base")).otherwise(_unlisted("a run"))
    return wide.select(base.alias("base"), *[f"avg{i}" for i in range(1, n_runs + 1)])


def history_averages(durations):
    """Average duration per history length and station count."""
    return durations.groupBy("k", "base").agg(F.avg("seconds").alias("avg"))


def history_pivot(durations, bases=STATION_COUNTS):
    """The same with a column per station count, and their mean; other counts are an error."""
    listed = F.coalesce(F.col("base").isin(list(bases)), F.lit(False))
    averages = history_averages(durations)
    averages = averages.withColumn("avg", F.when(listed, F.col("avg")).otherwise(_unlisted("a station count")))
    return averages.groupBy("k").agg(
        *[F.max(F.when(F.col("base") == b, F.col("avg"))).alias(f"base_{b}") for b in bases],
        F.avg("avg").alias("avg"),
    )


def topology_averages(durations):
    """Average duration per topology type."""
    return durations.groupBy("topology").agg(F.avg("seconds").alias("avg"))


def run_series(durations, order=("batch",), hot_rows=None):
    """Durations numbered by batch within their run: ``idx, run, seconds``."""
    series = running_weight(durations, ["run"], order, "idx", hot_rows=hot_rows)
    return series.select("idx", "run", "seconds")


def run_series_wide(durations, runs, order=("batch",), hot_rows=None):
    """The same side by side: row i holds the i-th batch of every run; other runs are an error."""
    listed = F.coalesce(F.col("run").isin(list(runs)), F.lit(False))
    run = F.when(listed, F.col("run")).otherwise(_unlisted("a run"))
    series = run_series(durations, order, hot_rows).withColumn("run", run)
    return series.groupBy("idx").pivot("run", list(runs)).agg(F.first("seconds"))


def duration_by_k(durations):
    """The distinct durations and the history length they belong to."""
    return durations.select("seconds", "k").distinct()
