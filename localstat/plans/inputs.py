"""The given tables seen as readings, graphs, durations and streams."""

from pyspark.sql import functions as F

from localstat.operators.stats import standardise
from localstat.operators.temporal import history_arrays
from localstat.operators.topology import grid_edges
from localstat.plans.scale import materialise
from localstat.sources.streams import stream_observations

WIDTH, K, SEED = 5, 4, 42


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark, sf_dir, name):
    """The table as a stream; the glob also matches a table that is a single file."""
    schema = table(spark, sf_dir, name).schema
    return stream_observations(spark, f"{sf_dir}/{name}.parque[t]", schema)


def as_readings(events):
    return events.select(
        "event_id",
        "ts",
        F.col("ts").cast("date").alias("batch"),
        (F.col("user_id") + 1).alias("node"),
        "value",
    )


def readings(spark, sf_dir):
    """One reading per event: the day is the batch, the user is the node."""
    return as_readings(table(spark, sf_dir, "events"))


def daily(rows):
    return rows.groupBy("batch", "node").agg(F.avg("value").alias("value"))


def obs(spark, sf_dir):
    """Daily mean per user, staged: the events are read and shuffled once, however many
    passes an operator makes over the readings."""
    return materialise(daily(readings(spark, sf_dir)), "obs")


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("node")).distinct()


def grid(spark, sf_dir):
    return grid_edges(nodes(spark, sf_dir), WIDTH)


def edges(spark, sf_dir):
    """The grid as a staged table, so that joins know its size."""
    return materialise(grid(spark, sf_dir), "edges")


def scores(spark, sf_dir):
    return standardise(obs(spark, sf_dir)).select("batch", "node", "z")


def histories(spark, sf_dir):
    return history_arrays(obs(spark, sf_dir), K)


def grouped_obs(spark, sf_dir):
    """All events dealt to 15 nodes: a topology small enough to enumerate its sets."""
    rows = table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("batch"), (F.col("user_id") % 15 + 1).alias("node"), "value"
    )
    return daily(rows)


def durations(spark, sf_dir):
    """Every event as a batch duration of a run."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("batch"),
        F.col("event_type").alias("run"),
        F.element_at(F.array(*[F.lit(b) for b in (1, 2, 4, 8, 16)]), (user % 5 + 1).cast("int"))
        .cast("bigint")
        .alias("base"),
        (F.floor(user / 5) % 5).alias("k"),
        F.element_at(
            F.array(F.lit("sparse"), F.lit("connected"), F.lit("dense")), (user % 3 + 1).cast("int")
        ).alias("topology"),
        F.col("value").alias("seconds"),
    )
