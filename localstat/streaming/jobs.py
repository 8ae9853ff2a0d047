"""Streaming jobs: the batch functions applied per micro-batch.

A micro-batch plays the role of a batch. Sinks are folders keyed by the micro-batch id
and overwritten as a whole, so a repeated micro-batch leaves the same result.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQueryListener

from localstat import schemas
from localstat.functions.scalars import score
from localstat.operators.montecarlo import random_sets, spatial_lisa_mc, temporal_mc_from_history
from localstat.operators.stats import lisa_from_z, spatial_lisa
from localstat.operators.temporal import history_arrays, lisa_from_history
from localstat.plans.scale import materialise, sized, staged, staging
from localstat.sinks import BATCHES, LISA, POSITIONS, SETS, VALUES, write_batch
from localstat.streaming.state import RunState


def _stored(results, name):
    """Results by the name they are stored under; a single frame goes under ``name``."""
    return results if isinstance(results, dict) else {name: results}


def _whole_batches(df, sink, batch_id):
    """Fail when a batch of this micro-batch was already seen in an earlier one.

    Its statistics would be computed twice, each time on part of the readings. The batches
    of each micro-batch are kept as a table of their own.
    """
    spark = df.sparkSession
    write_batch(df.select("batch").distinct(), sink, BATCHES, batch_id)
    seen = spark.read.parquet(f"{sink}/{BATCHES}")
    now = seen.where(F.col("batch_id") == batch_id).select("batch")
    again = seen.where(F.col("batch_id") < batch_id).join(sized(now), "batch", "left_semi").limit(1).collect()
    if again:
        raise ValueError(f"batch {again[0].batch} is spread over several micro-batches")


def _with_batch(df, sink, batch_id):
    if "batch" not in df.columns:
        return df.withColumn("batch", F.lit(batch_id)).persist()
    df = df.persist()
    _whole_batches(df, sink, batch_id)
    return df


def stream_lisa(sdf, sink, checkpoint, fn, name=LISA, trigger=None):
    """Run ``fn(batch_df)`` on every micro-batch and store its result.

    ``fn`` returns a frame, stored under ``name``, or several as a dict of names. Rows without a
    ``batch`` column get the micro-batch id as their batch; a given batch must lie in one
    micro-batch, which is checked. The default trigger drains what is available and stops; the
    next micro-batch starts only after the previous one has finished. Tables staged by ``fn`` are
    removed after each micro-batch.
    """

    def run(df, batch_id):
        with staging(df.sparkSession):
            df = _with_batch(df, sink, batch_id)
            try:
                for key, result in _stored(fn(df), name).items():
                    write_batch(result, sink, key, batch_id)
            finally:
                df.unpersist()

    return (
        sdf.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_spatial_mc(sdf, edges, n_nodes, r, seed, sink, checkpoint, before=None, trigger=None):
    """Spatial statistic with its Monte Carlo position, and all it was made of.

    Stored are the readings, the random sets, the statistic and the positions of every
    micro-batch, so that the positions can be checked from the stored folders alone. The
    readings of a micro-batch (prepared by ``before``) and its ranks are computed once.
    """
    edges = staged(edges, "edges")

    def fn(df):
        obs = materialise(before(df) if before else df, "obs")
        ranked = materialise(spatial_lisa_mc(obs, edges, n_nodes, r, seed), "ranked")
        sets = random_sets(ranked.select("batch", "node"), n_nodes, r, seed)
        return {VALUES: obs, SETS: sets, LISA: ranked.select("batch", "node", "lisa"), POSITIONS: ranked}

    return stream_lisa(sdf, sink, checkpoint, fn, trigger=trigger)


def stream_window_lisa(sdf, edges, width, delay, sink, checkpoint, ts="ts", trigger=None):
    """Local statistic per event-time window.

    The stream state holds one partial mean per (window, node). A window leaves it as a
    whole once the watermark passes its end, and the statistic is computed on that. The newest
    window of a drained stream stays open, as more of it may come: it is written once a later
    reading (of any node, also an unknown one) moves the watermark past its end.
    """
    edges = staged(edges, "edges")
    closed = (
        sdf.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("_window"), "node")
        .agg(F.avg("value").alias("value"))
        .select(F.col("_window.start").alias("batch"), "node", "value")
    )
    return stream_lisa(closed, sink, checkpoint, lambda df: spatial_lisa(df, edges), trigger=trigger)


def stream_window_lisa_multi(sdf, edges, width, delay, sink, checkpoint, ts="ts", salts=16, trigger=None):
    """Local statistic of every reading per event-time window; a node may send several.

    The readings wait in the state of a stream-stream join for the moments of their window, which
    leave their own aggregation once the watermark passes its end. So all readings of a window
    come out of the join together, with its mean and deviation. The join is salted by node:
    ``salts`` copies of a window's one row of moments spread its readings over as many tasks.
    Further columns of the readings are kept; the newest windows stay open, as in
    :func:`stream_window_lisa`.
    """
    edges = staged(edges, "edges")
    rest = [c for c in sdf.columns if c not in (ts, "node", "value")]
    rows = sdf.withWatermark(ts, delay).withColumn("_window", F.window(ts, width))
    moments = rows.groupBy("_window").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    moments = moments.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The event time of the joined rows is that of the window alone.
    rows = rows.select("_window", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("_salt"), "node", "value", *rest)
    joined = rows.join(moments, ["_window", "_salt"]).select(
        F.col("_window.start").alias("batch"), "node", "value", *rest,
        score(F.col("value"), F.col("_mean"), F.col("_sd")).alias("z"),
    )
    return stream_lisa(joined, sink, checkpoint, lambda df: lisa_from_z(df, edges), trigger=trigger)


def stream_history(sdf, k, state, sink, checkpoint, order=("batch",), before=None, then=None, trigger=None):
    """Histories of the last ``k`` readings per node, kept across micro-batches.

    The state holds the last ``k`` readings of every node (:class:`RunState`). A micro-batch
    reads those of its own nodes from the version left by its predecessor, extends the
    histories with the same function as the batch job, and writes the nodes it touched as part of
    its own version, so a repeated micro-batch still finds its input. Nothing is gathered per node
    beyond ``k`` values, however many readings a node sends. ``order`` must be unique per node
    and increase from one micro-batch to the next. ``before`` prepares the readings of a
    micro-batch, ``then`` turns its histories into the statistic, or into several results by
    name. Histories are stored as values, results under their own names.
    """
    columns = list(dict.fromkeys([*order, "batch", "node", "value"]))

    def run(df, batch_id):
        spark = df.sparkSession
        df = df if "batch" in df.columns else df.withColumn("batch", F.lit(batch_id))
        kept = RunState(spark, state)
        with staging(spark):
            new = materialise((before(df) if before else df).withColumn("_new", F.lit(True)), "new")
            nodes = materialise(new.select("node").distinct(), "nodes")
            old = kept.read(batch_id - 1, nodes)
            if old is not None:
                new = new.unionByName(old.withColumn("_new", F.lit(False)), allowMissingColumns=True)
            latest = Window.partitionBy("node").orderBy(*[F.desc(c) for c in order])
            tail = new.select(*columns, F.row_number().over(latest).alias("_back"))
            kept.write(batch_id, tail.where(F.col("_back") <= k).drop("_back"))
            hist = history_arrays(new, k, order).where("_new").drop("_new")
            write_batch(hist, sink, VALUES, batch_id)
            if then:
                hist = spark.read.parquet(f"{sink}/{VALUES}/batch_id={batch_id}")
                for key, result in _stored(then(hist), LISA).items():
                    write_batch(result, sink, key, batch_id)

    return (
        sdf.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_temporal_lisa(sdf, edges, k, state, sink, checkpoint, anchor="oldest", before=None, trigger=None):
    """Temporal statistic of every micro-batch over histories kept across them."""
    edges = staged(edges, "edges")
    return stream_history(
        sdf, k, state, sink, checkpoint,
        before=before, then=lambda hist: lisa_from_history(hist, edges, anchor), trigger=trigger,
    )


def stream_temporal_mc(
    sdf, edges, n_nodes, k, r, seed, state, sink, checkpoint, scope="local", anchor="oldest", before=None, trigger=None
):
    """Temporal statistic and its Monte Carlo position, over histories kept across micro-batches.

    Stored are the histories, the statistic and the positions.
    """
    edges = staged(edges, "edges")

    def then(hist):
        found = temporal_mc_from_history(hist, edges, n_nodes, k, r, seed, scope, anchor)
        return {LISA: lisa_from_history(hist, edges, anchor), POSITIONS: found}

    return stream_history(sdf, k, state, sink, checkpoint, before=before, then=then, trigger=trigger)


class BatchMetrics(StreamingQueryListener):
    """Listener that appends a row per micro-batch to a table, for as long as queries run.

    Register it with ``spark.streams.addListener``. Unlike ``recentProgress`` the table keeps
    every micro-batch. Times are milliseconds; ``processing_start`` counts from the trigger's
    time ``submitted`` on, after the delay of finding and planning the input.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        spent = {k: int(v) for k, v in p.durationMs.items()}
        total, execution = spent.get("triggerExecution", 0), spent.get("addBatch", 0)
        delay = sum(spent.get(x, 0) for x in ("latestOffset", "getBatch", "queryPlanning"))
        row = (str(p.id), p.batchId, p.timestamp, p.numInputRows, delay, delay, delay + execution, execution, total)
        self.spark.createDataFrame([row], schemas.BATCH_METRICS).coalesce(1).write.mode("append").parquet(self.path)


def batch_metrics(spark, query):
    """Progress of a streaming query, one row per micro-batch that Spark still remembers.

    That is the last hundred or so; :class:`BatchMetrics` keeps a table of all.
    """

    def row(p):
        ms = p["durationMs"]
        return (
            p["batchId"],
            p["timestamp"],
            p["numInputRows"],
            ms.get("queryPlanning"),
            ms.get("addBatch"),
            ms.get("triggerExecution"),
        )

    rows = [row(p) for p in query.recentProgress]
    return spark.createDataFrame(rows, schemas.METRICS)
