"""Batches that stay open over many micro-batches, and close by a watermark.

Each micro-batch adds a part: what it brought for the open batches, reduced to rows that can be
merged later, such as moments. No part is rewritten. Once the watermark (the latest time seen less
a delay) passes the end of a batch, its rows of all parts are merged, its results are written, and
parts without an open batch are dropped. So results do not depend on how the readings were cut
into micro-batches. What a micro-batch looks up is a manifest with the watermark and the parts
of open batches; batches that are closed leave nothing behind.

Readings that come after their batch has closed are stored under ``LATE`` and change nothing.
Version ``v`` of the manifest is made from ``v - 1``, whose parts stay until ``v + 1``, so a
repeated micro-batch gives the same results.
"""

from pyspark.sql import functions as F

from localstat.operators.moments import lisa_of_nodes, lisa_of_readings, merged, node_moments
from localstat.plans.scale import materialise, staged, staging
from localstat.sinks import LATE, LISA, write_batch
from localstat.streaming.files import drop_others

MANIFEST = "watermark BIGINT, part BIGINT, last BIGINT, kept ARRAY<STRING>"


class OpenBatches:
    """Parts of open batches below a folder."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def manifest(self, version):
        """The watermark (null at the start) and ``(part, end of its last batch, names)`` of the open parts."""
        if version < 0:
            return None, []
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/{version}").collect()
        parts = [(r.part, r.last, r.kept) for r in rows if r.part is not None]
        return rows[0].watermark, sorted(parts)

    def _save(self, version, watermark, parts):
        rows = [(watermark, *p) for p in parts] or [(watermark, None, None, None)]
        table = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        table.write.mode("overwrite").json(f"{self.path}/manifest/{version}")

    def add(self, version, tables, last):
        """Write the tables of a part; rows have the end of their batch as ``closes``."""
        for name, rows in tables.items():
            rows = rows.hint("rebalance", F.col("closes"))
            rows.write.mode("overwrite").partitionBy("closes").parquet(f"{self.path}/parts/{version}/{name}")
        return version, last, list(tables)

    def between(self, parts, name, low, high):
        """Rows of a table whose batches close after ``low`` and not after ``high``; None if there are none."""
        rows = None
        for part, _, kept in parts:
            if name in kept:
                own = self.spark.read.parquet(f"{self.path}/parts/{part}/{name}").where(F.col("closes") <= high)
                own = own if low is None else own.where(F.col("closes") > low)
                rows = own if rows is None else rows.unionByName(own)
        return None if rows is None else rows.drop("closes")

    def commit(self, version, watermark, parts):
        """Name the parts that stay; drop those that no manifest in use names."""
        open_ = [p for p in parts if watermark is None or p[1] > watermark]
        self._save(version, watermark, open_)
        keep = {str(p[0]) for v in (version, version - 1) for p in self.manifest(v)[1]}
        drop_others(self.spark, f"{self.path}/parts", keep.__contains__)
        drop_others(self.spark, f"{self.path}/manifest", lambda name: int(name) >= version - 1)


def stream_open_batches(sdf, time, closes, delay, keep, fn, state, sink, checkpoint, trigger=None):
    """Run ``fn`` on every batch once it is whole, however its readings are spread.

    ``time`` and ``closes`` are bigint columns of a reading: when it was taken, and when its batch
    is over. A batch closes once a reading later than ``closes + delay`` was seen. ``keep`` names
    functions that reduce the readings of a micro-batch (which have the column ``closes``, to be
    kept as well) to a mergeable table; ``fn`` gets a dict of these tables with all rows of the
    closed batches and returns the result, or several by name. The newest batches stay open
    until later readings arrive.
    """

    def run(df, version):
        spark = df.sparkSession
        batches = OpenBatches(spark, state)
        with staging(spark):
            rows = materialise(df.withColumns({"_time": time, "closes": closes}), "new")
            before, parts = batches.manifest(version - 1)
            late = rows.where("false") if before is None else rows.where(F.col("closes") <= before)
            write_batch(late.drop("_time", "closes"), sink, LATE, version)
            rows = rows if before is None else rows.where(F.col("closes") > before)
            seen = rows.agg(F.max("_time").alias("time"), F.max("closes").alias("last")).first()
            watermark = before
            if seen.last is not None:
                rows = rows.drop("_time")
                parts = [*parts, batches.add(version, {k: reduce(rows) for k, reduce in keep.items()}, seen.last)]
                latest = seen.time - delay
                watermark = latest if before is None else max(before, latest)
            if watermark is not None and watermark != before:
                closed = {name: batches.between(parts, name, before, watermark) for name in keep}
                if all(t is not None for t in closed.values()):
                    found = fn({name: materialise(t, name) for name, t in closed.items()})
                    for key, result in (found if isinstance(found, dict) else {LISA: found}).items():
                        write_batch(result, sink, key, version)
            batches.commit(version, watermark, parts)

    return (
        sdf.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_open_lisa(sdf, edges, time, closes, delay, state, sink, checkpoint, readings="mean", trigger=None):
    """Spatial statistic of batches that may be spread over any number of micro-batches.

    ``readings='mean'``: the mean of a node's readings is its reading, and moments per (batch,
    node) are all that is kept. ``'each'``: every reading has a result; the readings of open
    batches are kept beside the moments, and joined once.
    """
    if readings not in ("mean", "each"):
        raise ValueError("readings is 'mean' or 'each'")
    edges = staged(edges, "edges")
    keep = {"moments": lambda df: node_moments(df, ["closes", "batch", "node"])}
    if readings == "each":
        keep["readings"] = lambda df: df

    def fn(tables):
        nodes = merged(tables["moments"], ["batch", "node"])
        if readings == "mean":
            return lisa_of_nodes(nodes, edges)
        return lisa_of_readings(tables["readings"], nodes, edges)

    return stream_open_batches(sdf, time, closes, delay, keep, fn, state, sink, checkpoint, trigger)
