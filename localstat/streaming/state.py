"""Keyed state of a stream as a table of runs, of which a micro-batch writes only what it changed.

A version of the state is a list of runs, newest first, named in a small manifest. A run holds all
state rows of the keys that some micro-batches changed; the newest run that has a key holds its
state. So a micro-batch writes the keys it touched and a manifest, whatever the size of the
state. A new run absorbs the runs before it that are at most twice as large, which leaves a
number of runs logarithmic in the state, and rewrites every row a logarithmic number of times.

Runs are partitioned by a hash of the key, and a read opens only the buckets its keys fall into.

Version ``v`` is made from version ``v - 1``. The runs of both stay until version ``v + 1`` is
written, so a micro-batch that is repeated after a failure finds its input as it was and
leaves the same result.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from localstat.plans.scale import sized
from localstat.streaming.files import drop_others

BUCKETS = 64
# A run absorbs its predecessor if that has at most so many times its rows.
ABSORB = 2
MANIFEST = "place INT, run STRING, rows BIGINT"


class RunState:
    """State rows by ``key`` below the folder ``path``; versions are the ids of micro-batches."""

    def __init__(self, spark, path, key="node", buckets=BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def runs(self, version):
        """``(run, rows)`` of a version, newest first; none before the first version."""
        if version < 0:
            return []
        found = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/{version}").orderBy("place").collect()
        return [(r.run, r.rows) for r in found]

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, names, keys=None):
        """The newest state of each key (of ``keys``) in some runs, newest first."""
        wanted = None
        if keys is not None:  # at most one row for each bucket
            wanted = [r.bucket for r in keys.select(self._bucket().alias("bucket")).distinct().collect()]
        rows = None
        for place, name in enumerate(names):
            run = self.spark.read.parquet(f"{self.path}/runs/{name}")
            run = run if wanted is None else run.where(F.col("bucket").isin(wanted))
            run = run.drop("bucket").withColumn("_place", F.lit(place))
            rows = run if rows is None else rows.unionByName(run, allowMissingColumns=True)
        if keys is not None:
            rows = rows.join(sized(keys), self.key, "left_semi")
        if len(names) > 1:  # a window over the state of one key in a few runs
            rows = rows.withColumn("_newest", F.min("_place").over(Window.partitionBy(self.key)))
            rows = rows.where("_place = _newest").drop("_newest")
        return rows.drop("_place")

    def read(self, version, keys):
        """State rows of the staged table ``keys`` in a version; None if there is no state yet."""
        names = [name for name, _ in self.runs(version)]
        return self._read(names, keys.select(self.key)) if names else None

    def _write(self, rows, name):
        rows = rows.withColumn("bucket", self._bucket()).hint("rebalance", F.col("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/runs/{name}")
        return self.spark.read.parquet(f"{self.path}/runs/{name}").count()

    def write(self, version, rows):
        """Make a version out of the one before: ``rows`` replace the state of the keys they have.

        Returns the number of rows written, absorbed ones included.
        """
        if rows.isEmpty():
            self._commit(version, self.runs(version - 1))
            return 0
        before, name = self.runs(version - 1), f"{version}"
        written = size = self._write(rows, name)
        merged = [name]
        while before and before[0][1] <= ABSORB * size:
            merged.append(before[0][0])
            size += before.pop(0)[1]
        if len(merged) > 1:
            name = f"{version}-merged"
            size = self._write(self._read(merged), name)
            written += size
        self._commit(version, [(name, size), *before])
        return written

    def _commit(self, version, runs):
        rows = [(place, *run) for place, run in enumerate(runs)]
        table = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        table.write.mode("overwrite").json(f"{self.path}/manifest/{version}")
        self._clean(version)

    def _clean(self, version):
        """Drop the runs that neither this version nor its predecessor names, and older manifests."""
        keep = {run for v in (version, version - 1) for run, _ in self.runs(v)}
        drop_others(self.spark, f"{self.path}/runs", keep.__contains__)
        drop_others(self.spark, f"{self.path}/manifest", lambda name: int(name) >= version - 1)
