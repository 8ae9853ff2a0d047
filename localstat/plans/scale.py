"""Helpers that keep plans safe at scale: staged tables, checked broadcasts and
exact per-group ranks and quantiles that do not need a group to fit in one task.
"""

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

# A table of at most this many narrow rows (about 100 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000
# A group of at most this many rows may be sorted by a single task.
HOT_ROWS = 1_000_000

_local_dirs = {}
_scope = threading.local()


def shared_dir(spark):
    """Folder for staged tables: below ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="localstat-")
        base = _local_dirs[app]
    return f"{base.rstrip('/')}/localstat-{app}"


def fresh_path(spark, name):
    folder = getattr(_scope, "folder", None) or shared_dir(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark):
    """Tables staged inside live until the end of the block; then their folder is removed.

    For work that repeats in one application, such as micro-batches. What is to stay has to
    be written elsewhere inside the block.
    """
    outer = getattr(_scope, "folder", None)
    _scope.folder = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scope.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _scope.folder = outer


def materialise(df, name="stage"):
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.is_staged = True
    return table


def staged(df, name="stage"):
    """``df`` itself if it came out of :func:`materialise`, else a staged copy of it.

    For inputs that are counted and joined several times, such as edges parsed from text.
    """
    return df if getattr(df, "is_staged", False) else materialise(df, name)


def is_small(staged, max_rows=None):
    """Whether a staged table may be broadcast; the count reads only file footers."""
    return staged.count() <= (BROADCAST_ROWS if max_rows is None else max_rows)


def sized(staged, max_rows=None):
    """Broadcast a staged table only when its row count is proven small.

    Larger tables stay unhinted: the planner shuffles, and adaptive execution
    splits skewed join partitions.
    """
    return F.broadcast(staged) if is_small(staged, max_rows) else staged


def group_sizes(df, by):
    """Rows in the biggest group and in all of them (one map-side combined count)."""
    row = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def null_safe_join(left, right, by, how="inner"):
    """Join on equal keys where null equals null; the key columns are those of ``left``."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(right[f"_r_{c}"])
    return left.join(right, same, how).drop(*[f"_r_{c}" for c in by])


def running_weight(df, by, order, name, weight=None, hot_rows=None):
    """Add the running sum of ``weight`` (default: 1, a row number) per group.

    Small groups use one window. When some group exceeds ``hot_rows`` the rows are
    range-partitioned on (group, order), so a hot group spreads over many tasks; each
    slice is numbered on its own and shifted by the total of the slices before it.
    Give ``order`` unique within a group for a repeatable numbering.
    """
    by, order = list(by), list(order)
    weight = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    upto = (Window.unboundedPreceding, Window.currentRow)
    largest, total = group_sizes(df, by)
    if largest <= hot_rows:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)
        return df.withColumn(name, F.sum(weight).over(frame))

    # The slice id depends on sampled range bounds, so it is fixed in a staged table.
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // hot_rows))
    slices = materialise(
        df.repartitionByRange(n, *by, *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    totals = slices.groupBy(*by, "_slice").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *by, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    frame = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(*upto)
    rows = slices.withColumn("_within", F.sum(weight).over(frame))
    joined = null_safe_join(rows, bases, [*by, "_slice"])
    return joined.withColumn(name, F.col("_base") + F.col("_within")).drop("_slice", "_base", "_within")


def quantiles(df, by, col, probs, hot_rows=None):
    """Exact linear-interpolation quantiles per group, as columns ``q0, q1, ...``.

    ``percentile`` keeps every distinct value of a group in one buffer. Beyond
    ``hot_rows`` distinct values per group the wanted ranks are looked up among running
    counts instead. Groups without a value have no row. The values are counted and staged
    once, whichever way follows.
    """
    by = list(by)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    values = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("_v")).count()
    values = materialise(values, "values")
    if group_sizes(values, by)[0] <= hot_rows:
        return values.groupBy(*by).agg(
            *[F.percentile("_v", F.lit(p), F.col("count")).alias(f"q{i}") for i, p in enumerate(probs)]
        )

    ranked = running_weight(values, by, ["_v"], "_upto", weight="count", hot_rows=hot_rows)
    sizes = values.groupBy(*by).agg(F.sum("count").alias("_n"))
    wanted = sizes.select(
        *by,
        F.posexplode(F.array(*[(F.col("_n") - 1) * F.lit(p) for p in probs])).alias("_q", "_at"),
    ).select(
        *by,
        "_q",
        F.explode(
            F.array(
                F.struct(
                    F.floor("_at").alias("rank"),
                    (1 - (F.col("_at") - F.floor("_at"))).alias("share"),
                ),
                F.struct(
                    (F.floor("_at") + 1).alias("rank"),
                    (F.col("_at") - F.floor("_at")).alias("share"),
                ),
            )
        ).alias("_w"),
    )
    wanted = materialise(wanted.where("_w.share > 0").select(*by, "_q", "_w.rank", "_w.share"))
    hits = (
        null_safe_join(ranked, sized(wanted), by)
        .where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("count")))
        .groupBy(*by)
    )
    return hits.agg(
        *[
            F.sum(F.when(F.col("_q") == i, F.col("_v") * F.col("share"))).alias(f"q{i}")
            for i in range(len(probs))
        ]
    )
