"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length, padded to a power of two
and pseudo-rotated by three rounds of random signs and a fast Hadamard transform. The hash of a
vector is the signed axis it lies nearest to. Each of ``TABLES`` tables has its own
signs; a query looks into the ``PROBES`` likeliest axes of each table, and everything found
there is ranked by the exact inner product in double precision.

A longer vector may have the larger product at a wider angle, where the hash rarely finds
it. So the index is cut into bands of lengths that differ by at most a factor of ``BAND``.
Inside a band the best products have the smallest angles, give or take the factor, so bands
that fill their slots are hashed by direction. Bands with fewer than ``FILLED`` rows a slot,
such as the few longest vectors or a small table, are ranked against all queries. A query
that still finds fewer entries than there are is ranked against the whole index.

Index rows and query probes meet by slot (table and axis). Full slots are cut into blocks
on either side, so a task never holds more than ``BLOCK`` vectors of each. Equal vectors
are one entry with its ``k + 1`` smallest ids, which is all a result can use, so a vector
that a third of all rows share is no hot slot.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from localstat.llm.shipping import ship
from localstat.plans.scale import materialise, sized

TABLES, PROBES = 8, 14
BLOCK = 4096
SEED = 20240229
BAND = 1.1  # largest ratio of the lengths of a band
FILLED = 8  # rows a slot, on average, from which a band is hashed
SCAN = -1  # the slot of the rows that all queries are ranked against


def _padded(width):
    return 1 << max(1, (width - 1).bit_length())


def hadamard(x):
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    x, width, step = np.array(x, np.float32), x.shape[1], 1
    while step < width:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
        step *= 2
    return x / np.float32(np.sqrt(width))


def rotated(x, table):
    """Rows after the pseudo-rotation of a table."""
    signs = np.random.default_rng((SEED, table)).integers(0, 2, (3, x.shape[1])) * 2 - 1
    for row in signs.astype(np.float32):
        x = hadamard(x * row)
    return x


def axes(x, table, probes=1):
    """The ``probes`` nearest signed axes of each row, nearest first: axis, plus width if negative."""
    y = rotated(x, table)
    both = np.concatenate([y, -y], 1)
    probes = min(probes, both.shape[1])
    if probes == 1:
        return both.argmax(1)[:, None]
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, 1), axis=1), 1)


def prepared(x):
    """Unit rows, padded to a power of two."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # the squares of the largest doubles would overflow
    out = np.zeros((len(x), _padded(x.shape[1])), np.float32)
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _slots(width, kind, probes):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), kind).reshape(len(batch), width)
            unit = prepared(x)
            for table in range(TABLES):
                near = axes(unit, table, probes)
                slot = (near + table * 2 * unit.shape[1]).astype(np.int32)
                for k in range(near.shape[1]):
                    columns = [batch.column(0), batch.column("vec"), pa.array(slot[:, k])]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "vec", "slot"])

    return run


def _rank(width, kind, top):
    """Best candidates of each query of a block by exact inner product."""

    def run(group):
        side = group.column("query").to_numpy()
        key = group.column("key").to_numpy()
        vec = np.frombuffer(b"".join(group.column("vec").to_pylist()), kind).reshape(len(group), width)
        vec = vec.astype(np.float64)
        q, x, q_key, x_key = vec[side], vec[~side], key[side], key[~side]
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(q) and len(x):
            rows, found = [], []
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ x.T
                if len(x) > top:  # everything that may tie with the last one stays
                    least = np.partition(s, len(x) - top, axis=1)[:, len(x) - top]
                    r, c = np.nonzero(s >= (least - 1e-9 * np.abs(least))[:, None])
                else:
                    r, c = (v.ravel() for v in np.indices(s.shape))
                rows.append(r + lo)
                found.append(c)
            rows, found = np.concatenate(rows), np.concatenate(found)
            out = [q_key[rows], x_key[found], (q[rows] * x[found]).sum(1)]
        return pa.table({"query_key": out[0], "key": out[1], "score": out[2]})

    return run


def _dealt(rows, other, n_mine, n_other):
    """Block number of each row of one side, and one copy for each block of the other side."""
    mine = F.pmod(F.xxhash64("key"), F.coalesce(n_mine, F.lit(1)).cast("bigint"))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(n_other, F.lit(1)).cast("bigint") - 1))
    return rows.withColumn("own", mine).withColumn(other, copies)


def _met(own, looked, index, width, kind, k):
    """The ``k + 1`` best ``query_key, score, vec_id`` of index rows and queries that share a slot."""
    # Blocks per slot: a table of TABLES x axes rows.
    count = lambda rows, name: rows.groupBy("slot").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias(name))
    blocks = materialise(count(own, "n_own").join(count(looked, "n_query"), "slot"), "blocks")
    meet = sized(blocks)
    left = _dealt(own.join(meet, "slot"), "other", F.col("n_own"), F.col("n_query"))
    right = _dealt(looked.join(meet, "slot"), "other", F.col("n_query"), F.col("n_own"))
    left = left.select("slot", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(False).alias("query"), "key", "vec")
    right = right.select("slot", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(True).alias("query"), "key", "vec")
    ranked = left.unionByName(right).groupBy("slot", "i", "j").applyInArrow(
        _rank(width, kind, k + 1), "query_key bigint, key bigint, score double"
    )
    # Entries stand for their smallest id; the k + 1 best hold what any query of the key can use.
    entry = index.select("key", "ids")
    ranked = ranked.distinct().join(entry, "key").withColumn("least", F.col("ids")[0])
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "least")
    ranked = ranked.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ranked = ranked.select("query_key", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    ranked = ranked.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    return ranked.select("query_key", "score", "vec_id")


def search(vectors, queries, k=20, probes=PROBES):
    """The ``k`` nearest found of ``vectors(vec_id, embedding)`` for each of ``queries``.

    ``queries`` are rows of the same columns. Returns ``query_id, rank, vec_id, score``:
    largest inner product first, ties to the smaller id; fewer rows if there are fewer
    candidates. A row with the query's own id is no candidate. Vectors that are null, zero,
    hold a null or non-finite component, have no id, or are not of the most common width take
    no part. Repeated rows count once; other columns are ignored; without vectors the result
    is empty.
    """
    ship(vectors.sparkSession)
    single = all(r.schema["embedding"].dataType.elementType.typeName() == "float" for r in (vectors, queries))
    kind = np.float32 if single else np.float64  # as the vectors are given: nothing is lost on the way
    vectors, queries = _usable(vectors), _usable(queries)
    widths = vectors.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), "width").first()
    width = common.width if common else 1

    def classes(rows, name):
        # Rounded, so that unit vectors lie inside a band, not on the edge of two.
        band = F.floor(F.log("norm") / float(np.log(BAND)) + 0.5).alias("band")
        rows = rows.where(F.size("vec") == width).select("vec_id", "vec", band).distinct()
        first = Window.partitionBy("vec").orderBy("vec_id")
        kept = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        found = kept.groupBy("vec", "band").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        return materialise(_as_bytes(found.withColumn("key", F.xxhash64("vec")), width, kind), name)

    index = classes(vectors, "index")
    asked = queries.where(F.size("vec") == width).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("query_key"), "vec"
    )
    distinct = asked.select("vec").distinct().withColumn("key", F.xxhash64("vec")).withColumns(
        {"band": F.lit(0).cast("bigint"), "ids": F.array(F.lit(0).cast("bigint"))}
    )
    distinct = materialise(_as_bytes(distinct, width, kind), "queries")

    schema = "key bigint, vec binary, slot int"
    scan = F.lit(SCAN).alias("slot")
    bands = materialise(index.groupBy("band").agg((F.count("*") < FILLED * 2 * _padded(width)).alias("scanned")), "bands")
    banded = index.join(sized(bands), "band")
    hashed = banded.where("not scanned").select("key", "vec").mapInArrow(_slots(width, kind, 1), schema)
    probed = distinct.select("key", "vec").mapInArrow(_slots(width, kind, probes), schema)
    own = hashed.unionByName(banded.where("scanned").select("key", "vec", scan))
    looked = probed.unionByName(distinct.select("key", "vec", scan))
    ranked = materialise(_met(own, looked, index, width, kind, k), "ranked")

    there = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    hits = ranked.groupBy("query_key").count().withColumnRenamed("query_key", "key")
    short = distinct.join(hits, "key", "left").where(F.coalesce("count", F.lit(0)) < min(k + 1, there))
    short = materialise(short.select("key", "vec"), "short")
    if short.count():
        again = _met(index.select("key", "vec", scan), short.select("key", "vec", scan), index, width, kind, k)
        whole = short.select(F.col("key").alias("query_key"))
        ranked = ranked.join(sized(whole), "query_key", "left_anti").unionByName(again)
        ranked = materialise(ranked, "ranked")
    rows = asked.select("query_id", "query_key").distinct().join(ranked, "query_key").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")


def _usable(rows):
    vec = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and vec is not null").where(finite)
    # Squares of parts of the largest component neither underflow nor overflow.
    rows = rows.withColumn("most", F.array_max(F.transform("vec", F.abs))).where("most > 0")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    return rows.withColumn("norm", F.col("most") * F.sqrt(square)).drop("most")


def _as_bytes(rows, width, kind):
    """Column ``vec`` as little-endian floats or doubles."""

    def run(batches):
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().reshape(len(batch), width).astype(kind)
            vec = pa.array([row.tobytes() for row in flat], pa.binary())
            columns = [batch.column(1), vec, batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "vec", "ids", "band"])

    return rows.select("vec", "key", "ids", "band").mapInArrow(run, "key bigint, vec binary, ids array<bigint>, band bigint")
