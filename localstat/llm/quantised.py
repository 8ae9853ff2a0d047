"""Near-duplicate vectors by product quantisation over coarse inverted lists.

1. Equal vectors form a class of one entry with a weight. Nothing below depends on how many
   rows share a vector.
2. Coarse centroids and the codebooks of ``PARTS`` subspaces are fitted on about ``SAMPLE``
   entries picked by hash (a bounded sample; at most twice as many). There are about
   ``2 * sqrt(entries)`` lists, at most ``MOST_LISTS``.
3. Every entry is posted in the list of its nearest centroid as residual codes, one byte a
   subspace. Every entry is also a query. It probes all lists whose centroid is at most
   ``margin`` less similar than the nearest one. The margin is fitted, too: partners at exactly
   the threshold are made for sampled entries, and all but ``MISSED`` of them lie in a list
   that one of the two probes. The margin bounds similarity, not the number of probes.
4. In a list, the similarity of a query to each posting is read from tables: the query's products
   with all codes of each subspace, looked up by the codes. With x the posting, c its decoded
   form, p = x.c and q the length of c beyond x, a query at cosine t or more has a product of at
   least ``t p - sqrt(1 - t^2) q`` with c. Postings carry that bound, so the tables drop no link.
5. What passes is ranked by the exact cosine in double precision.

Lists and queries meet in blocks of at most ``BLOCK`` entries a side. A block returns at most a
row for each of its entries: the weight linked to it, and one entry it is connected with, so no
pair becomes a row. A pair may be found from both sides: then each side counts for its query
only. A posting whose query lies in a list that the posting does not probe counts for itself as
well. The work inside a group of near copies that differ grows with the square of its size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.components import components
from localstat.llm.shipping import ship
from localstat.plans.scale import materialise, sized

SAMPLE, MOST_LISTS = 20_000, 4096
PARTS, CODES, ROUNDS = 8, 256, 6
MISSED = 1e-4
BLOCK, CHUNK = 4096, 256
SEED = 20240313


def _nearest(x, centres):
    """Number of the nearest centre of each row by distance, in bounded blocks."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[lo : lo + 4096] @ centres.T - half).argmax(1) for lo in range(0, len(x), 4096)])


def clustered(x, k, rng):
    """``k`` centres of the rows by Lloyd's rounds; a centre that loses its rows stays where it is."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres


def unit(x):
    """Rows of unit length in double precision; no row is zero."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # the squares of very small and large ones would be lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Lists, codebooks and margin for vectors of one width; small enough to be sent to every task."""

    def __init__(self, sample, entries, threshold):
        rng = np.random.default_rng(SEED)
        x = unit(sample).astype(np.float32)
        n_lists = min(1 << int(np.log2(2 * np.sqrt(entries))), MOST_LISTS, max(len(x) // 4, 1))
        self.threshold, self.width = threshold, x.shape[1]
        self.means = clustered(x, n_lists, rng)
        self.centres = self.means / np.maximum(np.linalg.norm(self.means, axis=1, keepdims=True), 1e-9)
        rest = self._parts(x - self.means[self.scores(x).argmax(1)])
        self.books = np.stack([clustered(rest[:, s], min(CODES, len(x)), rng) for s in range(PARTS)])
        self.margin = self._margin(x[rng.permutation(len(x))[:8192]], rng)

    def _parts(self, x):
        """Rows cut into subspaces of one width; the last ones are filled with zeros."""
        size = -(-self.width // PARTS)
        out = np.zeros((len(x), PARTS * size), np.float32)
        out[:, : self.width] = x
        return out.reshape(len(x), PARTS, size)

    def _margin(self, x, rng):
        w = rng.normal(size=x.shape)
        w -= (w * x).sum(1, keepdims=True) * x
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        y = (self.threshold * x + np.sqrt(1 - self.threshold**2) * w).astype(np.float32)
        sx, sy, row = self.scores(x), self.scores(y), np.arange(len(x))
        gaps = np.minimum(sx.max(1) - sx[row, sy.argmax(1)], sy.max(1) - sy[row, sx.argmax(1)])
        return float(np.quantile(gaps, 1 - MISSED)) * 1.05 + 1e-6

    def scores(self, x):
        return x @ self.centres.T

    def post(self, vectors):
        """List, probes, codes and least product of a linked query, for each row."""
        exact = unit(vectors)
        x = exact.astype(np.float32)
        s = self.scores(x)
        home = s.argmax(1)
        probes = s >= (s.max(1) - self.margin)[:, None]
        parts = self._parts(x - self.means[home])
        codes = np.stack([_nearest(parts[:, k], self.books[k]) for k in range(PARTS)], 1)
        decoded = self._parts(self.means[home]) + np.stack([self.books[k][codes[:, k]] for k in range(PARTS)], 1)
        decoded = decoded.reshape(len(x), -1)[:, : self.width].astype(np.float64)
        p, size = (exact * decoded).sum(1), np.linalg.norm(decoded, axis=1)
        q = np.sqrt(np.maximum(size**2 - p**2, 0))
        least = self.threshold * p - np.sqrt(1 - self.threshold**2) * q
        return home, probes, codes.astype(np.uint8), np.where(p >= 0, least, -size) - 1e-4

    def passing(self, x, home, codes, least):
        """Which postings of list ``home`` (columns) may be linked with unit queries ``x`` (rows)."""
        parts = self._parts(x)
        total = np.repeat((x @ self.means[home])[:, None], len(codes), 1)
        for k in range(PARTS):
            total += (parts[:, k] @ self.books[k].T).take(codes[:, k], axis=1)
        return total >= least[None, :]


def _cleaned(kind):
    """Vectors as bytes and their width; null where they take no part."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            out, width = [], []
            for vec in column:
                x = None if not vec.is_valid else vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                out.append((x + 0.0).astype(kind).tobytes() if good else None)
                width.append(len(x) if good else None)
            columns = [batch.column(0), pa.array(out, pa.binary()), pa.array(width, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vec", "width"])

    return run


def _vectors(column, kind, width):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _postings(model, kind):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            home, probes, codes, least = model.post(_vectors(batch.column(2), kind, model.width))
            row, lists = np.nonzero(probes)
            first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]).astype(np.int32)
            columns = [
                *batch.columns, pa.array(home.astype(np.int32)), pa.ListArray.from_arrays(pa.array(first), pa.array(lists.astype(np.int32))),
                pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(least.astype(np.float32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "weight", "vec", "home", "probes", "codes", "least"])

    return run


def forest(u, v, n):
    """Smallest number connected with each of ``n`` numbers by links ``(u, v)``."""
    label = np.arange(n)
    while True:
        low, before = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            return label


def _block(model, kind):
    """Linked weight and a connected entry of each entry of a block."""
    threshold, width = model.threshold, model.width

    def run(group):
        side = group.column("query").to_numpy(zero_copy_only=False)
        key, weight = group.column("key").to_numpy(), group.column("weight").to_numpy()
        vec, home = unit(_vectors(group.column("vec"), kind, width)), group.column("home").to_numpy()
        queries, posts = np.flatnonzero(side), np.flatnonzero(~side)
        counted, edges = np.zeros(len(key), np.int64), [np.zeros((2, 0), np.int64)]
        if len(queries) and len(posts):
            at = int(home[posts[0]])
            column = group.column("codes").combine_chunks().take(pa.array(posts)).to_pylist()
            codes = np.frombuffer(b"".join(column), np.uint8).reshape(len(posts), PARTS).astype(np.intp)
            least = group.column("least").to_numpy()[posts]
            probed = np.zeros((len(posts), len(model.centres)), bool)
            for k, own in enumerate(group.column("probes").combine_chunks().take(pa.array(posts)).to_pylist()):
                probed[k, own] = True
            x = vec[posts]
            for lo in range(0, len(queries), CHUNK):
                own = queries[lo : lo + CHUNK]
                r, c = np.nonzero(model.passing(vec[own].astype(np.float32), at, codes, least))
                if len(r) > 0.1 * len(own) * len(posts):
                    near = (vec[own] @ x.T)[r, c] >= threshold
                else:
                    near = np.zeros(len(r), bool)
                    for k in range(0, len(r), 1 << 15):
                        part = slice(k, k + (1 << 15))
                        near[part] = (vec[own[r[part]]] * x[c[part]]).sum(1) >= threshold
                near &= key[own[r]] != key[posts[c]]
                q, p = own[r[near]], posts[c[near]]
                counted += np.bincount(q, weight[p], len(key)).astype(np.int64)
                alone = ~probed[c[near], home[q]]  # the posting does not find this query itself
                counted += np.bincount(p[alone], weight[q[alone]], len(key)).astype(np.int64)
                first = np.full(len(key), len(key))
                np.minimum.at(first, q, p)  # a query and all it is linked with hang on its first partner
                edges += [np.stack([q, first[q]]), np.unique(np.stack([p, first[q]]), axis=1)]
                edges[1:] = [np.unique(np.concatenate(edges[1:], 1), axis=1)]
        u, v = np.concatenate(edges, 1)
        root = forest(u, v, len(key))
        out = np.flatnonzero((counted > 0) | (root != np.arange(len(key))))
        return pa.table({"key": key[out], "n": counted[out], "root": key[root[out]]})

    return run


def _sample(entries, n, kind, width):
    """Bounded sample of the entries for the fit, picked by a hash of the vector."""
    every = -(-n // SAMPLE)
    rows = entries.where(F.pmod(F.xxhash64("vec"), F.lit(every)) == 0).select("vec").limit(2 * SAMPLE)
    found = rows.toArrow().column("vec").combine_chunks()
    if not len(found):  # few entries, none of which the hash picks
        found = entries.select("vec").limit(SAMPLE).toArrow().column("vec").combine_chunks()
    return np.array(sorted(map(tuple, _vectors(found, kind, width))))


def _met(postings, model, kind):
    """Results of all blocks: ``key, n, root``."""
    columns = ["key", "weight", "vec", "home"]
    spare = {"codes": "binary", "least": "float", "probes": "array<int>"}
    own = postings.select(F.col("home").alias("list"), F.lit(False).alias("query"), *columns, *spare)
    looked = postings.withColumn("list", F.explode("probes")).select(
        "list", F.lit(True).alias("query"), *columns, *[F.lit(None).cast(t).alias(c) for c, t in spare.items()]
    )
    # Blocks per side and list: a table of as many rows as there are lists.
    count = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    asked = count(postings.select(F.explode("probes").alias("list")), "n_query")
    blocks = sized(materialise(count(own, "n_own").join(asked, "list"), "blocks"))
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = own.join(blocks, "list").withColumn("i", mine("n_own")).withColumn("j", every("n_query"))
    looked = looked.join(blocks, "list").withColumn("j", mine("n_query")).withColumn("i", every("n_own"))
    both = own.unionByName(looked).drop("n_own", "n_query")
    return both.groupBy("list", "i", "j").applyInArrow(_block(model, kind), "key bigint, n bigint, root bigint")


def near_duplicates(vectors, threshold=0.9):
    """Links and groups of ``vectors(vec_id, embedding)`` whose cosine is at least ``threshold``.

    Returns one row per row of ``vectors``: ``vec_id, n_links`` (other rows linked directly),
    ``component_id`` (the smallest vec_id reachable by links, itself included) and ``kept``
    (``vec_id = component_id``). Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing; vectors of different widths are not linked with each other.
    Repeated rows are vectors of their own and linked. Rows without a vec_id link with nothing and
    are kept, with a null component. An empty table gives an empty one; other columns are ignored.

    No link below the threshold is returned. A link is missed when the two lie in lists that
    neither probes, with a probability of about ``MISSED`` for partners at the threshold in a
    random direction; equal vectors are always linked.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")
    ship(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64  # as the vectors are given: nothing is lost on the way
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>"))
    rows = rows.mapInArrow(_cleaned(kind), "vec_id bigint, vec binary, width int")
    rows = materialise(rows.withColumn("digest", F.md5("vec")), "vectors")
    members = rows.where("vec_id is not null and vec is not null").groupBy("width", "digest")
    entries = members.agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    # The numbers of entries are fixed by the written table; ids may repeat with other vectors.
    entries = materialise(entries.withColumn("key", F.monotonically_increasing_id()), "entries")

    found = None
    for width, n in entries.groupBy("width").count().orderBy("width").collect():
        own = entries.where(F.col("width") == width).select("key", "weight", "vec")
        model = Quantiser(_sample(own, n, kind, width), n, threshold)
        schema = "key bigint, weight bigint, vec binary, home int, probes array<int>, codes binary, least float"
        postings = materialise(own.mapInArrow(_postings(model, kind), schema), "postings")
        met = _met(postings, model, kind)
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = entries.select("key", F.lit(0).cast("bigint").alias("n"), F.col("key").alias("root"))
    found = materialise(found, "found")
    linked = found.groupBy("key").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    groups = groups.withColumnRenamed("id", "key")
    entry = entries.select("digest", "key", "least_id", "weight").join(linked, "key", "left").join(groups, "key", "left")
    entry = materialise(entry.withColumn("component", F.coalesce("component", "key")), "linked")
    least = entry.groupBy("component").agg(F.min("least_id").alias("component_id"))
    entry = entry.join(sized(materialise(least, "least")), "component").select(
        "digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    rows = rows.join(sized(materialise(entry, "entry")), "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
