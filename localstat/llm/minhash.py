"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Each text becomes its set of word shingles. Documents with equal sets form a class;
   only one representative per class goes on.
2. A signature has ``COORDINATES`` coordinates, each made of ``ROWS`` minima. A
   representative is posted under each (coordinate, value). Postings that nobody shares
   are dropped by a combined count.
3. Prefix and skip merging: a pair above the threshold shares at least ``floor`` of the
   coordinates (binomial bound, see :func:`match_floor`). So each representative skips its
   ``floor - 1`` longest lists; the others still hold one common entry of the pair.
   Skipped lists are only consulted when matches are counted.
4. Merging in two passes. Members are first paired with the smallest id of each list, at
   most one pair a posting, however long the list. Pairs whose signatures match often
   enough are confirmed on the full shingle sets, and the links contracted to components.
   Then lists that still hold several components are merged in full. Those of at most
   ``SHORT`` members are joined with themselves, which makes no more than ``SHORT / 2`` pairs
   a posting. Longer ones are merged in square tiles of about ``TILE`` members a side, dealt
   over all tasks: a first round counts signature matches and keeps the members with a
   partner of another component above the floor, a second one compares their full sets and
   returns a spanning forest of the exact links. No pair of a long list ever becomes a row,
   so a group of thousands of copies costs about as many rows as it has members.

A pair at the threshold is missed with a probability of about ``RISK`` per pair and
filter; every link returned is exact up to collisions of 64-bit hashes.
"""

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.components import components
from localstat.llm.shipping import ship
from localstat.llm.text import FINE_BYTES, mix, shingles, slices
from localstat.plans.scale import materialise, sized

COORDINATES, ROWS = 30, 4
RISK = 1e-6
SHORT, TILE = 32, 1024
_SEEDS = mix(np.arange(1, 2 * COORDINATES * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def match_floor(n, p, risk=RISK):
    """Largest number of matches that ``n`` trials of chance ``p`` miss with at most ``risk``."""
    total = 0.0
    for t in range(n + 1):
        total += comb(n, t) * p**t * (1 - p) ** (n - t)
        if total > risk:
            return max(t, 1)
    return n


def _signatures(hashes, first):
    """One row of minima (16 low bits) and of coordinate values per document with shingles."""
    docs = np.flatnonzero(np.diff(first))
    starts, wide = first[docs], COORDINATES * ROWS
    minima = np.full((wide, len(docs)), np.iinfo(np.uint64).max, np.uint64)
    block = 1 << 15  # keeps the working arrays in the processor's cache
    for lo in range(0, len(hashes), block):
        part = hashes[lo : lo + block]
        a = np.searchsorted(starts, lo, side="right") - 1
        b = np.searchsorted(starts, lo + len(part), side="left")
        cuts = np.maximum(starts[a:b] - lo, 0)
        for k in range(wide):
            value = (part ^ _SEEDS[k]) * (_SEEDS[wide + k] | np.uint64(1))
            value ^= value >> np.uint64(32)
            np.minimum(minima[k, a:b], np.minimum.reduceat(value, cuts), out=minima[k, a:b])
    values = np.empty((len(docs), COORDINATES), np.uint64)
    for c in range(COORDINATES):
        key = np.full(len(docs), c + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[c * ROWS + r])
        values[:, c] = key
    return docs, (mix(minima) & np.uint64(0xFFFF)).astype(np.uint16).T, values


def _sketch_batches(size):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in slices(texts, limit=FINE_BYTES):
                hashes, first = shingles(data, offsets, size)
                n, high, low = np.zeros(hi - lo, np.int64), *np.zeros((2, hi - lo), np.uint64)
                for i in np.flatnonzero(np.diff(first)):
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    n[i], high[i] = len(own), mix(own).sum()
                    low[i] = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()
                docs, minima, values = _signatures(hashes, first)
                sig, coords = [None] * (hi - lo), [None] * (hi - lo)
                for row, i in enumerate(docs):
                    sig[i], coords[i] = minima[row].tobytes(), values[row].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo), pa.array(n), pa.array(high.view(np.int64)),
                        pa.array(low.view(np.int64)), pa.array(sig, pa.binary()),
                        pa.array(coords, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "high", "low", "sig", "coords"],
                )

    return run


def sketches(docs, size):
    """Set size, 128-bit set hash, signature and coordinate values of every document."""
    schema = "doc_id bigint, n_shingles bigint, high bigint, low bigint, sig binary, coords array<bigint>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(_sketch_batches(size), schema)


def _screen_batches(match_least):
    def run(batches):
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1)
                for c in ("a", "b")
            )
            keep = (a == b).sum(1) >= match_least
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def screen(pairs, sigs, match_least):
    """Those of the ``(u, v)`` pairs whose signatures match in enough minima."""
    a = sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("a"))
    b = sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    return both.mapInArrow(_screen_batches(match_least), "u bigint, v bigint").distinct()


def _texts(docs, ids):
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(sized(ids), "doc_id")


def shingle_sets(docs, size, ids):
    """Sorted distinct shingle hashes, as bytes, of the documents whose ids are staged in ``ids``."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1), limit=FINE_BYTES):
                hashes, first = shingles(data, offsets, size)
                sets = [np.unique(hashes[first[i] : first[i + 1]]).tobytes() for i in range(hi - lo)]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hashes"])

    return _texts(docs, ids).mapInArrow(run, "doc_id bigint, hashes binary")


def confirm(pairs, docs, size, threshold_percent):
    """Those of the staged ``(u, v)`` pairs whose full shingle sets are alike enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= threshold_percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    ids = materialise(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "paired")
    sets = materialise(shingle_sets(docs, size, ids), "sets")
    left = sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u bigint, v bigint").distinct()


def _sides(frame):
    """The two sides of a tile; a tile on the diagonal has one set of members on both."""
    left = frame[frame.side == 0]
    return left, left if frame.i.iloc[0] == frame.j.iloc[0] else frame[frame.side == 1]


def _tile_members(match_least):
    """Members of a tile with a partner of another component above the match floor."""

    def run(frame):
        left, right = _sides(frame)
        hit = [np.zeros(len(x), bool) for x in (left, right)]
        if len(left) and len(right):
            a, b = (np.frombuffer(b"".join(x.sig), np.uint16).reshape(len(x), -1) for x in (left, right))
            other = right.component.to_numpy()
            for i, own in enumerate(left.component.to_numpy()):
                near = ((b == a[i]).sum(1) >= match_least) & (other != own)
                hit[0][i] = near.any()
                hit[1] |= near
        found = [x[["key", "id", "component"]][h] for x, h in zip((left, right), hit, strict=True)]
        return type(left)({c: np.concatenate([x[c] for x in found]) for c in found[0].columns})

    return run


def _tile_links(threshold_percent):
    """A spanning forest of the exact links between components inside one tile."""

    def run(frame):
        left, right = _sides(frame)
        us, vs = [], []
        if len(left) and len(right):
            a, b = ([np.frombuffer(x, np.uint64) for x in side.hashes] for side in (left, right))
            sizes = np.array([len(x) for x in b])
            terms, flat = np.unique(np.concatenate(b), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            label = dict(zip([*left.component, *right.component], [*left.component, *right.component], strict=True))

            def root(c):
                while label[c] != c:
                    c = label[c]
                return c

            ids, right_ids, comps = left.id.to_numpy(), right.id.to_numpy(), right.component.to_numpy()
            for i, own in enumerate(left.component):
                mark = np.zeros(len(terms), np.uint8)
                at = np.minimum(np.searchsorted(terms, a[i]), len(terms) - 1)
                mark[at[terms[at] == a[i]]] = 1
                common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                near = 100 * common >= threshold_percent * (len(a[i]) + sizes - common)
                for k in np.flatnonzero(near & (comps != own)):
                    x, y = root(own), root(comps[k])
                    if x != y:
                        label[x] = y
                        us.append(ids[i])
                        vs.append(right_ids[k])
        return type(left)({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return run


def _tiles(members):
    """Deal ``(key, id, component)`` rows of each list to the tiles of its square."""
    lists = materialise(members.groupBy("key").agg(F.count("*").alias("n")), "lists")
    posted = members.join(sized(lists), "key").withColumn("blocks", F.ceil(F.col("n") / TILE).cast("bigint"))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    # Block b meets every block: in the tiles (b, j >= b) on one side, (i < b, b) on the other.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return posted.select("key", "id", "component", "block", other).select(
        "key",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        "id",
        "component",
    )


def _merge_lists(postings, sigs, docs, size, threshold_percent, match_least):
    """Exact links between the components that still meet in some list."""
    lists = postings.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    lists = materialise(lists.where("least < most").select("key", "n"), "lists")
    members = materialise(postings.join(sized(lists), "key"), "members")

    short = members.where(F.col("n") <= SHORT).drop("n")
    u, v = (short.select("key", F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "uv")
    pairs = u.join(v, "key").where("u < v and of_u <> of_v").select("u", "v").distinct()
    pairs = materialise(screen(pairs, sigs, match_least), "pairs")
    links = confirm(pairs, docs, size, threshold_percent)

    members = members.where(F.col("n") > SHORT).drop("n")
    schema = "key bigint, id bigint, component bigint"
    dealt = _tiles(members).join(sigs.withColumnRenamed("doc_id", "id"), "id")
    near = dealt.groupBy("key", "i", "j").applyInPandas(_tile_members(match_least), schema)
    near = materialise(near.distinct(), "near")
    ids = materialise(near.select(F.col("id").alias("doc_id")).distinct(), "paired")
    sets = materialise(shingle_sets(docs, size, ids), "sets").withColumnRenamed("doc_id", "id")
    dealt = _tiles(near).join(sets, "id")
    tiled = dealt.groupBy("key", "i", "j").applyInPandas(_tile_links(threshold_percent), "u bigint, v bigint")
    return links.union(tiled)


def _prefixes(reps, floor):
    """Postings of shared lists inside the prefixes: ``id, key, leader``.

    Lists are ordered by length, unshared ones first; a representative keeps its
    ``COORDINATES - floor + 1`` first ones. Pairs with ``floor`` common lists keep one of them.
    """
    posted = reps.select(F.col("doc_id").alias("id"), F.explode("coords").alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader"))
    shared = posted.join(sized(materialise(lists.where("n > 1"), "lists")), "key")
    if floor > 1:  # at most COORDINATES rows a group, more only for repeated ids
        own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key", "leader"))).alias("own"))
        kept = F.slice("own", F.lit(1), F.greatest(F.size("own") - (floor - 1), F.lit(0)))
        shared = own.select("id", F.explode(kept).alias("l")).select("id", "l.key", "l.leader")
    return materialise(shared.select("id", "key", "leader"), "postings")


def near_duplicates(docs, size=5, threshold_percent=80):
    """Near-duplicate groups of ``docs(doc_id, text)`` on shingles of ``size`` words.

    Two documents are linked when 100 * |A and B| >= threshold_percent * |A or B|. Returns
    one row per document: ``doc_id, n_shingles, component_id, kept``. ``component_id`` is the
    smallest id reachable over links, ``kept`` marks that document. Further columns of
    ``docs`` are ignored. A document without words (or with a null text) is linked with
    nothing. Rows without a doc_id are linked with nothing and kept, with a null component.
    Rows that repeat a doc_id stay rows of their own; ids are taken to name one text each.
    """
    ship(docs.sparkSession)
    p = threshold_percent / 100
    floor = match_floor(COORDINATES, p**ROWS)
    match_least = match_floor(COORDINATES * ROWS, p)
    sketch = materialise(sketches(docs, size), "sketch")
    full = sketch.where("doc_id is not null and n_shingles > 0")
    equal = ["n_shingles", "high", "low"]
    classes = materialise(full.groupBy(*equal).agg(F.min("doc_id").alias("rep")), "classes")
    own = sized(classes.withColumnRenamed("rep", "doc_id"))
    reps = full.join(own, [*equal, "doc_id"], "left_semi").dropDuplicates([*equal, "doc_id"])
    reps = materialise(reps.select("doc_id", "sig", "coords"), "reps")
    sigs = reps.select("doc_id", "sig")

    postings = _prefixes(reps, floor)
    pairs = postings.where("leader < id").select(F.col("leader").alias("u"), F.col("id").alias("v"))
    pairs = materialise(screen(pairs.distinct(), sigs, match_least), "pairs")
    first = components(confirm(pairs, docs, size, threshold_percent))
    labelled = postings.join(sized(first), "id", "left")
    labelled = labelled.select("key", "id", F.coalesce("component", "id").alias("component"))
    links = _merge_lists(labelled, sigs, docs, size, threshold_percent, match_least)
    star = first.select(F.col("id").alias("u"), F.col("component").alias("v"))
    found = components(star.union(links)).select(F.col("id").alias("rep"), "component")
    member = classes.join(found, "rep", "left").select(*equal, F.coalesce("component", "rep").alias("component_id"))
    rows = sketch.select("doc_id", *equal).join(sized(materialise(member, "member")), equal, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
