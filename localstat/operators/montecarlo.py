"""Monte Carlo significance of the local statistics.

For every reading, ``r`` distinct sets of one to four other nodes are drawn. Each set
gives a simulated statistic, and the observed one is placed among them:
(number of smaller simulated values + 1) / (number of sets + 1).

Sets and picks are functions of (seed, batch, node, draw), evaluated next to the row
they belong to: drawing, averaging and ranking share one partitioning. The drawn nodes' scores are read from one array per batch, so the drawn
members themselves are never shuffled: the arrays go to the rows, by broadcast when
they are small together, else one copy per few million draws. Only graphs whose array
would outgrow a row fall back to a join of members with scores.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from localstat.functions.rng import PRIME, below, draws_needed, falling, largest_choice, numbers, stratified, stream_keys
from localstat.operators.stats import lisa_from_z, standardise
from localstat.operators.temporal import history_arrays, lag_rows, past_standardise, temporal_lag
from localstat.operators.topology import max_degree, node_map, ranked_neighbours
from localstat.plans import scale
from localstat.plans.scale import group_sizes, is_small, materialise, sized, staged

LARGEST_SET = 4
# Below this many nodes all sets are equally likely, else all sizes.
UNIFORM_BELOW = 16
# Nodes that a key draws from at most, so that 24 times the number of sets fits 64 bits.
UNIVERSE = 50_000
# A simulated value within this distance of the observed one is equal to it: a set
# that repeats the true neighbourhood differs only by the order of summation.
TIE = 1e-9
# Neighbour lists up to this length travel with the rows; longer ones are joined.
INLINE_DEGREE = 1_000
# Compare-and-swap steps that sort four values.
SORT_STEPS = [(0, 1), (2, 3), (0, 2), (1, 3), (1, 2)]
# Generated rows that one task should handle.
DRAWS_PER_TASK = 2_000_000
# Reduce partitions of one job; beyond it tasks get longer instead of more.
MOST_TASKS = 100_000
# Slots per reading up to which arrays are used.
SPARSE = 8
# Largest score array of one batch (32 MB): nodes times positions of the history.
ARRAY_SCORES = 4_000_000

_KEYS = ["_a", "_b", "_c"]


def node_count(nodes):
    """Number of nodes; the ids must be 1..N, as the draws address them by number."""
    row = nodes.select("node").distinct().agg(
        F.count("node").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")
    ).first()
    if row.n and (row.low != 1 or row.high != row.n):
        raise ValueError("nodes must be numbered 1..N")
    return row.n


def _with_keys(df, by, seed):
    """Add the stream keys ``_a, _b, _c``."""
    keyed = df.withColumn("_k", stream_keys(seed, *by))
    return keyed.withColumns({f"_{x}": F.col(f"_k.{x}") for x in "abc"}).drop("_k")


def _partitions(spark, work):
    n = max(2 * spark.sparkContext.defaultParallelism, min(-(-work // DRAWS_PER_TASK), MOST_TASKS))
    # A repartitioning equal to the one already in the plan would be dropped.
    return n + 1 if n == int(spark.conf.get("spark.sql.shuffle.partitions")) else n


def _spread(df, by, work):
    """Spread rows by key over enough partitions for ``work`` generated rows.

    A few small rows grow into thousands of draws each, so the number of partitions is
    given: adaptive execution would merge them by their size before they grow.
    """
    return df.repartition(_partitions(df.sparkSession, work), *by)


def _other(index, exclude_self=True):
    """SQL text: node with a 0-based index among all nodes, or among all but ``node``."""
    return f"{index} + 1 + IF({index} + 1 >= node, 1, 0)" if exclude_self else f"{index} + 1"


def _classes(choices, largest=LARGEST_SET):
    """Number of sets of each size that has any."""
    return {k: math.comb(choices, k) for k in range(1, largest + 1) if k <= choices}


def _even_sizes(counts, r):
    """SQL texts of the size and rank of draw ``_draw``, and how many ranks each size has at most.

    Sizes take turns while they have sets left. Smaller classes run out first; from there on
    the others take turns. The order within a turn differs by key.
    """
    sizes, ranks, most, start, rank = [], [], dict.fromkeys(counts, 0), 0, 0
    left = dict(sorted(counts.items(), key=lambda c: c[1]))
    while left and start < r:
        least, width = next(iter(left.values())), len(left)
        until = start + width * (least - rank)
        turn, place = f"((_draw - {start}L) div {width})", f"((_draw - {start}L + _a) % {width})"
        # The places of a turn are a rotation, so each size comes once in it.
        own = " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(sorted(left)))
        sizes.append(f"WHEN _draw < {until}L THEN CASE {place} {own} END")
        ranks.append(f"WHEN _draw < {until}L THEN {rank}L + {turn}")
        most |= {k: min(least, rank - (start - r) // width) for k in left}
        start, rank, left = until, least, {k: c for k, c in left.items() if c > least}
    return f"CASE {' '.join(sizes)} END AS _size", f"CASE {' '.join(ranks)} END AS _rank", most


def _sets_per_key(n_nodes, r, exclude_self=True):
    """How many sets a key gets: ``r``, or all there are."""
    return min(r, sum(_classes(n_nodes - 1 if exclude_self else n_nodes).values()))


def _sets(placed, by, n_nodes, r, seed, exclude_self=True):
    """Sets for rows that are already partitioned by key (or by batch and salt).

    A set has a number, its place among the combinations of its size. The numbers are cut into as
    many stretches as there are draws, and every draw takes a random one of its own stretch
    (:func:`stratified`): no draw is repeated, and nothing has to be compared or shuffled. The
    arithmetic is SQL text, later columns refer to the aliases of earlier ones.
    """
    choices = n_nodes - 1 if exclude_self else n_nodes
    universe = min(choices, UNIVERSE)
    counts = _classes(universe)
    total = sum(counts.values())
    if not total:  # a single node has no set
        return placed.where("false").withColumns({"draw": F.lit(0), "members": F.array().cast("array<bigint>")})
    rows = _with_keys(placed, by, seed)
    kept = [*rows.columns]
    rows = rows.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(min(r, total) - 1))))
    columns = [f"(_a + _draw * _b) % {PRIME} AS _x", *numbers("_x", n=2)]
    if n_nodes < UNIFORM_BELOW:
        columns += stratified("_draw", f"{min(r, total)}L", f"{total}L", ("_u0", "_u1"))
        at, size, first = 0, [], []
        for k, c in counts.items():
            at += c
            size.append(f"WHEN _pick < {at}L THEN {k}")
            first.append(f"WHEN _pick < {at}L THEN {at - c}L")
        columns += [f"CASE {' '.join(size)} END AS _size", f"_pick - CASE {' '.join(first)} END AS _x4"]
    else:
        size, rank, most = _even_sizes(counts, r)
        of_size = lambda values: " ".join(f"WHEN {k} THEN {c}L" for k, c in values.items())
        columns += [size, rank, f"CASE _size {of_size(counts)} END AS _all", f"CASE _size {of_size(most)} END AS _most"]
        columns += stratified("_rank", "_most", "_all", ("_u0", "_u1"), out="_x4")
    for k in range(LARGEST_SET, 1, -1):
        guess, found = largest_choice(f"_x{k}", k, f"_g{k}")
        columns += [guess, f"IF(_size >= {k}, {found}, NULL) AS _i{k}"]
        columns.append(f"IF(_size >= {k}, _x{k} - {falling(f'_i{k}', k)} div {math.factorial(k)}, _x{k}) AS _x{k - 1}")
    columns.append("_x1 AS _i1")
    places = [f"_i{k}" for k in range(1, LARGEST_SET + 1)]
    if universe < choices:  # every key has nodes of its own, a stride apart
        stride = next(s for s in range(choices * 5 // 8, choices) if math.gcd(s, choices) == 1)
        places = [f"(({i} * {stride}L + _c) % {choices}L)" for i in places]
    members = ", ".join(_other(i, exclude_self) for i in places)
    members = f"slice(array({members}), 1, _size)"
    members = f"sort_array({members})" if universe < choices else members
    # Out of a generator, so that filters on members are not rewritten in terms of all the columns
    # before them, which would double the condition with each.
    return rows.selectExpr("*", *columns).selectExpr(*kept, "_draw AS draw", f"explode(array({members})) AS members")


def _tries_per_key(n_nodes, r, exclude_self=True):
    """How many sets are tried per key before repeats are dropped: below 16 nodes, all masks of them."""
    choices = n_nodes - 1 if exclude_self else n_nodes
    return 2 ** max(choices, 0) if n_nodes < UNIFORM_BELOW else draws_needed(choices, _sets_per_key(n_nodes, r, exclude_self))


def _drawn(keyed, by, choices, r, exclude_self):
    """The first ``r`` distinct sets per key in the order they are tried, by Floyd's sampling.

    Every try draws a size and that many nodes, independently of the others. The arithmetic is SQL text
    with one select per step: later columns refer to the aliases of earlier ones.
    """
    tries = draws_needed(choices, r)
    carried = [c for c in keyed.columns if c not in by]
    slots = range(LARGEST_SET)

    size = below("_u0", LARGEST_SET)
    columns = [f"(_a + _try * _b) % {PRIME} AS _x", *numbers("_x", n=LARGEST_SET + 1), f"{size} + 1 AS _size"]
    # Floyd: step s picks among the first j + 1 choices and takes j itself on a repeat.
    for s in slots:
        j = f"({choices} - _size + {s})"
        columns.append(f"{below(f'_u{s + 1}', f'{j} + 1')} AS _t{s}")
        before = ", ".join(f"_m{i}" for i in range(s))
        columns.append(f"IF(_t{s} IN ({before}), {j}, _t{s}) AS _m{s}" if s else "_t0 AS _m0")
    rows = keyed.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    rows = rows.selectExpr("*", *columns)
    # Sorted node numbers in four columns, absent ones zero: cheap keys to compare sets by.
    columns = [f"IF(_size > {s}, {_other(f'_m{s}', exclude_self)}, 0L) AS _n{s}" for s in slots]
    at = [f"_n{s}" for s in slots]
    for step, (i, j) in enumerate(SORT_STEPS):
        columns += [f"least({at[i]}, {at[j]}) AS _low{step}", f"greatest({at[i]}, {at[j]}) AS _high{step}"]
        at[i], at[j] = f"_low{step}", f"_high{step}"
    columns += [f"{c} AS _s{s}" for s, c in enumerate(at)]
    rows = rows.selectExpr(*by, *carried, "_try", *columns)
    names = [f"_s{s}" for s in slots]
    distinct = rows.groupBy(*by, *names).agg(F.min("_try").alias("_try"), *[F.first(c).alias(c) for c in carried])
    ranked = _first(distinct, by, "_try", r).withColumn("_found", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    short = F.raise_error(F.lit("too few distinct sets drawn; use another seed")).cast("boolean")
    ranked = ranked.where(F.when(F.col("_found") == r, True).otherwise(short))
    members = F.filter(F.array(*names), lambda m: m > 0)
    return ranked.withColumn("members", members).drop("_try", "_found", *names)


def _enumerated(keyed, by, choices, r, exclude_self):
    """All sets of one to four nodes in a seeded random order, at most ``r`` per key."""
    masks = F.sequence(F.lit(1).cast("bigint"), F.lit(2**choices - 1).cast("bigint"))
    rows = keyed.withColumn("_mask", F.explode(masks)).where(F.bit_count("_mask").between(1, LARGEST_SET))
    rows = rows.selectExpr("*", f"(_a + _mask * _b) % {PRIME} AS _x", *numbers("_x", n=2))
    ranked = _first(rows, by, ["_u1", "_mask"], r)
    nodes = [f"IF(_mask & {1 << i} <> 0, {_other(f'{i}L', exclude_self)}, NULL)" for i in range(choices)]
    members = F.array_compact(F.array(*[F.expr(n) for n in nodes]))
    return ranked.withColumn("members", members).drop("_mask", "_x", "_u0", "_u1")


def _first(rows, by, order, r):
    """The first ``r`` rows per key, numbered by ``draw``."""
    draw = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("draw", draw).where(F.col("draw") < r)


def _tried_sets(placed, by, n_nodes, r, seed, exclude_self=True):
    """Sets as :func:`_sets` gives them, drawn independently of each other; repeats are dropped."""
    r = _sets_per_key(n_nodes, r, exclude_self)
    if not r:
        return _sets(placed, by, n_nodes, r, seed, exclude_self)
    make = _enumerated if n_nodes < UNIFORM_BELOW else _drawn
    # Keys may repeat: every row has its own sets.
    rows = _with_keys(placed, by, seed).withColumn("_row", F.monotonically_increasing_id())
    kept = [*placed.columns, *_KEYS]
    sets = make(rows, [*by, "_row"], n_nodes - 1 if exclude_self else n_nodes, r, exclude_self)
    return sets.select(*kept, "draw", "members")


def random_sets(keys, n_nodes, r, seed, by=("batch", "node"), exclude_self=True, independent=False):
    """Add ``draw`` and ``members`` to every row of ``keys``: ``r`` distinct random sets.

    ``by`` identifies the rows. Leaving ``batch`` out shares the sets between batches. Sizes one
    to four are equally frequent while they last; below 16 nodes all sets are equally likely.
    Where fewer than ``r`` sets exist, all of them are returned. ``independent`` sets are drawn without
    regard to each other, size and nodes, until there are ``r`` different ones.
    """
    keys = materialise(keys, "keys")
    rows, per_key = keys.count(), _sets_per_key(n_nodes, r, exclude_self)
    draw, work = (_tried_sets, _tries_per_key(n_nodes, r, exclude_self)) if independent else (_sets, per_key)
    sets = draw(_spread(keys, by, rows * work), by, n_nodes, r, seed, exclude_self).drop(*_KEYS)
    sets.drawn = keys, list(by), rows, per_key
    return sets


def nest_sets(sets, by=("batch", "node")):
    """One row per key with its list of sets, in draw order (at most ``r`` of them)."""
    listed = F.sort_array(F.collect_list(F.struct("draw", "members")))
    return sets.groupBy(*by).agg(listed["members"].alias("sets"))


def explode_sets(nested):
    """One row per set out of lists of sets; ``draw`` is the place in the list."""
    rest = [c for c in nested.columns if c != "sets"]
    return nested.select(*rest, F.posexplode("sets").alias("draw", "members"))


def set_members(sets):
    """One row per member of a set."""
    return sets.withColumn("member", F.explode("members")).drop("members").where("member IS NOT NULL")


def score_arrays(z, n_nodes):
    """One row per batch: ``scores[lag][node - 1]``, null where a node did not report.

    The positions come from numbering 1..N per batch and lag. A batch's array is bounded
    by the number of nodes, which the caller has checked.
    """
    z = z if "lag" in z.columns else z.withColumn("lag", F.lit(0))
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(n_nodes).cast("bigint"))
    places = z.select("batch", "lag").distinct().withColumn("node", F.explode(numbers))
    row = F.sort_array(F.collect_list(F.struct("node", "z")))["z"]
    rows = places.join(z, ["batch", "lag", "node"], "left").groupBy("batch", "lag").agg(row.alias("scores"))
    twice = F.raise_error(F.lit("more than one reading of a node in a batch"))
    rows = rows.withColumn(
        "scores",
        F.when(F.size("scores") == n_nodes, F.col("scores")).otherwise(twice.cast("array<double>")),
    )
    levels = F.sort_array(F.collect_list(F.struct("lag", "scores")))["scores"]
    return rows.groupBy("batch").agg(levels.alias("scores"))


class _Scores:
    """Scores of drawn members, looked up in arrays or, for huge graphs, by a join."""

    def __init__(self, z, n_nodes, levels=1, single=True):
        place = [c for c in ("batch", "lag") if c in z.columns]
        most, cells = group_sizes(z, [*place, "node"])
        if most > 1 and single:
            raise ValueError("more than one reading of a node in a batch")
        slots = z.select(*place).distinct().count() * n_nodes
        self.z, self.arrays, self.n_nodes, self.copies = z, None, n_nodes, None
        # Arrays have a slot for every node; where few nodes report, a join is less work.
        if n_nodes * levels <= ARRAY_SCORES and slots <= SPARSE * cells and most <= 1:
            self.arrays = materialise(score_arrays(z, n_nodes), "scores")
            self.small = self.arrays.count() * n_nodes * levels <= 4 * scale.BROADCAST_ROWS

    def place(self, df, rows, per_row):
        """Partition rows for their draws, next to a copy of their batch's array if that
        is not broadcast: one copy for every few million draws of the batch."""
        if self.arrays is None or self.small:
            return _spread(df, ["batch", "node"], rows * per_row)
        salts = max(1, -(-self.n_nodes * per_row // DRAWS_PER_TASK))
        copies = self.arrays.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        self.copies = _spread(copies, ["batch", "_salt"], rows * per_row)
        salted = df.withColumn("_salt", F.coalesce(F.pmod("node", F.lit(salts)).cast("int"), F.lit(0)))
        return _spread(salted, ["batch", "_salt"], rows * per_row)

    def means(self, rows, how="inner"):
        """Mean score of ``members`` per draw (over all lags, if there are several rows)."""
        if self.arrays is None:
            return _joined_means(set_members(rows), self.z)
        if self.copies is None:
            found = rows.join(F.broadcast(self.arrays), "batch", how)
        else:
            found = rows.join(self.copies.hint("shuffle_hash"), ["batch", "_salt"], how)
        several = "_level" in rows.columns
        slots = range(LARGEST_SET)
        level = "_level" if several else "0"
        values = [f"get(get(scores, {level}), int(get(members, {i}) - 1)) AS _v{i}" for i in slots]
        total = " + ".join(f"coalesce(_v{i}, 0.0D)" for i in slots) + " AS _sum"
        n = " + ".join(f"int(_v{i} IS NOT NULL)" for i in slots) + " AS _n"
        rest = [c for c in found.columns if c not in ("scores", "members")]
        found = found.selectExpr(*rest, *values, total, n).drop(*[f"_v{i}" for i in slots])
        if several:
            keys, carried = _keys_and_rest(found, "draw", drop=("_level", "_sum", "_n"))
            found = found.groupBy(*keys).agg(
                F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in carried]
            )
        mean = F.coalesce(F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)), F.lit(float("nan")))
        return found.withColumn("mean", mean).drop("_sum", "_n")


def _keys_and_rest(df, *more, drop=()):
    """Grouping keys (with the salt, where there is one), and the other columns."""
    keys = [c for c in ("batch", "node", "_salt", *more) if c in df.columns]
    return keys, [c for c in df.columns if c not in keys and c not in drop]


def _joined_means(rows, table):
    """The same means by joining every member with its score."""
    table = table.withColumnsRenamed({"node": "member", "z": "_z", "lag": "_level"})
    on = [c for c in ("batch", "_level", "member") if c in rows.columns]
    scores = table.select(*on, "_z")
    if is_small(table):
        joined = rows.join(F.broadcast(scores), on, "left")
    else:
        # One repartitioning serves both this average and the ranking that follows.
        joined = rows.join(scores, on, "left").repartition("batch", "node")
    keys, carried = _keys_and_rest(joined, "draw", drop=("_level", "member", "_z"))
    return joined.groupBy(*keys).agg(
        F.coalesce(F.avg("_z"), F.lit(float("nan"))).alias("mean"),
        *[F.first(c).alias(c) for c in carried],
    )


def random_set_mean(sets, z):
    """Average score of each set's members that reported; NaN when none did.

    ``z`` (batch, node, z) should be a staged table; other columns of ``sets`` are kept. The members of
    sets that come straight from :func:`random_sets` are looked up next to their set, in one array of
    scores per batch. They are joined one by one for other sets, for keys or readings that repeat, and
    where the arrays would be too large or sparse.
    """
    drawn = getattr(sets, "drawn", None)
    if drawn and group_sizes(drawn[0], drawn[1])[0] <= 1:
        low, high = z.agg(F.min("node"), F.max("node")).first()
        scores = _Scores(z, high, single=False) if high and low >= 1 else None
        if scores is not None and scores.arrays is not None:
            placed = sets if scores.small else scores.place(sets, *drawn[2:])
            found = scores.means(placed, "left").drop("_salt")
            keys, carried = _keys_and_rest(found, "draw", drop=("mean",))
            return found.select(*keys, "mean", *carried)
    return _joined_means(set_members(sets), z)


def simulated_lisa(means):
    """Simulated statistic of every set: the node's own ``z`` times the set's mean."""
    return means.withColumn("sim", F.col("z") * F.col("mean"))


def rank_position(sims):
    """Place of ``lisa`` among the simulated values of each (batch, node).

    Counting smaller values needs no ordering and no list of them. A set without any
    reporting member counts as a draw but is never smaller.
    """
    gap = F.col("lisa") - F.col("sim")
    keys, carried = _keys_and_rest(sims, drop=("draw", "mean", "sim"))
    ranked = sims.groupBy(*keys).agg(
        F.count_if((gap > TIE) & ~F.isnan(gap)).alias("below"),
        F.count(F.lit(1)).alias("n"),
        *[F.first(c).alias(c) for c in carried],
    )
    return ranked.drop("_salt").withColumn("position", (F.col("below") + 1) / (F.col("n") + 1))


def spatial_lisa_mc(obs, edges, n_nodes, r, seed, resample="per_batch"):
    """Local statistic with its Monte Carlo position.

    One reading per (batch, node). ``resample='shared'`` draws the sets once per node
    instead of anew in every batch.
    """
    if resample not in ("per_batch", "shared"):
        raise ValueError("resample is 'per_batch' or 'shared'")
    edges = staged(edges, "edges")
    z = materialise(standardise(obs).select("batch", "node", "z"), "z")
    rows, by = z.count(), ["batch", "node"]
    scores = _Scores(z, n_nodes)
    lisa = lisa_from_z(z, edges)
    if resample == "per_batch":
        placed = scores.place(lisa, rows, _sets_per_key(n_nodes, r))
        sets = _sets(placed, by, n_nodes, r, seed).drop(*_KEYS)
    else:
        nodes = edges.select(F.col("src").alias("node")).distinct()
        sets = materialise(random_sets(nodes, n_nodes, r, seed, by=["node"]), "sets")
        sets = scores.place(lisa, rows, _sets_per_key(n_nodes, r)).join(sized(sets), "node")
    return rank_position(simulated_lisa(scores.means(sets)))


def _neighbour_lists(edges, inline_degree):
    """Sorted neighbours of every node that has any; None where some list is too long."""
    longest = max_degree(edges)
    if longest > inline_degree:
        return None
    lists = materialise(node_map(edges, inline_degree).drop("part"), "neighbours")
    return sized(lists, scale.BROADCAST_ROWS // max(longest, 1))


def _past_picks(sets, edges, n_nodes, scope, inline_degree):
    """Members to average per (draw, position): the set itself at 0, picks beyond.

    At every past position one to four nodes are picked with replacement, among the
    node's own neighbours (``local``) or among all other nodes (``global``). Unused
    places of the member array are null.
    """
    rows = sets.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("past_n").cast("int"))))
    start = f"(_a + draw * _b + _level * _c) % {PRIME} AS _x"
    rows = rows.selectExpr("*", start, *numbers("_x", n=LARGEST_SET + 1))
    slots = range(LARGEST_SET)
    spent = ["_x", *[f"_u{i}" for i in range(LARGEST_SET + 1)], *[f"_p{i}" for i in slots], *_KEYS, "past_n"]

    def picked(df, choices):
        """Add ``_p0 .. _p3``: 0-based choices, null beyond the number of picks."""
        size = below("_u0", LARGEST_SET)
        picks = [f"IF({size} >= {i}, {below(f'_u{i + 1}', choices)}, NULL) AS _p{i}" for i in slots]
        return df.selectExpr("*", *picks)

    def with_members(df, node_of):
        picks = ", ".join(node_of(f"_p{i}") for i in slots)
        return df.withColumn("members", F.expr(f"IF(_level = 0, members, array({picks}))"))

    if scope == "global":
        return with_members(picked(rows, n_nodes - 1), _other).drop(*spent)

    if "neighbours" not in sets.columns:
        lists = _neighbour_lists(edges, inline_degree)
        rows = rows if lists is None else rows.join(lists, "node", "left")
    if "neighbours" in rows.columns:
        # A node without outgoing edges has no list: it keeps its sets and picks nothing.
        rows = picked(rows, "size(neighbours)")
        return with_members(rows, lambda p: f"get(neighbours, int({p}))").drop(*spent, "neighbours")

    degrees = edges.groupBy(F.col("src").alias("node")).agg(F.count("dst").alias("_degree"))
    ranked = ranked_neighbours(edges).select(
        F.col("src").alias("node"), F.col("pos").alias("_index"), "dst"
    )
    past = picked(rows.where("_level > 0").join(degrees, "node"), "_degree")
    past = past.withColumn("_index", F.explode(F.array(*[f"_p{i}" for i in slots])))
    past = past.join(ranked, ["node", "_index"]).withColumn("members", F.array("dst"))
    return rows.where("_level = 0").drop(*spent).unionByName(past.drop(*spent, "_degree", "_index", "dst"))


def temporal_lisa_mc(
    obs, edges, n_nodes, k, r, seed, scope="local", anchor="oldest", inline_degree=INLINE_DEGREE
):
    """Temporal statistic with its Monte Carlo position.

    A simulated value averages the scores of a random set and, for each of the node's
    past positions, of one to four random nodes' scores at that position.
    """
    hist = history_arrays(obs, k)
    return temporal_mc_from_history(hist, edges, n_nodes, k, r, seed, scope, anchor, inline_degree)


def temporal_mc_from_history(
    hist, edges, n_nodes, k, r, seed, scope="local", anchor="oldest", inline_degree=INLINE_DEGREE
):
    """The same out of ready-made histories ``vals`` of at most ``k`` values, as a stream keeps them."""
    if scope not in ("local", "global"):
        raise ValueError("scope is 'local' or 'global'")
    edges = staged(edges, "edges")
    z_rows = past_standardise(lag_rows(hist, anchor))
    z_rows = materialise(z_rows.select("batch", "node", "lag", "z"), "z")
    lagged = temporal_lag(z_rows, edges)
    lisa = lagged.withColumn("lisa", F.col("z") * F.col("lag")).drop("lag")
    scores = _Scores(z_rows, n_nodes, k)
    if scope == "local":  # joined before the draws, which a large graph would have to shuffle
        lists = _neighbour_lists(edges, inline_degree)
        lisa = lisa if lists is None else lisa.join(lists, "node", "left")
    # Every draw has a row per position of the history, and all of them meet in one task.
    readings = z_rows.where("lag = 0").count()
    placed = scores.place(lisa, readings, _sets_per_key(n_nodes, r) * k)
    sets = _sets(placed, ["batch", "node"], n_nodes, r, seed)
    means = scores.means(_past_picks(sets, edges, n_nodes, scope, inline_degree))
    return rank_position(simulated_lisa(means))
