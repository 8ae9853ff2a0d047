import datetime
import hashlib
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest import obs_frame
from test_stats import agree, found, some_rows

from pyspark.sql import functions as F

from localstat.functions import rng
from localstat.operators import montecarlo as mc
from localstat.operators import stats, temporal, verify
from localstat.plans import registered, scale


def keys_frame(spark, batches, n):
    return spark.createDataFrame([(b, i) for b in range(batches) for i in range(1, n + 1)], "batch BIGINT, node BIGINT")


def sets_by_key(df):
    result = {}
    for r in df.collect():
        result.setdefault((r.batch, r.node), {})[r.draw] = tuple(r.members)
    return result


@pytest.mark.parametrize("n, r", [(16, 200), (16, 1930), (2000, 50)])
def test_drawn_sets_are_distinct_and_valid(spark, n, r):
    keys = keys_frame(spark, 2, min(n, 20))
    for (_, node), sets in sets_by_key(mc.random_sets(keys, n, r, seed=1)).items():
        assert sorted(sets) == list(range(r))
        assert len(set(sets.values())) == r
        for s in sets.values():
            assert 1 <= len(s) <= 4 and list(s) == sorted(set(s))
            assert node not in s and 1 <= s[0] and s[-1] <= n


def test_draws_are_a_function_of_the_seed(spark):
    keys = keys_frame(spark, 2, 20)
    one, same, other = (sets_by_key(mc.random_sets(keys, 20, 30, seed=s)) for s in (1, 1, 2))
    assert one == same and one != other
    assert one[0, 1] != one[1, 1]
    shared = mc.random_sets(keys.where("batch = 0").drop("batch"), 20, 30, 1, by=["node"])
    assert "batch" not in shared.columns and shared.count() == 600


def test_members_and_sizes_are_even(spark):
    keys = keys_frame(spark, 20, 50)
    rows = mc.random_sets(keys, 1000, 40, seed=3).collect()
    sizes = Counter(len(r.members) for r in rows)
    expected = len(rows) / 4
    assert sum((sizes[s] - expected) ** 2 / expected for s in range(1, 5)) < 20
    bins = Counter((m - 1) // 100 for r in rows for m in r.members)
    expected = sum(bins.values()) / 10
    assert sum((bins[b] - expected) ** 2 / expected for b in range(10)) < 35
    pairs = Counter((r.members[0] // 251, r.members[-1] // 251) for r in rows if len(r.members) == 4)
    assert pairs[0, 3] > pairs[1, 2] > 0


def test_small_graphs_enumerate_every_set(spark):
    keys = keys_frame(spark, 1, 6)
    for (_, node), sets in sets_by_key(mc.random_sets(keys, 6, 500, seed=1)).items():
        others = [n for n in range(1, 7) if n != node]
        want = {c for size in range(1, 5) for c in combinations(others, size)}
        assert set(sets.values()) == want and len(sets) == len(want)
    for sets in sets_by_key(mc.random_sets(keys, 6, 500, seed=1, exclude_self=False)).values():
        assert set(sets.values()) == {c for s in range(1, 5) for c in combinations(range(1, 7), s)}
    assert all(len(s) == 7 for s in sets_by_key(mc.random_sets(keys, 6, 7, seed=1)).values())


def test_asking_for_too_many_sets_gives_all(spark):
    for sets in sets_by_key(mc.random_sets(keys_frame(spark, 1, 16), 16, 1941, seed=1)).values():
        assert len(set(sets.values())) == len(sets) == 1940


def test_huge_graphs_draw_from_nodes_a_stride_apart(spark, monkeypatch):
    monkeypatch.setattr(mc, "UNIVERSE", 40)
    seen = set()
    for (_, node), sets in sets_by_key(mc.random_sets(keys_frame(spark, 2, 30), 300, 60, seed=4)).items():
        assert len(set(sets.values())) == 60
        for s in sets.values():
            assert list(s) == sorted(set(s)) and node not in s and 1 <= s[0] and s[-1] <= 300
        seen |= {m for s in sets.values() for m in s}
    assert len(seen) > 290


@pytest.mark.parametrize("k", [2, 3, 4])
def test_largest_choice_is_exact(spark, k):
    """Around every coefficient of small numbers and of the largest ones in use."""
    near = [*range(k, 400), *range(mc.UNIVERSE - 200, mc.UNIVERSE)]
    rows = [(math.comb(n, k) + d,) for n in near for d in (-1, 0, 1)]
    guess, found = rng.largest_choice("x", k, "g")
    got = spark.createDataFrame(rows, "x BIGINT").selectExpr("x", guess, f"{found} AS n")
    for r in got.collect():
        assert math.comb(r.n, k) <= r.x < math.comb(r.n + 1, k)


@pytest.mark.parametrize("n, total", [(1, 1), (5, 7), (7, 7), (1000, 3 * 10**17)])
def test_picks_are_distinct_and_even(spark, n, total):
    keys = spark.range(200).selectExpr("id", "pmod(hash(id), 2147483647) AS _b", "pmod(hash(id, 1), 2147483647) AS _c")
    rows = keys.selectExpr("*", f"explode(sequence(0L, {n - 1}L)) AS rank").selectExpr(
        "*", "pmod(hash(id, rank, 2), 2147483647) AS u", "pmod(hash(id, rank, 3), 2147483647) AS v"
    )
    texts = rng.stratified("rank", f"{n}L", f"{total}L", ("u", "v"))
    got = rows.selectExpr("*", *texts).selectExpr("id", "rank", "_pick").collect()
    assert len({(r.id, r._pick) for r in got}) == len(got) and all(0 <= r._pick < total for r in got)
    first = [r._pick / total for r in got if r.rank == 0]  # one pick of each key is even over all numbers
    assert total == 1 or 0.35 < np.mean(first) < 0.65


def redrawn(key, node, n, r, seed):
    """The generator's loop: draw a size and that many other nodes until there are r different sets."""
    digest = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    a, b = int(digest[:8], 16) % rng.PRIME, int(digest[8:16], 16) % (rng.PRIME - 1) + 1
    found, tries = [], 0
    while len(found) < r:
        x, u = (a + tries * b) % rng.PRIME, []
        for step in rng.STEPS:
            x = pow(x + step, 5, rng.PRIME)
            u.append(x)
        size, chosen = u[0] * 4 // rng.PRIME + 1, []
        for i in range(size):
            last = n - 1 - size + i
            pick = u[i + 1] * (last + 1) // rng.PRIME
            chosen.append(last if pick in chosen else pick)
        members = tuple(sorted(c + 1 + (c + 1 >= node) for c in chosen))
        found += [] if members in found else [members]
        tries += 1
    return found


@pytest.mark.parametrize("n, r", [(16, 200), (16, 1930), (60, 19), (2000, 50)])
def test_independent_sets_follow_the_loop(spark, monkeypatch, n, r):
    """All nodes and sizes are drawn from, however the sets before turned out; repeats are drawn anew."""
    monkeypatch.setattr(mc, "UNIVERSE", 20)
    keys = keys_frame(spark, 2, 10)
    got = sets_by_key(mc.random_sets(keys, n, r, seed=1, independent=True))
    assert got == {(b, i): dict(enumerate(redrawn(f"{b}:{i}", i, n, r, 1))) for b in range(2) for i in range(1, 11)}


def test_independent_sets_of_small_graphs_and_odd_keys(spark):
    for (_, node), sets in sets_by_key(mc.random_sets(keys_frame(spark, 1, 6), 6, 500, 1, independent=True)).items():
        others = [n for n in range(1, 7) if n != node]
        assert set(sets.values()) == {c for size in range(1, 5) for c in combinations(others, size)} and len(sets) == 30
    assert {len(s) for s in sets_by_key(mc.random_sets(keys_frame(spark, 1, 6), 6, 7, 1, independent=True)).values()} == {7}
    for sets in sets_by_key(mc.random_sets(keys_frame(spark, 1, 3), 16, 1941, 1, independent=True)).values():
        assert len(set(sets.values())) == len(sets) == 1940
    assert mc.random_sets(keys_frame(spark, 1, 1), 1, 5, 1, independent=True).collect() == []
    odd = obs_frame(spark, [(0, 1, 0.0), (0, 1, 1.0), (0, None, 0.0), (None, 2, 0.0)])
    for n in (3, 16):
        sets = mc.random_sets(odd, n, 3, 1, independent=True)
        assert sets.columns == ["batch", "node", "value", "draw", "members"]
        assert Counter((r.batch, r.node, r.value) for r in sets.collect()) == {tuple(r): 3 for r in odd.collect()}


def test_too_few_tries_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mc, "draws_needed", lambda choices, r: r)
    with pytest.raises(Exception, match="too few distinct sets"):
        mc.random_sets(keys_frame(spark, 1, 16), 16, 100, 1, independent=True).select("members").collect()


@pytest.mark.parametrize("choices, r", [(15, 100), (15, 1940), (149, 99), (1499, 1000), (10**8, 1000)])
def test_number_of_draws_bounds_the_risk(choices, r):
    draws = rng.draws_needed(choices, r)
    assert r <= draws
    if r < 1500:
        assert draws < 1.3 * r + 150 or choices == 15


def test_stored_sets_are_drawn_independently(spark, tmp_path):
    """The sets written as text are those of the loop, their sizes not dealt in turn."""
    days = [datetime.datetime(2024, 1, 1 + i) for i in range(3)]
    rows = [(i, days[i % 3], i % 40, "click", float(i % 7), "{}") for i in range(240)]
    events = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for r in registered.tuple_sets(spark, str(tmp_path)).collect():
        got.setdefault((str(r.batch), r.node), []).append(tuple(map(int, r.members.split(","))))
    assert got.keys() == {(str(d.date()), n) for d in days for n in range(1, 41)}
    for (day, node), sets in got.items():
        assert sorted(sets) == sorted(redrawn(f"{day}:{node}", node, 40, registered.R_TEMPORAL, registered.SEED))
    alone = Counter(sum(len(s) == 1 for s in sets) for sets in got.values())
    assert min(alone) < 4 and max(alone) > 5


def test_nodes_must_be_numbered(spark):
    assert mc.node_count(spark.range(1, 9).withColumnRenamed("id", "node")) == 8
    with pytest.raises(ValueError):
        mc.node_count(spark.range(2, 9).withColumnRenamed("id", "node"))


def brute_positions(z, sets, lisa):
    """Rank by listing all simulated values; ties within 1e-9 are not smaller."""
    result = []
    for (batch, node), value in lisa.items():
        below = 0
        for members in sets[batch, node].values():
            here = [z[batch, m] for m in members if (batch, m) in z]
            sim = z[batch, node] * float(np.mean(here)) if here else math.nan
            below += value - sim > 1e-9
        result.append((batch, node, (below + 1) / (len(sets[batch, node]) + 1)))
    return sorted(result)


def positions(df):
    return sorted((r.batch, r.node, r.position) for r in df.collect())


def spatial_parts(obs, graph, sets):
    z = {(r.batch, r.node): r.z for r in stats.standardise(obs).collect()}
    lisa = {(r.batch, r.node): r.lisa for r in stats.spatial_lisa(obs, graph).collect()}
    return brute_positions(z, sets, lisa)


# Lookups in broadcast arrays, in salted copies of them, by broadcast join, by shuffle.
LOOKUPS = [(1_000_000, 1_000_000), (0, 1_000_000), (1_000_000, 0), (0, 0)]


@pytest.mark.parametrize("rows, cells", LOOKUPS)
def test_spatial_positions(spark, graph, monkeypatch, rows, cells):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(mc, "ARRAY_SCORES", cells)
    monkeypatch.setattr(mc, "DRAWS_PER_TASK", 300)
    obs = obs_frame(spark, some_rows(seed=21, batches=3, present=0.7))
    sets = sets_by_key(mc.random_sets(obs.select("batch", "node"), 16, 60, seed=5))
    got = mc.spatial_lisa_mc(obs, graph, 16, 60, seed=5)
    agree(positions(got), spatial_parts(obs, graph, sets))
    assert all(r.n == 60 and 0 < r.position <= 1 for r in got.collect())


@pytest.mark.parametrize("rows, cells", LOOKUPS[:2])
def test_shared_sets(spark, graph, monkeypatch, rows, cells):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(mc, "ARRAY_SCORES", cells)
    obs = obs_frame(spark, some_rows(seed=22, batches=3, present=0.7))
    nodes = spark.range(1, 17).withColumnRenamed("id", "node")
    by_node = {}
    for r in mc.random_sets(nodes, 16, 30, 5, by=["node"]).collect():
        by_node.setdefault(r.node, {})[r.draw] = tuple(r.members)
    sets = {(b, n): s for b in range(3) for n, s in by_node.items()}
    got = mc.spatial_lisa_mc(obs, graph, 16, 30, seed=5, resample="shared")
    agree(positions(got), spatial_parts(obs, graph, sets))


@pytest.mark.parametrize("scope", ["local", "global"])
def test_temporal_lookups_agree(spark, graph, monkeypatch, scope):
    obs = obs_frame(spark, some_rows(seed=27, batches=2, present=0.8))
    results = []
    for rows, cells in LOOKUPS if scope == "local" else LOOKUPS[1:3]:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(mc, "ARRAY_SCORES", cells)
        monkeypatch.setattr(mc, "DRAWS_PER_TASK", 300)
        results.append(positions(mc.temporal_lisa_mc(obs, graph, 16, 3, 20, seed=4, scope=scope)))
    for other in results[1:]:
        agree(other, results[0])


def test_repeated_readings_are_refused(spark, graph):
    obs = obs_frame(spark, [(0, n, float(n)) for n in range(1, 17)] + [(0, 3, 9.0)])
    with pytest.raises(Exception, match="more than one reading"):
        mc.spatial_lisa_mc(obs, graph, 16, 20, seed=1)


def test_absent_sets_count_as_draws(spark):
    z = scale.materialise(spark.createDataFrame([(0, 1, 1.0), (0, 2, -1.0)], "batch BIGINT, node BIGINT, z DOUBLE"))
    sets = spark.createDataFrame(
        [(0, 1, 0, [7, 8], 1.0, 0.5), (0, 1, 1, [2, 9], 1.0, 0.5), (0, 1, 2, [3], 1.0, 0.5)],
        "batch BIGINT, node BIGINT, draw INT, members ARRAY<BIGINT>, z DOUBLE, lisa DOUBLE",
    )
    row = mc.rank_position(mc.simulated_lisa(mc.random_set_mean(sets, z))).first()
    assert (row.below, row.n, row.position) == (1, 3, 0.5)


def test_equal_values_are_not_smaller(spark):
    sims = spark.createDataFrame(
        [(0, 1, i, s, 0.3) for i, s in enumerate([0.3, 0.1 + 0.2, 0.3 - 1e-12, 0.2, 0.4])],
        "batch BIGINT, node BIGINT, draw INT, sim DOUBLE, lisa DOUBLE",
    )
    assert mc.rank_position(sims).first().below == 1


def test_constant_batch_ranks_nothing_below(spark, graph):
    obs = obs_frame(spark, [(0, n, 1.0) for n in range(1, 17)])
    rows = mc.spatial_lisa_mc(obs, graph, 16, 20, seed=1).collect()
    assert len(rows) == 16 and all(r.below == 0 and r.n == 20 for r in rows)


def test_stored_sets_give_the_same_positions(spark, graph):
    obs = obs_frame(spark, some_rows(seed=23, batches=2))
    z = scale.materialise(stats.standardise(obs).select("batch", "node", "z"))
    lisa = stats.lisa_from_z(z, graph)
    sets = mc.random_sets(lisa.select("batch", "node"), 16, 25, seed=5)
    want = verify.expected_positions(z, sets, lisa)
    agree(positions(mc.spatial_lisa_mc(obs, graph, 16, 25, seed=5)), positions(want))


@pytest.mark.parametrize("anchor", ["oldest", "latest"])
def test_temporal_statistic_is_unchanged_by_ranking(spark, graph, anchor):
    obs = obs_frame(spark, some_rows(seed=24, batches=4))
    got = mc.temporal_lisa_mc(obs, graph, 16, 3, 20, seed=2, scope="local", anchor=anchor)
    agree(found(got), found(temporal.temporal_lisa(obs, graph, 3, anchor)))
    assert all(r.n == 20 and 0 < r.position <= 1 for r in got.collect())


def test_history_of_one_ranks_like_the_spatial_job(spark, graph):
    obs = obs_frame(spark, some_rows(seed=25, batches=3))
    want = positions(mc.spatial_lisa_mc(obs, graph, 16, 30, seed=2))
    for scope in ("local", "global"):
        agree(positions(mc.temporal_lisa_mc(obs, graph, 16, 1, 30, seed=2, scope=scope)), want)


def test_past_picks_stay_in_scope(spark, graph, neighbours):
    base = spark.createDataFrame([(0, n, 2) for n in range(1, 17)], "batch BIGINT, node BIGINT, past_n BIGINT")
    sets = mc._sets(base, ["batch", "node"], 16, 40, seed=9)
    drawn = {(r.node, r.draw): set(r.members) for r in sets.collect()}
    for scope in ("local", "global"):
        picks = mc.set_members(mc._past_picks(sets, graph, 16, scope, 1_000)).collect()
        sizes = Counter((r.node, r.draw, r._level) for r in picks)
        assert set(sizes.values()) == {1, 2, 3, 4} and len(sizes) == 16 * 40 * 3
        seen = {}
        for r in picks:
            if r._level == 0:
                assert r.member in drawn[r.node, r.draw]
            else:
                assert r.member in neighbours[r.node] if scope == "local" else r.member != r.node
                seen.setdefault(r.node, set()).add(r.member)
        for node, members in seen.items():
            assert members == (neighbours[node] if scope == "local" else set(range(1, 17)) - {node})


def test_long_neighbour_lists_are_joined_instead(spark, graph):
    obs = obs_frame(spark, some_rows(seed=26, batches=3))
    inline, joined = (
        positions(mc.temporal_lisa_mc(obs, graph, 16, 3, 20, seed=2, scope="local", inline_degree=d))
        for d in (1_000, 1)
    )
    agree(joined, inline)


def test_steps_are_never_zero(spark, monkeypatch):
    monkeypatch.setattr(rng.F, "md5", lambda c: rng.F.lit("0" * 32))
    keys = spark.createDataFrame([(1, 1), (1, 2)], "batch BIGINT, node BIGINT")
    got = mc.random_sets(keys, 40, 9, seed=1).groupBy("node").count().collect()
    assert [r["count"] for r in got] == [9, 9]


def test_a_single_node_has_no_sets(spark):
    keys = spark.createDataFrame([(1, 1)], "batch BIGINT, node BIGINT")
    assert mc.random_sets(keys, 1, 5, seed=1).collect() == []


@pytest.mark.parametrize("cells", [0, 1_000_000])
def test_repeated_readings_are_refused_on_both_sides(spark, graph, monkeypatch, cells):
    monkeypatch.setattr(mc, "ARRAY_SCORES", cells)
    obs = obs_frame(spark, [(0, n, float(n)) for n in range(1, 17)] + [(0, 3, 9.0)])
    with pytest.raises(ValueError, match="more than one reading"):
        mc.spatial_lisa_mc(obs, graph, 16, 20, seed=1)


def test_nodes_without_outgoing_edges_stay(spark, graph):
    directed = graph.where("src <> 9")
    obs = obs_frame(spark, some_rows(seed=28, batches=3))
    want = {(r.batch, r.node) for r in temporal.temporal_lisa(obs, directed, 3).collect()}
    for degree in (1_000, 0):
        got = mc.temporal_lisa_mc(obs, directed, 16, 3, 10, seed=2, inline_degree=degree)
        assert {(r.batch, r.node) for r in got.collect()} == want


def test_sparse_batches_are_joined_not_laid_out(spark, graph, monkeypatch):
    """Many batches of few readings: the same result without a slot per batch and node."""
    monkeypatch.setattr(mc, "SPARSE", 4)
    rows = [(b, n, float(b * n % 7)) for b in range(40) for n in (b % 16 + 1, (b + 1) % 16 + 1, (b + 5) % 16 + 1)]
    z = scale.materialise(stats.standardise(obs_frame(spark, rows)).select("batch", "node", "z"))
    assert mc._Scores(z, 16).arrays is None
    monkeypatch.setattr(mc, "SPARSE", 1_000)
    assert mc._Scores(z, 16).arrays is not None


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_set_means_are_looked_up_next_to_the_sets(spark, monkeypatch, rows):
    """The means of drawn sets agree with a join of every member, and members are not shuffled."""
    monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(mc, "DRAWS_PER_TASK", 300)
    monkeypatch.setattr(mc, "_joined_means", None)
    z = scale.materialise(stats.standardise(obs_frame(spark, some_rows(seed=31, batches=3, present=0.6))).select("batch", "node", "z"))
    sets = mc.random_sets(z.withColumn("lisa", F.col("z") * 2), 16, 30, seed=5)
    means = mc.random_set_mean(sets, z)
    assert means.columns == ["batch", "node", "draw", "mean", "z", "lisa"]
    score = {(r.batch, r.node): r.z for r in z.collect()}
    want = {}
    for (batch, node), drawn in sets_by_key(sets).items():
        for draw, members in drawn.items():
            here = [score[batch, m] for m in members if (batch, m) in score]
            want[batch, node, draw] = float(np.mean(here)) if here else math.nan
    got = {(r.batch, r.node, r.draw): r["mean"] for r in means.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], v, abs_tol=1e-9) or (math.isnan(v) and math.isnan(got[k])) for k, v in want.items())


def test_means_of_repeated_or_null_keys(spark):
    """Sets under one key and draw, and readings that repeat, count together; null keys stay."""
    z = scale.materialise(obs_frame(spark, [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 4.0), (0, 3, 8.0)]).withColumnRenamed("value", "z"))
    once = mc.random_sets(z.select("batch", "node").distinct(), 3, 3, seed=1)
    by_hand = spark.createDataFrame([(r.batch, r.node, r.draw, r.members) for r in once.collect()], once.schema)
    key = lambda r: (r.batch, r.node, r.draw, r["mean"])
    assert sorted(map(key, mc.random_set_mean(once, z).collect())) == sorted(map(key, mc.random_set_mean(by_hand, z).collect()))
    single = scale.materialise(z.where("node < 3"))
    keys = obs_frame(spark, [(0, 1, 0.0), (0, 1, 0.0), (0, None, 0.0), (None, 2, 0.0)])
    for some in (keys, keys.distinct()):
        sets = mc.random_sets(some.select("batch", "node"), 3, 3, seed=1)
        plain = spark.createDataFrame(sets.collect(), sets.schema)
        want = sorted((str(key(r)) for r in mc.random_set_mean(plain, single).collect()))
        assert sorted(str(key(r)) for r in mc.random_set_mean(sets, single).collect()) == want and len(want) == 9


@pytest.mark.parametrize("scope", ["local", "global"])
def test_positions_of_a_draw_count_as_work(spark, graph, monkeypatch, scope):
    """A task gets few draws where each has a row for all positions of the history."""
    seen = []
    place = mc._Scores.place
    monkeypatch.setattr(mc._Scores, "place", lambda self, df, rows, per: seen.append((df.columns, rows, per)) or place(self, df, rows, per))
    obs = obs_frame(spark, some_rows(seed=32, batches=3, present=1.0))
    mc.temporal_lisa_mc(obs, graph, 16, 3, 20, seed=4, scope=scope)
    ((columns, rows, per),) = seen
    assert (rows, per) == (48, 60)
    assert ("neighbours" in columns) == (scope == "local")  # lists are joined before the draws


def test_histories_of_large_graphs_stay_in_arrays():
    """Half a million nodes with four positions: their members are not joined one by one."""
    assert 4 * 540_000 <= mc.ARRAY_SCORES


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_expected_positions_of_drawn_sets_are_looked_up(spark, monkeypatch, small):
    rows = [(b, n, float((n * 7 + b * 3) % 11) / 3) for b in (1, 2) for n in range(1, 31) if (n + b) % 9]
    rows += [(3, 1, float("nan")), (3, 2, float("nan")), (1, None, 0.5), (None, 4, 0.5), (3, 5, None)]
    z = scale.materialise(spark.createDataFrame(rows, "batch int, node long, z double"), "z")
    lisa = [(b, n, (v or 0.0) * 0.4) for b, n, v in rows if n != 12] + [(1, 40, 0.1)]
    lisa = spark.createDataFrame(lisa, "batch int, node long, lisa double")
    sets = mc.random_sets(z.select("batch", "node"), 35, 9, seed=3)
    odd = [(1, 2, 100, [999]), (1, 2, 101, []), (1, 2, 102, None), (2, 50, 0, [1]), (1, 3, 103, [None, 4]), (1, 40, 0, [1])]
    odd = spark.createDataFrame(odd, "batch int, node long, draw int, members array<long>")
    sets = scale.materialise(sets.unionByName(odd))
    want = verify.expected_positions(z, sets, lisa).collect()
    monkeypatch.setattr(scale, "BROADCAST_ROWS", small)
    monkeypatch.setattr(verify, "SETS_PER_TASK", 50)
    found = verify.expected_positions(z, sets, lisa, drawn=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "members" in plan and "explode(members" not in plan
    assert len(want) > 40 and sorted(found.collect()) == sorted(want)
    again = lisa.unionByName(lisa.limit(1))  # a key that repeats, so the sets are joined
    found = verify.expected_positions(z, sets, again, drawn=True)
    assert sorted(found.collect()) == sorted(verify.expected_positions(z, sets, again).collect())
