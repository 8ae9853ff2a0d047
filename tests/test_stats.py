import math
import random

import numpy as np
import pytest
from conftest import obs_frame

from localstat.operators import stats, verify
from localstat.plans import scale


def brute_lisa(rows, neighbours):
    """Statistic of every (batch, node, value) row, by the definition."""
    result = []
    for batch in sorted({b for b, _, _ in rows}):
        here = [(n, v) for b, n, v in rows if b == batch]
        values = [v for _, v in here]
        mean, sd = np.mean(values), np.std(values)
        z = [(n, (v - mean) / sd if sd else math.nan) for n, v in here]
        for n, zn in z:
            around = [zm for m, zm in z if m in neighbours.get(n, ())]
            if around:
                result.append((batch, n, zn * float(np.mean(around))))
    return sorted(result)


def found(df):
    return sorted((r.batch, r.node, r.lisa) for r in df.select("batch", "node", "lisa").collect())


def agree(got, want):
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert np.allclose([g[-1] for g in got], [w[-1] for w in want], rtol=1e-9, equal_nan=True)


def some_rows(seed=1, batches=4, present=0.8, repeats=1):
    rng = random.Random(seed)
    return [
        (b, n, rng.gauss(0, 1))
        for b in range(batches)
        for n in range(1, 17)
        for _ in range(rng.randint(1, repeats))
        if rng.random() < present
    ]


def test_all_nodes_report(spark, graph, neighbours):
    rows = some_rows(present=1.1)
    agree(found(stats.spatial_lisa(obs_frame(spark, rows), graph)), brute_lisa(rows, neighbours))


def test_missing_nodes_divide_by_those_present(spark, graph, neighbours):
    rows = some_rows(seed=2, present=0.6)
    agree(found(stats.spatial_lisa(obs_frame(spark, rows), graph)), brute_lisa(rows, neighbours))


def test_several_readings_per_node(spark, graph, neighbours):
    rows = some_rows(seed=3, repeats=3)
    agree(found(stats.spatial_lisa(obs_frame(spark, rows), graph)), brute_lisa(rows, neighbours))


def test_large_summary_is_joined_by_shuffle(spark, graph, neighbours, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    rows = some_rows(seed=4)
    agree(found(stats.spatial_lisa(obs_frame(spark, rows), graph)), brute_lisa(rows, neighbours))


def test_unknown_node_counts_in_the_moments_only(spark, graph, neighbours):
    rows = some_rows(seed=5, batches=1, present=1.1) + [(0, 99, 40.0)]
    got = found(stats.spatial_lisa(obs_frame(spark, rows), graph))
    agree(got, brute_lisa(rows, neighbours))
    assert 99 not in [n for _, n, _ in got]


def test_constant_batch_gives_nan(spark, graph):
    rows = [(0, n, 3.5) for n in range(1, 17)]
    got = found(stats.spatial_lisa(obs_frame(spark, rows), graph))
    assert len(got) == 16 and all(math.isnan(v) for _, _, v in got)


def test_lonely_and_isolated_nodes_give_no_row(spark, graph):
    assert found(stats.spatial_lisa(obs_frame(spark, [(0, 1, 1.0)]), graph)) == []
    rows = [(0, 1, 1.0), (0, 2, 2.0), (0, 16, 3.0)]
    assert [n for _, n, _ in found(stats.spatial_lisa(obs_frame(spark, rows), graph))] == [1, 2]


def test_empty_input(spark, graph):
    empty = obs_frame(spark, [])
    assert stats.spatial_lisa(empty, graph).count() == 0
    assert stats.batch_stats(empty).count() == 0


def test_scores_have_mean_zero_and_deviation_one(spark):
    z = stats.standardise(obs_frame(spark, some_rows(seed=6)))
    for r in z.selectExpr("batch", "z").groupBy("batch").agg({"z": "avg"}).collect():
        assert abs(r["avg(z)"]) < 1e-12
    for r in stats.batch_stats(z, col="z").collect():
        assert r.sd == pytest.approx(1)


def test_affine_change_keeps_the_statistic(spark, graph):
    rows = some_rows(seed=7)
    moved = [(b, n, 3 * v - 5) for b, n, v in rows]
    a, b = (found(stats.spatial_lisa(obs_frame(spark, r), graph)) for r in (rows, moved))
    agree(a, b)


def test_extra_columns_are_kept(spark, graph):
    obs = obs_frame(spark, some_rows(seed=8)).selectExpr("*", "monotonically_increasing_id() AS id")
    assert "id" in stats.spatial_lisa(obs, graph).columns


def test_one_per_node_takes_the_last(spark):
    rows = [(0, 1, 5, 1.0), (0, 1, 7, 2.0), (0, 1, 6, 3.0), (0, 2, 1, 4.0)]
    df = spark.createDataFrame(rows, "batch BIGINT, node BIGINT, ts BIGINT, value DOUBLE")
    assert sorted(map(tuple, stats.one_per_node(df, ["ts"]).collect())) == [(0, 1, 2.0), (0, 2, 4.0)]


def test_result_counts(spark, graph):
    obs = obs_frame(spark, [(0, 1, 1.0), (0, 2, 2.0), (0, 16, 3.0), (1, 5, 1.0)])
    counts = stats.result_counts(obs, stats.spatial_lisa(obs, graph))
    assert sorted(map(tuple, counts.collect())) == [(0, 3, 2), (1, 1, 0)]


def test_recomputation_agrees_when_all_report(spark, graph):
    obs = obs_frame(spark, some_rows(seed=9, present=1.1))
    got, want = stats.spatial_lisa(obs, graph), verify.expected_lisa(obs, graph)
    assert verify.compare_results(got, want, ["batch", "node"], "lisa").first().bad == 0
    assert verify.compare_results(got, want, ["batch", "node"], "lisa", digits=9).first().bad == 0


def test_mismatches_are_found(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (5, float("nan"))], "node INT, v DOUBLE")
    b = spark.createDataFrame([(1, 1.0), (2, 2.1), (4, 4.0), (5, float("nan"))], "node INT, v DOUBLE")
    rows = verify.mismatches(a, b, ["node"], "v").collect()
    assert sorted(r.node for r in rows) == [2, 3, 4]
    assert verify.compare_results(a, b, ["node"], "v").first().bad == 3


def test_readings_of_a_hub_are_combined_before_they_fan_out(spark):
    """A star: every leaf sees the mean of all readings of the hub."""
    edges = spark.range(2, 400).selectExpr("1L AS src", "id AS dst")
    obs = obs_frame(spark, [(0, 1, float(i)) for i in range(50)])
    got = stats.neighbour_mean(obs, edges, "value").collect()
    assert len(got) == 398 and all(r.mean == 24.5 for r in got)
