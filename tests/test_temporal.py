import numpy as np
import pytest
from conftest import obs_frame
from test_stats import agree, found, some_rows

from localstat.operators import stats, temporal


def brute_temporal(rows, neighbours, k, anchor="oldest"):
    """All values expanded literally, the own past once per neighbour."""
    values, result = {}, []
    for b, n, v in sorted(rows):
        values.setdefault(n, []).append((b, v))
    for batch in sorted({b for b, _, _ in rows}):
        hist = {}
        for n, series in values.items():
            seen = [v for b, v in series if b <= batch][-k:]
            if any(b == batch for b, _ in series):
                hist[n] = seen if anchor == "oldest" else seen[::-1]
        scores = {n: [] for n in hist}
        for lag in range(k):
            level = [h[lag] for h in hist.values() if len(h) > lag]
            for n, h in hist.items():
                if len(h) > lag:
                    sd = np.std(level)
                    scores[n].append((h[lag] - np.mean(level)) / sd if sd else np.nan)
        for n, z in scores.items():
            pool = []
            for m in neighbours[n]:
                if m in scores:
                    pool += [scores[m][0], *z[1:], *scores[m][1:]]
            if pool:
                result.append((batch, n, z[0] * float(np.mean(pool))))
    return sorted(result)


@pytest.mark.parametrize("anchor", ["oldest", "latest"])
@pytest.mark.parametrize("k", [2, 4])
def test_closed_form_equals_expansion(spark, graph, neighbours, k, anchor):
    rows = some_rows(seed=11, batches=6, present=0.85)
    got = temporal.temporal_lisa(obs_frame(spark, rows), graph, k, anchor)
    agree(found(got), brute_temporal(rows, neighbours, k, anchor))


def test_history_of_one_is_the_spatial_statistic(spark, graph):
    obs = obs_frame(spark, some_rows(seed=12))
    agree(found(temporal.temporal_lisa(obs, graph, 1)), found(stats.spatial_lisa(obs, graph)))


def test_fewer_batches_than_k(spark, graph, neighbours):
    rows = some_rows(seed=13, batches=3, present=1.1)
    agree(found(temporal.temporal_lisa(obs_frame(spark, rows), graph, 10)), brute_temporal(rows, neighbours, 10))


def test_split_and_flat(spark):
    obs = obs_frame(spark, [(b, 1, float(b)) for b in range(5)])
    hist = temporal.history_arrays(obs, 3).where("batch = 4")
    assert hist.first().vals == [2.0, 3.0, 4.0]
    old = temporal.split_history(hist).first()
    assert (old.value, old.past) == (2.0, [3.0, 4.0])
    new = temporal.split_history(hist, "latest").first()
    assert (new.value, new.past) == (4.0, [3.0, 2.0])
    flat = temporal.history_flat(hist).collect()
    assert [(r.label, r.value) for r in flat] == [("k-0", 2.0), ("k-1", 3.0), ("k-2", 4.0)]
    with pytest.raises(ValueError):
        temporal.split_history(hist, "first")


def test_single_reading_has_an_empty_past(spark):
    hist = temporal.history_arrays(obs_frame(spark, [(0, 1, 5.0)]), 4)
    row = temporal.split_history(hist).first()
    assert (row.value, row.past) == (5.0, [])


def test_past_neighbour_values(spark, graph, neighbours):
    rows = some_rows(seed=14, batches=3)
    z = temporal.past_standardise(temporal.lag_rows(temporal.history_arrays(obs_frame(spark, rows), 3)))
    by_key = {}
    for r in z.collect():
        by_key.setdefault((r.batch, r.node), {})[r.lag] = r.z
    for r in temporal.past_neighbour_values(z, graph).collect():
        own = [v for lag, v in by_key[r.batch, r.node].items() if lag > 0]
        pool = []
        for m in neighbours[r.node]:
            if (r.batch, m) in by_key:
                pool += own + [v for lag, v in by_key[r.batch, m].items() if lag > 0]
        assert r.n == len(pool)
        assert np.isclose(r.total, sum(pool), equal_nan=True)
