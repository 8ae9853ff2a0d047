import random

import numpy as np
import pytest

from localstat.operators.temporal import history_arrays
from localstat.plans import scale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot", i, float(rng.randint(0, 400))) for i in range(900)]
    rows += [(f"g{i % 30}", i, rng.random()) for i in range(600)]
    return spark.createDataFrame(rows, "g STRING, i BIGINT, v DOUBLE").repartition(5, "i")


def test_row_numbers_of_a_hot_group(skewed):
    plain, spread = (
        sorted(map(tuple, scale.running_weight(skewed, ["g"], ["i"], "no", hot_rows=limit).collect()))
        for limit in (10_000, 100)
    )
    assert spread == plain
    assert [r[3] for r in plain if r[0] == "hot"] == list(range(1, 901))


def test_hot_group_is_really_split(spark, skewed, monkeypatch):
    staged = []
    keep = scale.materialise
    monkeypatch.setattr(scale, "materialise", lambda *a: staged.append(keep(*a)) or staged[-1])
    scale.running_weight(skewed, ["g"], ["i"], "no", hot_rows=100)
    slices = staged[0].where("g = 'hot'").groupBy("_slice").count().collect()
    assert len(slices) > 5 and max(r["count"] for r in slices) < 300


def test_running_sum_of_weights(skewed):
    plain, spread = (
        {(r.g, r.i): r.s for r in scale.running_weight(skewed, ["g"], ["i"], "s", "i", hot_rows=limit).collect()}
        for limit in (10_000, 100)
    )
    assert spread == plain


@pytest.mark.parametrize("limit", [10_000, 50])
def test_quantiles_match_numpy(skewed, limit):
    found = scale.quantiles(skewed, ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0], hot_rows=limit)
    rows = skewed.collect()
    assert found.count() == 31
    for r in found.collect():
        want = np.percentile([x.v for x in rows if x.g == r.g], [0, 25, 50, 75, 100])
        assert np.allclose([r[f"q{i}"] for i in range(5)], want)


@pytest.mark.parametrize("k", [1, 2, 4, 7])
def test_histories_of_a_hot_node(spark, k):
    rng = random.Random(6)
    rows = [(1, b, rng.random()) for b in range(300)] + [(n, b, rng.random()) for n in (2, 3) for b in range(9)]
    obs = spark.createDataFrame(rows, "node BIGINT, batch BIGINT, value DOUBLE")
    plain, spread = (
        {(r.node, r.batch): r.vals for r in history_arrays(obs, k, hot_rows=limit).collect()}
        for limit in (10_000, 20)
    )
    assert spread == plain and len(plain) == len(rows)
    values = [v for n, _, v in rows if n == 1]
    assert plain[1, 250] == values[251 - k : 251]


def test_materialised_table_is_sized_by_count(spark):
    small = scale.materialise(spark.range(10))
    assert small.count() == 10 and scale.is_small(small)
    assert not scale.is_small(small, 9)


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scale.shared_dir(spark).startswith(base)


def test_null_keys_and_null_values_on_both_sides(spark):
    rows = [(None, i, float(i)) for i in range(60)] + [("a", i, None) for i in range(5)] + [("b", 1, 2.0)]
    df = spark.createDataFrame(rows, "g STRING, i BIGINT, v DOUBLE").repartition(3, "i")
    numbered = [
        sorted(map(str, scale.running_weight(df, ["g"], ["i"], "no", hot_rows=limit).collect())) for limit in (1000, 10)
    ]
    assert numbered[0] == numbered[1] and len(numbered[0]) == len(rows)
    found = [
        sorted(map(str, scale.quantiles(df, ["g"], "v", [0.25, 0.5], hot_rows=limit).collect())) for limit in (1000, 10)
    ]
    assert found[0] == found[1] and len(found[0]) == 2
