import pytest
from conftest import obs_frame

from localstat.operators import temporal
from localstat.plans.scale import materialise
from localstat.sources.streams import stream_observations
from localstat.streaming import jobs
from localstat.streaming.state import RunState

SCHEMA = "batch BIGINT, node BIGINT, value DOUBLE"


def keyed(spark, rows):
    return materialise(spark.createDataFrame(rows, "node BIGINT, value DOUBLE"), "rows")


def state_of(state, version, nodes):
    spark = state.spark
    keys = materialise(spark.createDataFrame([(n,) for n in nodes], "node BIGINT"), "keys")
    found = state.read(version, keys)
    return sorted(map(tuple, found.select("node", "value").collect()))


def test_a_version_writes_what_it_touches(spark, tmp_path):
    state = RunState(spark, f"{tmp_path}/state", buckets=8)
    want = {n: [(n, float(n)), (n, n + 0.5)] for n in range(400)}
    assert state.runs(-1) == [] and state.read(-1, keyed(spark, [(1, 1.0)])) is None
    assert state.write(0, keyed(spark, sum(want.values(), []))) == 800
    written = []
    for version in range(1, 9):
        touched = {n: [(n, version * 1000.0 + n)] for n in range(version, version + 4)}
        want |= touched
        written.append(state.write(version, keyed(spark, sum(touched.values(), []))))
        assert state_of(state, version, range(400)) == sorted(sum(want.values(), []))
        # The version before is still there, for a micro-batch that is repeated.
        assert state_of(state, version - 1, [399]) == want[399]
    assert max(written) < 60 and sum(written) < 8 * 24  # of 800 rows
    assert len(state.runs(8)) <= 5
    names = sorted(x.name for x in (tmp_path / "state" / "runs").iterdir())
    assert set(names) == {run for v in (7, 8) for run, _ in state.runs(v)}
    assert sorted(x.name for x in (tmp_path / "state" / "manifest").iterdir()) == ["7", "8"]


def test_a_repeated_version_gives_the_same_state(spark, tmp_path):
    state = RunState(spark, f"{tmp_path}/state", buckets=4)
    state.write(0, keyed(spark, [(n, 1.0) for n in range(20)]))
    state.write(1, keyed(spark, [(3, 2.0)]))
    for _ in range(3):
        state.write(2, keyed(spark, [(3, 3.0), (4, 3.0)]))
        assert state_of(state, 2, [2, 3, 4]) == [(2, 1.0), (3, 3.0), (4, 3.0)]
        assert state_of(state, 1, [2, 3, 4]) == [(2, 1.0), (3, 2.0), (4, 1.0)]
    assert state.write(3, keyed(spark, [])) == 0
    assert state_of(state, 3, [3, 99]) == [(3, 3.0)]


def test_only_touched_buckets_are_read(spark, tmp_path):
    state = RunState(spark, f"{tmp_path}/state", buckets=16)
    state.write(0, keyed(spark, [(n, 1.0) for n in range(200)]))
    plan = state.read(0, keyed(spark, [(7, 0.0)]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


@pytest.mark.parametrize("fail_at", ["before_state", "after_state"])
def test_a_failed_micro_batch_is_repeated(spark, tmp_path, fail_at):
    """The second micro-batch fails before or after its state is written, and is run again."""
    rows = [(b, n, float(b * 100 + n)) for b in range(4) for n in range(1, 12) if (b + n) % 3]
    source = f"{tmp_path}/in"
    calls = []

    def fail(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df

    hook = {"before": fail} if fail_at == "before_state" else {"then": fail}

    def start():
        sdf = stream_observations(spark, source, SCHEMA, max_files=1)
        return jobs.stream_history(sdf, 3, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp", **hook)

    for b in range(4):
        obs_frame(spark, [r for r in rows if r[0] == b]).coalesce(1).write.mode("append").parquet(source)
        try:
            start().awaitTermination(120)
        except Exception as e:
            assert "lost" in str(e)
            start().awaitTermination(120)
    assert len(calls) == 5
    got = spark.read.parquet(f"{tmp_path}/out/allValues").select("batch", "node", "vals").collect()
    want = temporal.history_arrays(obs_frame(spark, rows), 3).select("batch", "node", "vals").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
