import os

import pytest
from conftest import obs_frame
from test_stats import agree, found, some_rows

from localstat.operators import montecarlo, stats, temporal, words
from localstat.plans import scale
from localstat.sources.streams import stream_observations
from localstat.streaming import jobs

SCHEMA = "batch BIGINT, node BIGINT, value DOUBLE"


def write_batches_as_files(spark, folder, rows):
    """One file per batch, in order of arrival."""
    for i, batch in enumerate(sorted({b for b, _, _ in rows})):
        part = folder / f"in-{batch}"
        obs_frame(spark, [r for r in rows if r[0] == batch]).coalesce(1).write.parquet(str(part))
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = folder / "all"
        target.mkdir(exist_ok=True)
        data = (part / name).read_bytes()
        (target / f"{batch}.parquet").write_bytes(data)
        os.utime(target / f"{batch}.parquet", (1_600_000_000 + i * 10,) * 2)
    return str(folder / "all")


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    rows = some_rows(seed=31, batches=5, present=0.85)
    return rows, write_batches_as_files(spark, tmp_path_factory.mktemp("feed"), rows)


def finish(query):
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None


def test_spatial_stream_equals_batch(spark, graph, feed, tmp_path):
    rows, path = feed
    sdf = stream_observations(spark, path, SCHEMA, max_files=1)
    query = jobs.stream_lisa(sdf, f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: stats.spatial_lisa(df, graph))
    finish(query)
    got = spark.read.parquet(f"{tmp_path}/out/finalLisaValues")
    assert got.select("batch_id").distinct().count() == 5
    agree(found(got), found(stats.spatial_lisa(obs_frame(spark, rows), graph)))
    metrics = jobs.batch_metrics(spark, query).where("num_input_rows > 0").collect()
    assert sum(m.num_input_rows for m in metrics) == len(rows)
    assert [m.batch_id for m in metrics] == list(range(5)) and all(m.total_ms >= 0 for m in metrics)


def test_micro_batch_id_serves_as_batch(spark, graph, feed, tmp_path):
    rows, path = feed
    sdf = stream_observations(spark, path, SCHEMA, max_files=1).drop("batch")
    finish(jobs.stream_lisa(sdf, f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: stats.spatial_lisa(df, graph)))
    got = spark.read.parquet(f"{tmp_path}/out/finalLisaValues")
    agree(found(got), found(stats.spatial_lisa(obs_frame(spark, rows), graph)))


def test_monte_carlo_stream(spark, graph, feed, tmp_path):
    rows, path = feed
    sdf = stream_observations(spark, path, SCHEMA, max_files=2)
    fn = lambda df: montecarlo.spatial_lisa_mc(df, graph, 16, 15, seed=3)
    finish(jobs.stream_lisa(sdf, f"{tmp_path}/out", f"{tmp_path}/cp", fn, name="positions"))
    got = spark.read.parquet(f"{tmp_path}/out/positions")
    want = montecarlo.spatial_lisa_mc(obs_frame(spark, rows), graph, 16, 15, seed=3)
    cols = ["batch", "node", "below", "n"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


@pytest.mark.parametrize("files", [1, 2])
def test_histories_across_micro_batches(spark, feed, tmp_path, files):
    rows, path = feed
    sdf = stream_observations(spark, path, SCHEMA, max_files=files)
    finish(jobs.stream_history(sdf, 3, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out/allValues")
    want = temporal.history_arrays(obs_frame(spark, rows), 3)
    cols = ["batch", "node", "vals"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_temporal_stream_equals_batch(spark, graph, feed, tmp_path):
    rows, path = feed
    sdf = stream_observations(spark, path, SCHEMA, max_files=1)
    finish(jobs.stream_temporal_lisa(sdf, graph, 3, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out/finalLisaValues")
    agree(found(got), found(temporal.temporal_lisa(obs_frame(spark, rows), graph, 3)))
    assert spark.read.parquet(f"{tmp_path}/out/allValues").count() == len(rows)


@pytest.mark.parametrize("scope", ["local", "global"])
def test_temporal_monte_carlo_stream_equals_batch(spark, graph, feed, tmp_path, scope):
    rows, path = feed
    sdf = stream_observations(spark, path, SCHEMA, max_files=2)
    folders = (f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp")
    finish(jobs.stream_temporal_mc(sdf, graph, 16, 3, 12, 5, *folders, scope=scope))
    want = montecarlo.temporal_lisa_mc(obs_frame(spark, rows), graph, 16, 3, 12, 5, scope)
    cols = ["batch", "node", "below", "n"]
    got = spark.read.parquet(f"{tmp_path}/out/measuredValuesPositions").select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(*cols).collect()))


def test_batch_spread_over_micro_batches_is_refused(spark, graph, tmp_path):
    path = write_batches_as_files(spark, tmp_path, some_rows(seed=34, batches=2))
    sdf = stream_observations(spark, path, SCHEMA, max_files=1).selectExpr("0L AS batch", "node", "value")
    query = jobs.stream_lisa(sdf, f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: stats.spatial_lisa(df, graph))
    with pytest.raises(Exception, match="several micro-batches"):
        query.awaitTermination(120)


def test_metrics_table_and_staging_survive_many_micro_batches(spark, graph, feed, tmp_path):
    """Spark is told to remember two updates; the table has all, and staged folders are gone."""
    import time

    rows, path = feed
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    listener = jobs.BatchMetrics(spark, f"{tmp_path}/metrics")
    spark.streams.addListener(listener)
    folders = []

    def fn(df):
        folders.append(scale.fresh_path(spark, "x").rpartition("/")[0].removeprefix("file:"))
        return {"finalLisaValues": stats.spatial_lisa(df, graph), "allValues": df}

    try:
        sdf = stream_observations(spark, path, SCHEMA, max_files=1)
        finish(jobs.stream_lisa(sdf, f"{tmp_path}/out", f"{tmp_path}/cp", fn))
        for _ in range(60):
            time.sleep(0.5)
            if os.path.isdir(f"{tmp_path}/metrics"):
                got = spark.read.parquet(f"{tmp_path}/metrics").where("num_input_rows > 0").collect()
                if len(got) == 5:
                    break
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert sorted(m.batch_id for m in got) == list(range(5))
    assert all(m.processing_start_ms <= m.processing_end_ms <= m.total_delay_ms + 1000 for m in got)
    assert spark.read.parquet(f"{tmp_path}/out/allValues").count() == len(rows)
    assert len(set(folders)) == 5 and not any(os.path.exists(f) for f in folders)


def test_restart_continues_from_the_kept_histories(spark, tmp_path):
    rows = some_rows(seed=32, batches=4)
    first = write_batches_as_files(spark, tmp_path, [r for r in rows if r[0] < 2])
    for _ in range(2):
        sdf = stream_observations(spark, first, SCHEMA, max_files=1)
        finish(jobs.stream_history(sdf, 3, f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp"))
        later = tmp_path / "later"
        if not later.exists():
            later.mkdir()
            more = write_batches_as_files(spark, later, [r for r in rows if r[0] >= 2])
            for name in sorted(os.listdir(more)):
                target = os.path.join(first, name)
                with open(os.path.join(more, name), "rb") as src, open(target, "wb") as dst:
                    dst.write(src.read())
                stamp = 1_700_000_000 + int(name.split(".")[0])
                os.utime(target, (stamp, stamp))
    got = spark.read.parquet(f"{tmp_path}/out/allValues").select("batch", "node", "vals")
    want = temporal.history_arrays(obs_frame(spark, rows), 3).select("batch", "node", "vals")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_close_as_a_whole(spark, graph, tmp_path):
    rows = [r for r in some_rows(seed=33, batches=4)]
    path = write_batches_as_files(spark, tmp_path, rows)
    sdf = stream_observations(spark, path, SCHEMA, max_files=1).selectExpr(
        "timestamp_seconds(batch * 3600 + node) AS ts", "node", "value"
    )
    finish(jobs.stream_window_lisa(sdf, graph, "1 hour", "0 seconds", f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = spark.read.parquet(f"{tmp_path}/out/finalLisaValues").selectExpr(
        "unix_seconds(batch) div 3600 AS batch", "node", "lisa"
    )
    want = [r for r in found(stats.spatial_lisa(obs_frame(spark, rows), graph)) if r[0] < 3]
    agree(found(got), want)


def test_word_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("to be or  not\nto be \n\n")
    sdf = spark.readStream.text(str(folder)).withColumnRenamed("value", "text")
    fn = lambda df: words.word_count(df, by=["batch"])
    finish(jobs.stream_lisa(sdf, f"{tmp_path}/out", f"{tmp_path}/cp", fn, name="words"))
    got = {r.word: r.n for r in spark.read.parquet(f"{tmp_path}/out/words").collect()}
    assert got == {"to": 2, "be": 2, "or": 1, "not": 1, "": 2}
