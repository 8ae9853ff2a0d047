import os
import random

import pytest
from conftest import obs_frame
from test_stats import agree, found, some_rows

from localstat.operators import moments, stats
from localstat.plans.scale import materialise
from localstat.sources.streams import stream_observations
from localstat.streaming import jobs
from localstat.streaming.open import OpenBatches, stream_open_batches, stream_open_lisa

SCHEMA = "batch BIGINT, node BIGINT, value DOUBLE, t BIGINT"
CLOSES = "(batch + 1) * 100"


def timed(seed, batches=4, each=1):
    """Readings with a time inside their batch, in the order of time; several per node if ``each`` is more."""
    rng = random.Random(seed)
    rows = [
        (b, n, v + i, b * 100 + rng.randrange(100))
        for b, n, v in some_rows(seed=seed, batches=batches)
        for i in range(each)
    ]
    return sorted(rows, key=lambda r: r[3])


def feed(spark, folder, parts):
    """A stream of one micro-batch for each of the parts."""
    folder.mkdir(parents=True, exist_ok=True)
    for i, part in enumerate(parts):
        own = folder.parent / f"part-{i}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(own))
        name = next(f for f in os.listdir(own) if f.endswith(".parquet"))
        target = folder / f"{i:03}.parquet"
        target.write_bytes((own / name).read_bytes())
        os.utime(target, (1_600_000_000 + i * 10,) * 2)
    return stream_observations(spark, str(folder), SCHEMA, max_files=1)


def cut(rows, seed, pieces):
    rng = random.Random(seed)
    at = [0, *sorted(rng.sample(range(1, len(rows)), pieces - 1)), len(rows)]
    return [rows[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def run(spark, graph, tmp_path, parts, delay=0, **kw):
    from pyspark.sql import functions as F

    sdf = feed(spark, tmp_path / "in", parts)
    folders = f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp"
    query = stream_open_lisa(sdf, graph, F.col("t"), F.expr(CLOSES), delay, *folders, **kw)
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(f"{tmp_path}/out/finalLisaValues")


@pytest.mark.parametrize("pieces", [2, 6])
def test_any_split_gives_the_batch_result(spark, graph, tmp_path, pieces):
    rows = timed(41)
    closing = [(99, 99, 0.0, 9900)]
    got = run(spark, graph, tmp_path, [*cut(rows, pieces, pieces), closing])
    agree(found(got), found(stats.spatial_lisa(obs_frame(spark, [r[:3] for r in rows]), graph)))
    # Only the last batch is open, and only parts that it needs are left.
    parts = sorted(os.listdir(tmp_path / "state" / "parts"))
    watermark, open_ = OpenBatches(spark, f"{tmp_path}/state").manifest(pieces)
    assert watermark == 9900 and [p[0] for p in open_] == [pieces]
    assert set(parts) == {str(p[0]) for v in (pieces - 1, pieces) for p in OpenBatches(spark, f"{tmp_path}/state").manifest(v)[1]}


def test_every_reading_has_its_own_result(spark, graph, tmp_path):
    rows = timed(42, batches=3, each=2)
    got = run(spark, graph, tmp_path, [*cut(rows, 5, 6), [(99, 99, 0.0, 9900)]], readings="each")
    want = stats.spatial_lisa(obs_frame(spark, [r[:3] for r in rows]), graph)
    key = lambda df: sorted((r.batch, r.node, round(r.value, 6), round(r.lisa, 6)) for r in df.collect())
    assert key(got) == key(want) and got.count() > len(rows) / 2


def test_readings_after_the_close_are_kept_apart(spark, graph, tmp_path):
    rows = timed(43, batches=3)
    first, last = [r for r in rows if r[0] < 2], [r for r in rows if r[0] == 2]
    late = [(0, 1, 1000.0, 5)]
    within = [(1, 1, 7.0, 190)] if not any(r[:2] == (1, 1) for r in rows) else []
    got = run(spark, graph, tmp_path, [first, last[:1], within or last[1:2], late, [(99, 99, 0.0, 9900)]], delay=20)
    kept = [r[:3] for r in first + last[:1] + (within or last[1:2])]
    agree(found(got), found(stats.spatial_lisa(obs_frame(spark, kept), graph)))
    stored = spark.read.parquet(f"{tmp_path}/out/lateValues").select("batch", "node", "value", "t").collect()
    assert [tuple(r) for r in stored] == late


def test_a_failed_micro_batch_is_repeated(spark, graph, tmp_path):
    from pyspark.sql import functions as F

    rows, calls = timed(44, batches=3), []

    def fn(tables):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        nodes = moments.merged(tables["moments"], ["batch", "node"])
        return {"finalLisaValues": moments.lisa_of_nodes(nodes, graph), "counts": nodes.groupBy("batch").count()}

    sdf = feed(spark, tmp_path / "in", [*cut(rows, 7, 5), [(99, 99, 0.0, 9900)]])
    keep = {"moments": lambda df: moments.node_moments(df, ["closes", "batch", "node"])}
    folders = f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/cp"
    start = lambda: stream_open_batches(sdf, F.col("t"), F.expr(CLOSES), 0, keep, fn, *folders)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination(300)
    start().awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/out/finalLisaValues")
    agree(found(got), found(stats.spatial_lisa(obs_frame(spark, [r[:3] for r in rows]), graph)))
    counts = {r.batch: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/counts").collect()}
    assert counts == {b: sum(r[0] == b for r in rows) for b in range(3)}


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_moments_merge_without_cancelling(spark, offset):
    rng = random.Random(3)
    rows = [(b, n, offset + rng.random()) for b in range(3) for n in range(40)] + [(7, 1, offset), (8, 1, None)]
    obs = obs_frame(spark, rows)
    parts = [moments.node_moments(obs.where(f"node % 3 = {i}")) for i in range(3)]
    whole = moments.merged(materialise(parts[0].unionByName(parts[1]).unionByName(parts[2]), "parts"), ["batch"])
    got = {r.batch: (r.n, r.mean, r.m2) for r in whole.collect()}
    assert set(got) == {0, 1, 2, 7}
    for b in (0, 1, 2, 7):
        own = [v for x, _, v in rows if x == b]
        mean = sum(own) / len(own)
        assert got[b][0] == len(own) and got[b][1] == pytest.approx(mean, rel=1e-12)
        assert got[b][2] == pytest.approx(sum((v - mean) ** 2 for v in own), rel=1e-6, abs=1e-12)


def test_lisa_out_of_moments_equals_lisa(spark, graph):
    rows = [r[:3] for r in timed(45, batches=3, each=3)] + [(9, 1, 2.0), (9, 2, 2.0), (10, 3, 1.0)]
    obs = obs_frame(spark, rows)
    got = moments.lisa_of_readings(obs, moments.node_moments(obs), graph)
    want = stats.spatial_lisa(obs, graph)
    key = lambda df: sorted((r.batch, r.node, str(round(r.value, 6)), str(round(r.lisa, 6) + 0.0)) for r in df.collect())
    assert key(got) == key(want)


def test_windows_of_several_readings(spark, graph, tmp_path):
    rows = timed(46, batches=3, each=2)
    sdf = feed(spark, tmp_path / "in", [*cut(rows, 3, 4), [(99, 99, 0.0, 9900)]])
    sdf = sdf.selectExpr("timestamp_seconds(t * 36) AS ts", "node", "value", "t")
    query = jobs.stream_window_lisa_multi(sdf, graph, "1 hour", "0 seconds", f"{tmp_path}/out", f"{tmp_path}/cp", salts=3)
    query.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/out/finalLisaValues").selectExpr(
        "unix_seconds(batch) div 3600 AS batch", "node", "value", "lisa"
    )
    want = stats.spatial_lisa(obs_frame(spark, [r[:3] for r in rows]), graph)
    key = lambda df: sorted((r.batch, r.node, round(r.value, 6), round(r.lisa, 6)) for r in df.collect())
    assert key(got) == key(want)
