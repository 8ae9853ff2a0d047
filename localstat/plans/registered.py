"""Registered queries: every operator applied to the given tables as a whole.

Each takes (spark, sf_dir) and returns a DataFrame of scalar columns.
"""

from pyspark.sql import functions as F

from localstat import sinks
from localstat.operators import montecarlo, runs, stats, temporal, topology, verify, words
from localstat.plans import inputs
from localstat.plans.inputs import K, SEED
from localstat.plans.scale import fresh_path, materialise
from localstat.sources import text, xml
from localstat.streaming import jobs
from localstat.streaming.open import stream_open_lisa as stream_open_lisa_job

R, R_TEMPORAL, R_WHOLE, N_STATIONS = 99, 19, 1000, 5
# Cells of a matrix that one task writes, and one file holds.
CELLS_PER_TASK = 200_000_000
RUNS = ["click", "error", "purchase", "signup", "view"]


def r6(col):
    """Rounded for comparison; adding zero turns -0.0 into 0.0, and NaN becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.round(c, 6) + F.lit(0.0), F.lit(float("nan")))


def show(df, *keys, **values):
    """Keys as they are, values rounded under their names."""
    return df.select(*keys, *[r6(c).alias(name) for name, c in values.items()])


def spread_out(array, names):
    return [r6(F.try_element_at(array, F.lit(i + 1))).alias(n) for i, n in enumerate(names)]


def joined(members):
    return F.array_join(F.col(members).cast("array<string>"), ",").alias(members)


# Aggregations -----------------------------------------------------------------


def batch_count(spark, d):
    return stats.batch_stats(inputs.obs(spark, d)).select("batch", "n")


def batch_sum(spark, d):
    return show(stats.batch_stats(inputs.obs(spark, d)), "batch", total="total")


def batch_mean(spark, d):
    return show(stats.batch_stats(inputs.obs(spark, d)), "batch", mean="mean")


def batch_stddev(spark, d):
    return show(stats.batch_stats(inputs.obs(spark, d)), "batch", sd="sd")


def neighbour_mean(spark, d):
    means = stats.neighbour_mean(inputs.obs(spark, d), inputs.edges(spark, d), "value")
    return show(means, "batch", "node", mean="mean")


def result_counts(spark, d):
    obs = inputs.obs(spark, d)
    return stats.result_counts(obs, stats.spatial_lisa(obs, inputs.edges(spark, d)))


def word_count(spark, d):
    return words.word_count(inputs.table(spark, d, "documents"))


# Core statistics --------------------------------------------------------------


def standardise(spark, d):
    return show(stats.standardise(inputs.obs(spark, d)), "batch", "node", z="z")


def spatial_lag(spark, d):
    lag = stats.spatial_lag(inputs.scores(spark, d), inputs.edges(spark, d))
    return show(lag, "batch", "node", lag="lag")


def spatial_lisa(spark, d):
    lisa = stats.spatial_lisa(inputs.obs(spark, d), inputs.edges(spark, d))
    return show(lisa, "batch", "node", z="z", lag="lag", lisa="lisa")


def spatial_lisa_multi(spark, d):
    rows = inputs.readings(spark, d).select("event_id", "batch", "node", "value")
    lisa = stats.spatial_lisa(rows, inputs.edges(spark, d))
    return show(lisa, "event_id", "batch", "node", lisa="lisa")


def one_per_node(spark, d):
    return stats.one_per_node(inputs.readings(spark, d), ["ts", "event_id"])


# Histories and the temporal statistic -----------------------------------------


def history_arrays(spark, d):
    hist = inputs.histories(spark, d)
    names = [f"v{i}" for i in range(K)]
    return hist.select("batch", "node", F.size("vals").alias("n"), *spread_out(F.col("vals"), names))


def split_history(spark, d):
    parts = temporal.split_history(inputs.histories(spark, d))
    names = [f"p{i}" for i in range(1, K)]
    return parts.select(
        "batch", "node", r6("value").alias("value"), F.size("past").alias("n_past"),
        *spread_out(F.col("past"), names),
    )


def history_flat(spark, d):
    flat = temporal.history_flat(inputs.histories(spark, d))
    return show(flat, "batch", "node", "label", value="value")


def lag_stats(spark, d):
    rows = temporal.lag_rows(inputs.histories(spark, d)).where("lag > 0")
    return show(temporal.lag_stats(rows), "batch", "lag", mean="mean", sd="sd")


def past_standardise(spark, d):
    rows = temporal.lag_rows(inputs.histories(spark, d)).where("lag > 0")
    return show(temporal.past_standardise(rows), "batch", "node", "lag", z="z")


def _lagged_scores(spark, d, anchor="oldest"):
    return temporal.past_standardise(temporal.lag_rows(inputs.histories(spark, d), anchor))


def past_neighbour_values(spark, d):
    found = temporal.past_neighbour_values(_lagged_scores(spark, d), inputs.edges(spark, d))
    return show(found, "batch", "node", "n", total="total")


def temporal_lag(spark, d):
    lag = temporal.temporal_lag(_lagged_scores(spark, d), inputs.edges(spark, d))
    return show(lag, "batch", "node", lag="lag")


def temporal_lisa(spark, d):
    lisa = temporal.temporal_lisa(inputs.obs(spark, d), inputs.edges(spark, d), K)
    return show(lisa, "batch", "node", lisa="lisa")


def temporal_lisa_latest(spark, d):
    lisa = temporal.temporal_lisa(inputs.obs(spark, d), inputs.edges(spark, d), K, "latest")
    return show(lisa, "batch", "node", lisa="lisa")


# Monte Carlo ------------------------------------------------------------------


def _n(spark, d):
    return montecarlo.node_count(inputs.nodes(spark, d))


def _keys(spark, d):
    return inputs.obs(spark, d).select("batch", "node")


def random_sets(spark, d):
    sets = montecarlo.random_sets(_keys(spark, d), _n(spark, d), R_TEMPORAL, SEED)
    return sets.select("batch", "node", "draw", joined("members"))


def random_sets_shared(spark, d):
    sets = montecarlo.random_sets(inputs.nodes(spark, d), _n(spark, d), R, SEED, by=["node"])
    return sets.select("node", "draw", joined("members"))


def enumerated_sets(spark, d):
    keys = inputs.grouped_obs(spark, d).select("batch", "node")
    sets = montecarlo.random_sets(keys, 15, R, SEED)
    return sets.select("batch", "node", "draw", joined("members"))


def explode_sets(spark, d):
    sets = montecarlo.random_sets(_keys(spark, d), _n(spark, d), R_TEMPORAL, SEED)
    flat = montecarlo.explode_sets(montecarlo.nest_sets(sets))
    return flat.select("batch", "node", "draw", joined("members"))


def set_members(spark, d):
    sets = montecarlo.random_sets(_keys(spark, d), _n(spark, d), R_TEMPORAL, SEED)
    return montecarlo.set_members(sets).select("batch", "node", "draw", "member")


def _set_means(spark, d):
    z = materialise(inputs.scores(spark, d), "z")
    sets = montecarlo.random_sets(z, _n(spark, d), R_TEMPORAL, SEED)
    return montecarlo.random_set_mean(sets, z)


def random_set_mean(spark, d):
    return show(_set_means(spark, d), "batch", "node", "draw", mean="mean")


def simulated_lisa(spark, d):
    return show(montecarlo.simulated_lisa(_set_means(spark, d)), "batch", "node", "draw", sim="sim")


def rank_position(spark, d):
    z = materialise(inputs.scores(spark, d), "z")
    lisa = stats.lisa_from_z(z, inputs.edges(spark, d))
    sets = montecarlo.random_sets(lisa, _n(spark, d), R_TEMPORAL, SEED)
    ranked = montecarlo.rank_position(
        montecarlo.simulated_lisa(montecarlo.random_set_mean(sets, z))
    )
    return show(ranked, "batch", "node", "below", "n", position="position")


def _mc(df):
    return show(df, "batch", "node", "below", "n", lisa="lisa", position="position")


def spatial_lisa_mc(spark, d):
    obs, edges = inputs.obs(spark, d), inputs.edges(spark, d)
    return _mc(montecarlo.spatial_lisa_mc(obs, edges, _n(spark, d), R, SEED))


def spatial_lisa_mc_shared(spark, d):
    obs, edges = inputs.obs(spark, d), inputs.edges(spark, d)
    return _mc(montecarlo.spatial_lisa_mc(obs, edges, _n(spark, d), R, SEED, "shared"))


def spatial_lisa_mc_small(spark, d):
    obs = inputs.grouped_obs(spark, d)
    edges = topology.grid_edges(obs.select("node").distinct(), inputs.WIDTH)
    return _mc(montecarlo.spatial_lisa_mc(obs, edges, 15, R, SEED))


def spatial_lisa_mc_whole(spark, d):
    """The whole table as a single batch, with 1000 sets per node."""
    rows = inputs.readings(spark, d).withColumn("batch", F.to_date(F.lit("2024-01-01")))
    edges = inputs.edges(spark, d)
    return _mc(montecarlo.spatial_lisa_mc(inputs.daily(rows), edges, _n(spark, d), R_WHOLE, SEED))


def _temporal_mc(spark, d, scope):
    obs, edges = inputs.obs(spark, d), inputs.edges(spark, d)
    return _mc(
        montecarlo.temporal_lisa_mc(obs, edges, _n(spark, d), K, R_TEMPORAL, SEED, scope)
    )


def temporal_mc_local(spark, d):
    return _temporal_mc(spark, d, "local")


def temporal_mc_global(spark, d):
    return _temporal_mc(spark, d, "global")


# Topology ---------------------------------------------------------------------


def node_map(spark, d):
    return topology.node_map(inputs.grid(spark, d)).select("node", joined("neighbours"))


def map_to_neighbours(spark, d):
    rows = stats.map_to_neighbours(inputs.obs(spark, d), inputs.edges(spark, d))
    return show(rows, "batch", "node", value="value")


def station_assignment(spark, d):
    customers = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return topology.assign_stations(customers, N_STATIONS)


def grid_edges(spark, d):
    return inputs.grid(spark, d)


def undirected_links(spark, d):
    return topology.undirected_links(inputs.grid(spark, d))


def grid_layout(spark, d):
    return topology.grid_layout(inputs.nodes(spark, d))


def graph_json(spark, d):
    return topology.graph_json(inputs.nodes(spark, d), inputs.grid(spark, d))


def topology_check(spark, d):
    """The grid with faults added: every node also links to twice its number, the first
    ids occur again, and all customers count as station members."""
    nodes = inputs.nodes(spark, d)
    faulty = inputs.edges(spark, d).unionByName(
        nodes.select(F.col("node").alias("src"), (F.col("node") * 2).alias("dst"))
    )
    again = nodes.select(((F.col("node") - 1) % N_STATIONS + 1).alias("node")).distinct()
    members = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return topology.check_topology(nodes.unionByName(again), faulty, members)


# Sources and sinks: files rendered from the tables, then read back ------------


def adjacency_edges(spark, d):
    """Matrix with the edges below the diagonal and ones on it; nothing above."""
    nodes, edges = inputs.nodes(spark, d), inputs.edges(spark, d)
    n, path = nodes.count(), fresh_path(spark, "matrix")
    ones = edges.where("dst < src").unionByName(
        nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    )
    # The narrow rows are sorted; their lines, of n cells each, are made where they are written, packed.
    before = lambda i: F.coalesce(F.get("neighbours", i - 1), F.lit(0))
    cells = F.transform(
        "neighbours", lambda j, i: F.concat(F.repeat(F.lit("0,"), (j - before(i) - 1).cast("int")), F.lit("1"))
    )
    last = F.try_element_at("neighbours", F.lit(-1))
    line = F.concat(F.array_join(cells, ","), F.repeat(F.lit(",0"), (F.lit(n) - last).cast("int")))
    blank = F.concat(F.repeat(F.lit("0,"), F.lit(n - 1)), F.lit("0"))
    rows = materialise(topology.node_map(ones).select("node", "neighbours"), "rows")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n * n // CELLS_PER_TASK))
    rows = rows.repartitionByRange(tasks, "node").sortWithinPartitions("node")
    rows.select(F.coalesce(line, blank).alias("value")).write.option("compression", "gzip").text(path)
    return text.read_adjacency(spark, path)


def xml_topology(spark, d):
    nodes, edges = inputs.nodes(spark, d), inputs.grid(spark, d)
    path = fresh_path(spark, "topology")

    def ids(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    listed = topology.node_map(edges).select(
        ids("node", "node").alias("_nodeId"),
        F.transform("neighbours", lambda n: F.concat(F.lit("node"), n.cast("string"))).alias("neighbour"),
    )
    # A station's nodes are listed over several elements of at most 100 each.
    dealt = topology.assign_stations(nodes, N_STATIONS).withColumn("_part", F.floor(F.col("node") / 500))
    stations = dealt.groupBy("station", "_part").agg(F.collect_list(ids("node", "node")).alias("node"))
    for name, tag, rows in (
        ("nodes", "node", listed),
        ("stations", "basestation", stations.select(ids("station", "station").alias("_stationId"), "node")),
    ):
        writer = rows.write.format("xml").option("rootTag", "topology").option("rowTag", tag)
        writer.save(f"{path}/{name}")
    got_edges, got_stations = xml.read_topology_xml(spark, [f"{path}/nodes", f"{path}/stations"])
    return got_edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        got_stations.select(F.lit("station").alias("kind"), F.col("station").alias("a"), F.col("node").alias("b"))
    )


def keyed_values(spark, d):
    path = fresh_path(spark, "keyed")
    line = F.concat(
        F.lit("node"), F.col("node").cast("string"), F.lit("_"),
        F.date_format("batch", "yyyyMMdd"), F.lit(";"), F.col("value").cast("string"),
    )
    rows = inputs.readings(spark, d).orderBy("ts", "event_id")
    rows.select(line.alias("value")).write.text(path)
    return text.read_keyed_values(spark, path)


def wide_values(spark, d):
    """One line per order item with four measures."""
    path = fresh_path(spark, "wide")
    items = inputs.table(spark, d, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    line = F.concat(F.concat_ws(";", *[F.col(m).cast("string") for m in measures]), F.lit(";"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *measures]
    items.orderBy(*order).select(line.alias("value")).write.text(path)
    return text.read_wide_values(spark, path)


def tuple_values(spark, d):
    path = fresh_path(spark, "tuples")
    line = F.concat(
        F.lit("("), F.date_format("batch", "yyyyMMdd"), F.lit(",("),
        F.col("node").cast("string"), F.lit(","), F.col("value").cast("string"), F.lit("))"),
    )
    inputs.obs(spark, d).select(line.alias("value")).write.text(path)
    columns = [("count", "string"), ("node", "bigint"), ("value", "double")]
    return show(text.read_tuples(spark, path, columns), "count", "node", value="value")


def tuple_sets(spark, d):
    """Sets drawn one after the other until enough are different, through text."""
    path = fresh_path(spark, "sets")
    sets = montecarlo.random_sets(_keys(spark, d), _n(spark, d), R_TEMPORAL, SEED, independent=True)
    sinks.write_sets(sets, path, sinks.SETS)
    return text.read_tuple_sets(spark, f"{path}/{sinks.SETS}").select(
        "batch", "node", joined("members")
    )


def write_batches(spark, d):
    path = fresh_path(spark, "results")
    lisa = stats.spatial_lisa(inputs.obs(spark, d), inputs.edges(spark, d))
    sinks.write_batches(lisa, path, sinks.LISA, "text", ("node", "lisa"))
    columns = [("node", "bigint"), ("lisa", "double")]
    return show(text.read_tuples(spark, f"{path}/{sinks.LISA}", columns), "batch", "node", lisa="lisa")


# Streaming --------------------------------------------------------------------


def _run(spark, name, start):
    """Start a job over fresh folders, wait for it, and read what it stored."""
    path = fresh_path(spark, "stream")
    query = start(f"{path}/results", f"{path}/checkpoint", f"{path}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/results/{name}")


def _run_in_parts(spark, d, name, start):
    """The same over events that arrive in two parts, split at a day in the middle.

    The job drains the first part, stops, and goes on from its checkpoint with the second.
    Several names give a list of results.
    """
    path, events = fresh_path(spark, "stream"), inputs.table(spark, d, "events")
    day = F.col("ts").cast("date")
    span = events.agg(F.min(day).alias("low"), F.max(day).alias("high")).first()
    middle = F.lit(span.low + (span.high - span.low) / 2)
    for part in (events.where(day <= middle), events.where(day > middle)):
        part.write.mode("append").parquet(f"{path}/events")
        source = spark.readStream.schema(events.schema).parquet(f"{path}/events")
        start(inputs.as_readings(source), f"{path}/results", f"{path}/checkpoint", f"{path}/state").awaitTermination()
    if not isinstance(name, str):
        return [spark.read.parquet(f"{path}/results/{n}") for n in name]
    return spark.read.parquet(f"{path}/results/{name}")


def _second():
    """The zone-free event time as seconds, whatever the session's time zone."""
    return F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86400 + (
        F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    )


def _run_cut(spark, d, name, start, parts=4):
    """The same over events that arrive in parts of equal time, which cut days in two.

    The last part ends with a reading of no node, two days later, which closes all days.
    """
    path, events = fresh_path(spark, "stream"), inputs.table(spark, d, "events")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    span = events.agg(F.min(_second()).alias("low"), F.max(_second()).alias("high")).first()
    step = (span.high - span.low) // parts + 1
    for i in range(parts):
        part = events.where(F.floor((_second() - span.low) / step) == i)
        part = part.unionByName(end, allowMissingColumns=True) if i == parts - 1 else part
        part.write.mode("append").parquet(f"{path}/events")
        rows = inputs.as_readings(spark.readStream.schema(events.schema).parquet(f"{path}/events"))
        start(rows, f"{path}/results", f"{path}/checkpoint", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/results/{name}")


def _stream_readings(spark, d):
    return inputs.as_readings(inputs.stream(spark, d, "events"))


def stream_observations(spark, d):
    rows = _stream_readings(spark, d).select("event_id", "batch", "node", "value")

    def start(sink, checkpoint, _):
        writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start(f"{sink}/{sinks.VALUES}")

    return _run(spark, sinks.VALUES, start)


def stream_spatial_lisa(spark, d):
    edges = inputs.edges(spark, d)
    found = _run_in_parts(
        spark, d, sinks.LISA,
        lambda rows, sink, checkpoint, _: jobs.stream_lisa(
            rows, sink, checkpoint, lambda df: stats.spatial_lisa(inputs.daily(df), edges)
        ),
    )
    return show(found, "batch", "node", lisa="lisa")


def _open_lisa(spark, d, readings):
    """Days that are spread over micro-batches; a day closes an hour after its end."""
    edges, closes = inputs.edges(spark, d), (F.unix_date("batch").cast("bigint") + 1) * 86400
    return _run_cut(
        spark, d, sinks.LISA,
        lambda rows, sink, checkpoint, state: stream_open_lisa_job(
            rows, edges, _second(), closes, 3600, state, sink, checkpoint, readings
        ),
    )


def stream_open_lisa(spark, d):
    return show(_open_lisa(spark, d, "mean"), "batch", "node", lisa="lisa")


def stream_open_lisa_multi(spark, d):
    return show(_open_lisa(spark, d, "each"), "event_id", "batch", "node", lisa="lisa")


def stream_window_lisa_multi(spark, d):
    edges = inputs.edges(spark, d)

    def start(rows, sink, checkpoint, _):
        rows = rows.select(F.timestamp_seconds(_second()).alias("ts"), "event_id", "node", "value")
        return jobs.stream_window_lisa_multi(rows, edges, "1 day", "1 hour", sink, checkpoint)

    found = _run_cut(spark, d, sinks.LISA, start, parts=3)
    day = F.date_from_unix_date(F.floor(F.unix_seconds("batch") / 86400).cast("int"))
    return show(found.withColumn("batch", day), "event_id", "batch", "node", lisa="lisa")


def stream_window_lisa(spark, d):
    edges, second = inputs.edges(spark, d), _second()
    # A reading of no node, two days later, closes the last day.
    path, events = fresh_path(spark, "closed"), inputs.table(spark, d, "events").select("ts", "user_id", "value")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    events.unionByName(end, allowMissingColumns=True).write.parquet(path)
    rows = spark.readStream.schema(events.schema).parquet(path).select(
        F.timestamp_seconds(second).alias("ts"), (F.col("user_id") + 1).alias("node"), "value"
    )
    found = _run(
        spark, sinks.LISA,
        lambda sink, checkpoint, _: jobs.stream_window_lisa(
            rows, edges, "1 day", "1 hour", sink, checkpoint
        ),
    )
    day = F.date_from_unix_date(F.floor(F.unix_seconds("batch") / 86400).cast("int"))
    return show(found.withColumn("batch", day), "batch", "node", lisa="lisa")


def stream_history(spark, d):
    """Readings in the order of their time, over micro-batches that cut days in two."""
    hist = _run_cut(
        spark, d, sinks.VALUES,
        lambda rows, sink, checkpoint, state: jobs.stream_history(
            rows, K, state, sink, checkpoint, order=["ts", "event_id"]
        ),
    )
    hist = hist.where("event_id is not null")  # without the reading that closes the days
    names = [f"v{i}" for i in range(K)]
    return hist.select("event_id", "node", F.size("vals").alias("n"), *spread_out(F.col("vals"), names))


def stream_temporal_lisa(spark, d):
    edges = inputs.edges(spark, d)
    found = _run_in_parts(
        spark, d, sinks.LISA,
        lambda rows, sink, checkpoint, state: jobs.stream_temporal_lisa(
            rows, edges, K, state, sink, checkpoint, before=inputs.daily
        ),
    )
    return show(found, "batch", "node", lisa="lisa")


def _stream_temporal_mc(spark, d, scope):
    edges, n = inputs.edges(spark, d), _n(spark, d)
    found = _run_in_parts(
        spark, d, sinks.POSITIONS,
        lambda rows, sink, checkpoint, state: jobs.stream_temporal_mc(
            rows, edges, n, K, R_TEMPORAL, SEED, state, sink, checkpoint, scope, before=inputs.daily
        ),
    )
    return _mc(found)


def stream_temporal_mc_local(spark, d):
    return _stream_temporal_mc(spark, d, "local")


def stream_temporal_mc_global(spark, d):
    return _stream_temporal_mc(spark, d, "global")


def _stream_lisa_mc(spark, d, *names):
    edges, n = inputs.edges(spark, d), _n(spark, d)
    return _run_in_parts(
        spark, d, names,
        lambda rows, sink, checkpoint, _: jobs.stream_spatial_mc(
            rows, edges, n, R_TEMPORAL, SEED, sink, checkpoint, before=inputs.daily
        ),
    )


def stream_lisa_mc(spark, d):
    return _mc(*_stream_lisa_mc(spark, d, sinks.POSITIONS))


def stored_positions(spark, d):
    """Positions recomputed from what a Monte Carlo stream has stored: readings, sets, statistic."""
    values, sets, lisa = _stream_lisa_mc(spark, d, sinks.VALUES, sinks.SETS, sinks.LISA)
    z = materialise(stats.standardise(values).select("batch", "node", "z"), "z")
    found = verify.expected_positions(z, sets.drop("batch_id"), lisa.drop("batch_id"), drawn=True)
    return show(found, "batch", "node", position="position")


def stream_word_count(spark, d):
    found = _run(
        spark, "words",
        lambda sink, checkpoint, _: jobs.stream_lisa(
            inputs.stream(spark, d, "documents").select("text"), sink, checkpoint,
            lambda df: words.word_count(df, by=["batch"]), name="words",
        ),
    )
    return found.select("batch", "word", "n")


def batch_metrics(spark, d):
    path = fresh_path(spark, "stream")
    writer = _stream_readings(spark, d).writeStream.format("noop")
    query = writer.option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    metrics = jobs.batch_metrics(spark, query)
    return metrics.where("num_input_rows > 0").select("batch_id", "num_input_rows")


# Verification and run analytics -----------------------------------------------


def expected_lisa(spark, d):
    found = verify.expected_lisa(inputs.obs(spark, d), inputs.edges(spark, d))
    return show(found, "batch", "node", lisa="lisa")


def expected_positions(spark, d):
    """Positions out of sets stored as text, which do not number the draws."""
    z = materialise(inputs.scores(spark, d), "z")
    path = fresh_path(spark, "sets")
    sinks.write_sets(
        montecarlo.random_sets(z, _n(spark, d), R_TEMPORAL, SEED), path, sinks.SETS
    )
    sets = text.read_tuple_sets(spark, f"{path}/{sinks.SETS}")
    sets = sets.withColumn("draw", F.monotonically_increasing_id())
    lisa = stats.lisa_from_z(z, inputs.edges(spark, d)).select("batch", "node", "lisa")
    return show(verify.expected_positions(z, sets, lisa, drawn=True), "batch", "node", position="position")


def compare_results(spark, d):
    """Differences from the recomputation by degree, and from a shifted copy."""
    obs, edges = inputs.obs(spark, d), inputs.edges(spark, d)
    lisa = materialise(stats.spatial_lisa(obs, edges).select("batch", "node", "lisa"), "lisa")
    shifted = lisa.withColumn(
        "lisa", F.col("lisa") + F.when(F.col("node") % 2 == 0, 0.001).otherwise(0.0)
    )
    by = ["batch", "node"]
    checks = {
        "degree": verify.compare_results(lisa, verify.expected_lisa(obs, edges), by, "lisa", tol=1e-6),
        "shifted": verify.compare_results(lisa, shifted, by, "lisa", digits=9),
    }
    parts = [df.select(F.lit(name).alias("check"), "bad") for name, df in checks.items()]
    return parts[0].unionByName(parts[1])


def _day_ms(day):
    return (F.unix_date(day) * F.lit(86400000).cast("bigint")).cast("string")


def parse_delays(spark, d):
    """Scheduler log with one duration line and one other line per event."""
    path = fresh_path(spark, "log")
    ms, seconds = _day_ms(F.col("ts").cast("date")), F.col("value").cast("string")
    delay = F.concat(
        F.lit("24/01/01 00:00:00 INFO JobScheduler: Total delay: "), seconds,
        F.lit(" s for time "), ms, F.lit(" ms (execution: "), seconds, F.lit(" s)"),
    )
    other = F.concat(F.lit("24/01/01 00:00:00 INFO JobScheduler: Added jobs for time "), ms, F.lit(" ms"))
    lines = inputs.table(spark, d, "events").select(F.explode(F.array(delay, other)).alias("value"))
    lines.write.text(path)
    return show(runs.parse_delays(spark.read.text(path)), "batch", seconds="seconds")


def _median_lines(lines):
    """Lines of the median part, rounded down: parts with more of them count as data."""
    parts = lines.groupBy("batch", "file").count()
    return int(parts.agg(F.percentile("count", F.lit(0.5)).alias("m")).first().m or 0)


def batches_with_data(spark, d):
    """Part files of each day; a day counts when one of them has more lines than the median part."""
    path = fresh_path(spark, "parts")
    rows = inputs.readings(spark, d).withColumn("part", F.col("event_id") % 8)
    rows.repartition("batch", "part").select(
        "batch", "part", F.concat_ws(",", F.col("node").cast("string"), F.col("value").cast("string")).alias("value")
    ).write.partitionBy("batch", "part").text(path)
    lines = spark.read.text(path).select("batch", F.col("_metadata.file_path").alias("file"))
    return runs.batches_with_data(lines, min_rows=_median_lines(lines))


def run_durations(spark, d):
    day = _day_ms(F.col("batch"))
    rows = inputs.readings(spark, d)
    lines = rows.select(day.alias("batch"), (F.col("event_id") % 8).alias("file"))
    delays = rows.select("event_id", day.alias("batch"), F.col("value").alias("seconds"))
    return runs.run_durations(delays, runs.batches_with_data(lines, min_rows=_median_lines(lines)))


def _summary(df, *by):
    return show(df, *by, **{c: c for c in ("min", "p25", "p50", "p75", "max", "avg", "std_dev")})


def duration_summary(spark, d):
    return _summary(runs.duration_summary(inputs.durations(spark, d), ["base", "run"]), "base", "run")


def duration_summary_combined(spark, d):
    return _summary(runs.duration_summary(inputs.durations(spark, d), ["base"]), "base")


def run_averages_wide(spark, d):
    wide = runs.run_averages_wide(inputs.durations(spark, d), len(RUNS))
    return show(wide, "base", **{f"avg{i}": f"avg{i}" for i in range(1, len(RUNS) + 1)})


def history_pivot(spark, d):
    wide = runs.history_pivot(inputs.durations(spark, d))
    return show(wide, "k", **{c: c for c in wide.columns if c != "k"})


def topology_averages(spark, d):
    return show(runs.topology_averages(inputs.durations(spark, d)), "topology", avg="avg")


def run_averages(spark, d):
    return show(runs.run_averages(inputs.durations(spark, d)), "base", "no", avg="avg")


def history_averages(spark, d):
    return show(runs.history_averages(inputs.durations(spark, d)), "k", "base", avg="avg")


def run_series(spark, d):
    return runs.run_series(inputs.durations(spark, d), ["batch", "event_id"])


def run_series_wide(spark, d):
    return runs.run_series_wide(inputs.durations(spark, d), RUNS, ["batch", "event_id"])


def duration_by_k(spark, d):
    return runs.duration_by_k(inputs.durations(spark, d))


QUERIES = [
    spatial_lisa, batch_count, batch_sum, batch_mean, batch_stddev, neighbour_mean, result_counts,
    word_count, standardise, spatial_lag, spatial_lisa_multi, one_per_node, history_arrays,
    split_history, history_flat, lag_stats, past_standardise, past_neighbour_values, temporal_lag,
    temporal_lisa, temporal_lisa_latest, random_sets, random_sets_shared, enumerated_sets,
    explode_sets, set_members, random_set_mean, simulated_lisa, rank_position, spatial_lisa_mc,
    spatial_lisa_mc_shared, spatial_lisa_mc_small, spatial_lisa_mc_whole, temporal_mc_local, temporal_mc_global, node_map,
    map_to_neighbours, station_assignment, grid_edges, undirected_links, grid_layout, graph_json,
    topology_check, adjacency_edges, xml_topology, keyed_values, wide_values, tuple_values,
    tuple_sets, write_batches, stream_observations, stream_spatial_lisa, stream_window_lisa,
    stream_history, stream_temporal_lisa, stream_lisa_mc, stream_word_count, batch_metrics,
    expected_lisa, expected_positions, compare_results, parse_delays, batches_with_data,
    run_durations, duration_summary, duration_summary_combined, run_averages_wide, history_pivot,
    topology_averages, run_series_wide, duration_by_k, run_averages, history_averages, run_series,
    stream_temporal_mc_local, stream_temporal_mc_global, stream_open_lisa, stream_open_lisa_multi,
    stream_window_lisa_multi, stored_positions,
]


def queries():
    return {query.__name__: query for query in QUERIES}
