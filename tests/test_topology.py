import pytest
from conftest import LINKS, STATIONS, rows_of

from localstat.operators import topology
from localstat.sources.text import read_adjacency, read_lines
from localstat.sources.xml import read_topology_xml

BOTH = sorted(LINKS + [(b, a) for a, b in LINKS])


def write_matrix(path, links, n, parts=1, noise=False):
    path.mkdir()
    low = {(max(a, b), min(a, b)) for a, b in links}
    lines = []
    for i in range(1, n + 1):
        cells = ["1" if (i, j) in low or (noise and j >= i) else "0" for j in range(1, n + 1)]
        lines.append(",".join(cells))
    size = -(-n // parts)
    for p in range(parts):
        (path / f"part-{p:05d}.txt").write_text("\n".join(lines[p * size : (p + 1) * size]) + "\n")
    (path / "_SUCCESS").write_text("")
    return str(path)


def test_matrix_reads_lower_triangle_only(spark, tmp_path):
    path = write_matrix(tmp_path / "m", LINKS, 16, noise=True)
    assert rows_of(read_adjacency(spark, path), "src", "dst") == BOTH


def test_matrix_in_several_files_and_splits(spark, tmp_path):
    path = write_matrix(tmp_path / "m", LINKS, 16, parts=3)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        assert rows_of(read_adjacency(spark, path), "src", "dst") == BOTH
        assert rows_of(read_lines(spark, path), "line") == [(i,) for i in range(16)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_xml(spark, tmp_path, neighbours):
    nodes = "".join(
        f'<node nodeId="node{n}">' + "".join(f"<neighbour>node{m}</neighbour>" for m in sorted(ms)) + "</node>\n"
        for n, ms in neighbours.items()
    )
    stations = "".join(
        f'<basestation stationId="station{s}">' + "".join(f"<node>node{n}</node>" for n in ns) + "</basestation>\n"
        for s, ns in STATIONS.items()
    )
    path = tmp_path / "topology.xml"
    path.write_text(f'<?xml version="1.0"?>\n<topology xmlns="http://example.org/t">\n{nodes}{stations}</topology>\n')
    edges, members = read_topology_xml(spark, str(path))
    assert rows_of(edges, "src", "dst") == BOTH
    assert rows_of(members, "station", "node") == sorted((s, n) for s, ns in STATIONS.items() for n in ns)


def test_symmetrise_drops_loops_and_repeats(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 3)], "src BIGINT, dst BIGINT")
    assert rows_of(topology.symmetrise(edges), "src", "dst") == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_node_map(graph, neighbours):
    found = {r.node: r.neighbours for r in topology.node_map(graph).collect()}
    assert found == {n: sorted(ms) for n, ms in neighbours.items()}
    parts = topology.node_map(graph, longest=2).orderBy("node", "part").collect()
    assert all(len(r.neighbours) <= 2 for r in parts)
    assert {n: [m for r in parts if r.node == n for m in r.neighbours] for n in found} == found


def test_ids_with_gaps_are_numbered(spark):
    nodes = spark.createDataFrame([(70,), (5,), (None,), (11,), (5,)], "node BIGINT")
    ids = topology.dense_ids(nodes)
    assert rows_of(ids, "node", "id") == [(5, 1), (11, 2), (70, 3)]
    edges = spark.createDataFrame([(5, 70), (11, 5), (11, 99)], "src BIGINT, dst BIGINT")
    assert rows_of(topology.renumbered(edges, ids, "src", "dst"), "src", "dst") == [(1, 3), (2, 1)]


def test_element_ids_are_unique(spark, graph):
    nodes = graph.select(graph.src.alias("node")).distinct()
    elements = spark.createDataFrame([("node1",), ("node2",), ("station1",), ("node2",)], "id STRING")
    got = topology.check_topology(nodes, graph, elements=elements).where("rule = 'duplicate_element_id'")
    assert rows_of(got, "node", "n") == [(2, 2)]


def test_ranked_neighbours_with_a_hub(spark):
    hub = spark.range(2, 500).selectExpr("1L AS src", "id AS dst").unionByName(
        spark.range(2, 500).selectExpr("id AS src", "1L AS dst")
    )
    want = sorted([(1, n, n - 2) for n in range(2, 500)] + [(n, 1, 0) for n in range(2, 500)])
    for limit in (10_000, 50):
        assert rows_of(topology.ranked_neighbours(hub, limit), "src", "dst", "pos") == want


def test_grid(spark):
    nodes = spark.range(1, 12).withColumnRenamed("id", "node")
    want = set()
    for n in range(1, 12):
        row, col = divmod(n - 1, 4)
        for r, c in ((row - 1, col), (row + 1, col), (row, col - 1), (row, col + 1)):
            m = r * 4 + c + 1
            if r >= 0 and 0 <= c < 4 and m <= 11:
                want.add((n, m))
    assert rows_of(topology.grid_edges(nodes, 4), "src", "dst") == sorted(want)


def test_stations(spark):
    nodes = spark.range(1, 13).withColumnRenamed("id", "node")
    found = {r.node: r.station for r in topology.assign_stations(nodes, 4).collect()}
    assert found == {n: (n - 1) % 4 + 1 for n in range(1, 13)}
    with pytest.raises(ValueError):
        topology.assign_stations(nodes, 5)


def test_layout_and_json(spark, graph):
    nodes = spark.range(1, 17).withColumnRenamed("id", "node")
    found = {r["index"]: (r.x, r.y) for r in topology.grid_layout(nodes).collect()}
    assert found == {i: (i % 4 * 60 + 20, i // 4 * 60 + 20) for i in range(16)}
    rows = topology.graph_json(nodes, graph).collect()
    assert sum(r.section == "links" for r in rows) == 15
    assert '{"sensorId":"node0","fixed":true,"group":1,"x":20,"y":20}' in [r.json for r in rows]


def test_check_topology(spark):
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 6)], "node BIGINT")
    pairs = [(1, n) for n in (2, 3, 4, 5, 6)] + [(2, 1), (2, 1), (3, 9), (8, 1)]
    edges = spark.createDataFrame(pairs, "src BIGINT, dst BIGINT")
    stations = spark.createDataFrame([(1, 1), (1, 7)], "station BIGINT, node BIGINT")
    assert rows_of(topology.check_topology(nodes, edges, stations), "rule", "node", "n") == [
        ("degree", 1, 5),
        ("duplicate_id", 6, 2),
        ("duplicate_neighbour", 2, 1),
        ("unknown_neighbour", 9, 1),
        ("unknown_source", 8, 1),
        ("unknown_station_node", 7, 1),
    ]


def test_sample_graph_is_valid(spark, graph):
    nodes = spark.range(1, 17).withColumnRenamed("id", "node")
    assert topology.check_topology(nodes, graph).count() == 0
