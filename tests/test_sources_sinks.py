import os

from conftest import obs_frame, rows_of

from localstat import sinks
from localstat.operators import words
from localstat.plans import inputs, registered
from localstat.sources import text


def lines_file(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))
    return str(folder)


def test_keyed_values_last_line_wins(spark, tmp_path):
    folder = tmp_path / "keyed"
    lines_file(folder, "a.txt", ["node7_42;0.31", "node7_42;0.5", "node12_AB12CD;-1.5e-3"])
    path = lines_file(folder, "b.txt", ["node7_43;1", "node7_42;0.75", "node3;2.5"])
    got = text.read_keyed_values(spark, path).collect()
    assert {(r.node, r["count"]): r.value for r in got} == {
        (7, "42"): 0.75, (12, "AB12CD"): -0.0015, (7, "43"): 1.0, (3, None): 2.5,
    }


def test_wide_values(spark, tmp_path):
    path = lines_file(tmp_path / "wide", "a.txt", ["1.5;2;-3;", "4;5;6"])
    assert rows_of(text.read_wide_values(spark, path), "tick", "node", "value") == [
        (0, 1, 1.5), (0, 2, 2.0), (0, 3, -3.0), (1, 1, 4.0), (1, 2, 5.0), (1, 3, 6.0),
    ]


def test_one_file_per_node(spark, tmp_path):
    folder = tmp_path / "nodes"
    lines_file(folder, "0.txt", ["1.5;", "2.5;"])
    path = lines_file(folder, "11.txt", ["-1;", "0;", "4e-2;"])
    assert rows_of(text.read_node_files(spark, path), "node", "tick", "value") == [
        (1, 0, 1.5), (1, 1, 2.5), (12, 0, -1.0), (12, 1, 0.0), (12, 2, 0.04),
    ]


def test_tuples(spark, tmp_path):
    path = lines_file(tmp_path / "t", "part-00000", ["(7,0.31)", "(8,-1.0E-4)"])
    got = text.read_tuples(spark, path, [("node", "bigint"), ("value", "double")])
    assert rows_of(got, "node", "value") == [(7, 0.31), (8, -0.0001)]
    path = lines_file(tmp_path / "c", "part-00000", ["(42,(7,0.31))", "(43,(7, 0.5))"])
    got = text.read_tuples(spark, path, [("count", "string"), ("node", "bigint"), ("value", "double")])
    assert rows_of(got, "count", "node", "value") == [("42", 7, 0.31), ("43", 7, 0.5)]


def test_history_rows_as_tuples(spark, tmp_path):
    path = lines_file(tmp_path / "h", "part-00000", ["(7,(k-0,0.31))"])
    got = text.read_tuples(spark, path, [("node", "bigint"), ("lag", "string"), ("value", "double")])
    assert rows_of(got, "node", "lag", "value") == [(7, "k-0", 0.31)]


def test_tuple_sets(spark, tmp_path):
    path = lines_file(tmp_path / "s", "part-00000", ["(7,List(3, 12, 5))", "(8,List(1))"])
    got = {r.node: r.members for r in text.read_tuple_sets(spark, path).collect()}
    assert got == {7: [3, 12, 5], 8: [1]}


def test_text_results_round_trip(spark, tmp_path):
    obs = obs_frame(spark, [(b, n, b + n / 8) for b in range(3) for n in range(1, 6)])
    for _ in range(2):
        sinks.write_batches(obs, str(tmp_path), "allValues", "text")
    assert sorted(d for d in os.listdir(tmp_path / "allValues") if d.startswith("batch")) == [
        "batch=0", "batch=1", "batch=2",
    ]
    got = text.read_tuples(spark, f"{tmp_path}/allValues", [("node", "bigint"), ("value", "double")])
    assert rows_of(got, "batch", "node", "value") == rows_of(obs, "batch", "node", "value")


def test_parquet_results_and_sets_round_trip(spark, tmp_path):
    obs = obs_frame(spark, [(b, n, b + n / 8) for b in range(3) for n in range(1, 6)])
    sinks.write_batches(obs, str(tmp_path), "lisa")
    got = spark.read.parquet(f"{tmp_path}/lisa")
    assert rows_of(got, "batch", "node", "value") == rows_of(obs, "batch", "node", "value")
    sets = spark.createDataFrame([(0, 1, [2, 3]), (1, 4, [9])], "batch BIGINT, node BIGINT, members ARRAY<BIGINT>")
    sinks.write_sets(sets, str(tmp_path), "sets")
    back = text.read_tuple_sets(spark, f"{tmp_path}/sets")
    assert rows_of(back, "batch", "node", "members") == rows_of(sets, "batch", "node", "members")


def test_rewriting_a_micro_batch_replaces_it(spark, tmp_path):
    for value in (1.0, 2.0):
        sinks.write_batch(obs_frame(spark, [(0, 1, value)]), str(tmp_path), "lisa", 7)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/lisa").collect()] == [(0, 1, 2.0, 7)]


def test_words_split_like_the_job(spark):
    df = spark.createDataFrame([("a b ",), ("a  b",), ("   ",), ("",), (" c",), ("x\ty",)], "text STRING")
    got = {r.word: r.n for r in words.word_count(df).collect()}
    assert got == {"a": 2, "b": 2, "": 3, "c": 1, "x\ty": 1}


def test_writing_a_batch_leaves_the_others(spark, tmp_path):
    def write(rows):
        df = spark.createDataFrame(rows, "batch BIGINT, node BIGINT, value DOUBLE")
        sinks.write_batches(df, str(tmp_path), sinks.LISA)

    write([(1, 1, 0.5)])
    write([(2, 1, 1.5), (2, 2, 2.5)])
    write([(2, 1, 9.0)])
    got = spark.read.parquet(f"{tmp_path}/{sinks.LISA}")
    assert sorted((r.batch, r.node, r.value) for r in got.collect()) == [(1, 1, 0.5), (2, 1, 9.0)]


def test_bad_cells_are_reported(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("0,0,0\n1, ,x\n0,1,\n")
    assert sorted((r.src, r.dst) for r in text.read_adjacency(spark, str(path)).collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert [tuple(r) for r in text.bad_cells(spark, str(path)).collect()] == [(1, 2, "x")]


def test_split_counts_are_broadcast(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("a\nb\n")
    plan = text.read_lines(spark, str(path))._jdf.queryExecution().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan or "BroadcastHashJoin" in plan


def test_blank_and_malformed_lines(spark, tmp_path):
    """Blank lines are dropped, fields that are missing or no number are null."""

    def file(name, body):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.txt").write_text(body)
        return str(tmp_path / name)

    keyed = text.read_keyed_values(spark, file("keyed", "node1_5;0.5\n\n   \nnode2;x\nnode3_1\nrubbish;1\nnode1_5;0.75\n"))
    got = {(r.node, r["count"]): r.value for r in keyed.collect()}
    assert got == {(1, "5"): 0.75, (2, None): None, (3, "1"): None}
    columns = [("count", "bigint"), ("node", "bigint"), ("value", "double")]
    tuples = text.read_tuples(spark, file("tuples", "(1,(2,0.5))\n\n(3)\n(x,(4,y))\n"), columns)
    assert sorted(map(tuple, tuples.collect()), key=str) == sorted([(1, 2, 0.5), (3, None, None), (None, 4, None)], key=str)
    sets = text.read_tuple_sets(spark, file("sets", "(7,List(3, 12))\n\n(8,List())\n(z,List(1, q))\n"))
    assert {(r.node, tuple(r.members)) for r in sets.collect()} == {(7, (3, 12)), (8, ()), (None, (1,))}
    ticks = text.read_node_files(spark, file("ticks", "1.5;\n\nbad;\n2.5;\n"))
    assert sorted((r.node, r.tick, r.value) for r in ticks.where("value IS NOT NULL").collect()) == [(1, 0, 1.5), (1, 3, 2.5)]
    assert ticks.count() == 3


def test_lines_of_few_ones_are_cut_at_them(spark, tmp_path, monkeypatch):
    """The same edges whether a line is cut at its ones or into its cells, also of odd lines."""
    lines = ["1,1,1,1,1", "1,0,1,0,0", "0,1,0,1", "+1, 1,01,0,0", "1,1,1,1,1", "10,0,x,1,1,0", "0,", "1,1", "", "0,0,0,0,0,0,0,0,1,1"]
    path = tmp_path / "matrix.txt"
    path.write_text("\n".join(lines) + "\n")
    found = []
    for most in (1_000, 2, -1):
        monkeypatch.setattr(text, "FEW_ONES", most, raising=False)
        found.append(sorted((r.src, r.dst) for r in text.read_adjacency(spark, str(path)).collect()))
    lower = [(2, 1), (3, 2), (4, 1), (4, 2), (4, 3), (5, 1), (5, 2), (5, 3), (5, 4), (6, 4), (6, 5), (8, 1), (8, 2), (10, 9)]
    assert found[0] == found[1] == found[2] == sorted(lower + [(b, a) for a, b in lower])


def test_matrix_of_a_sparse_graph_is_written_packed(spark, tmp_path, monkeypatch):
    """The matrix has a cell for every two nodes; its files do not grow like that."""
    n, path = 800, str(tmp_path / "matrix")
    spark.range(n).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "0.5D AS value"
    ).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(registered, "fresh_path", lambda *_: path)
    got = sorted((r.src, r.dst) for r in registered.adjacency_edges(spark, str(tmp_path)).collect())
    assert got == sorted((r.src, r.dst) for r in inputs.grid(spark, str(tmp_path)).collect()) and len(got) > n
    rows = [r.value for r in spark.read.text(path).collect()]
    assert len(rows) == n and {len(r) for r in rows} == {2 * n - 1}
    assert sum(f.stat().st_size for f in (tmp_path / "matrix").rglob("part-*")) < n * n // 10
