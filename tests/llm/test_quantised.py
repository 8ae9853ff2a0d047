import numpy as np
import pyarrow.parquet as pq
import pytest

from localstat.llm import quantised, queries


def expected(rows, threshold=0.9):
    """Links, components and kept by comparing all pairs; rows are (vec_id, vector)."""
    n = len(rows)
    usable = [
        i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for i, v in rows
    ]
    units = [None] * n
    for k in range(n):
        if usable[k]:
            x = np.array(rows[k][1], float)
            x = x / np.abs(x).max()
            units[k] = x / np.linalg.norm(x)
    links, label = [0] * n, list(range(n))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(n):
        for b in range(a):
            if usable[a] and usable[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                links[a] += 1
                links[b] += 1
                label[root(a)] = root(b)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    out = []
    for k in range(n):
        i = rows[k][0]
        component = None if i is None else least[root(k)]
        out.append((i, links[k], component, i is None or i == component))
    return sorted(out, key=str)


def frame(spark, rows, kind="FLOAT"):
    """An embeddings table with clashing extra columns."""
    schema = f"vec_id BIGINT, embedding ARRAY<{kind}>, label INT, rep STRING, digest INT"
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], schema)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def planted(seed, n=400, width=24, groups=12, size=9, noise=0.12):
    """Random vectors, and groups of near copies around the threshold, as single-precision numbers."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=width) for _ in range(n)]
    for _ in range(groups):
        base = rng.normal(size=width)
        x += [base * rng.uniform(0.5, 3) + noise * rng.normal(size=width) for _ in range(size)]
    order = rng.permutation(len(x))
    return [(int(i), np.float32(x[k]).tolist()) for i, k in enumerate(order)]


def without_links_at_the_edge(rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(x @ x.T - 0.9).min() > 1e-9
    return rows


@pytest.mark.parametrize("noise", [0.1, 0.3])
def test_equals_brute_force(spark, noise):
    rows = without_links_at_the_edge(planted(1, noise=noise))
    assert got(quantised.near_duplicates(frame(spark, rows))) == expected(rows)


def test_blocks_and_many_lists(spark, monkeypatch):
    """Small blocks cut every list on both sides; nothing is broadcast."""
    monkeypatch.setattr(quantised, "BLOCK", 16)
    monkeypatch.setattr(quantised, "CHUNK", 5)
    monkeypatch.setattr("localstat.plans.scale.BROADCAST_ROWS", 0)
    rows = without_links_at_the_edge(planted(2, groups=3, size=70))
    assert got(quantised.near_duplicates(frame(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, []),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1.0, 0.1]),
        (11, [1.0, 0.0, 0.0]), (12, [5.0, 0.0, 0.0]), (13, [5.0]), (14, [1e-300, 0.0]), (15, [1e300, 1e299]), (9, [0.0, 1.0]),
        (16, [-0.0, 3.0]),
    ]
    assert got(quantised.near_duplicates(frame(spark, rows, "DOUBLE"))) == expected(rows)
    assert quantised.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    nothing = [(3, [0.0, 0.0]), (None, None)]
    assert got(quantised.near_duplicates(frame(spark, nothing))) == expected(nothing)


def test_tables_drop_no_link():
    """The bound that postings carry holds for partners at the threshold in every direction."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 40))
    model = quantised.Quantiser(x, len(x), 0.9)
    home, _, codes, least = model.post(x)
    unit = quantised.unit(x)
    for k in range(0, 3000, 150):
        w = rng.normal(size=(500, 40))
        w -= (w @ unit[k])[:, None] * unit[k]
        near = 0.9 * unit[k] + np.sqrt(1 - 0.81) * w / np.linalg.norm(w, axis=1, keepdims=True)
        assert model.passing(near.astype(np.float32), home[k], codes[k : k + 1].astype(np.intp), least[k : k + 1]).all()
    far = quantised.unit(rng.normal(size=(500, 40))).astype(np.float32)
    own = home == home[0]
    assert model.passing(far, home[0], codes[own].astype(np.intp), least[own]).mean() < 0.05


def test_recall_beyond_one_list(spark):
    """Pairs just above the threshold in a table of many lists: most are found, none below it."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    w = rng.normal(size=base.shape)
    w -= (w * base).sum(1, keepdims=True) * base
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    pairs = np.concatenate([base, 0.905 * base + np.sqrt(1 - 0.905**2) * w])
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(pairs)]
    found = {i: n for i, n, _, _ in got(quantised.near_duplicates(frame(spark, rows)))}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(1) - 1
    assert all(found[i] <= true[i] for i in range(len(rows)))
    assert sum(found.values()) >= 0.995 * true.sum()


def test_query_equals_brute_force(spark, sf):
    table = pq.read_table(f"{sf}/embeddings.parquet")
    rows = list(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist(), strict=True))
    assert got(queries.op13_product_quantisation(spark, sf)) == expected(rows)
