import random
import re
from collections import defaultdict

import pytest

from localstat.llm import components, minhash
from tests.llm.conftest import documents

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_force(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=3):
    """Copies, near copies around the threshold, a frequent passage, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([30, 80, 200]))]
        for edits in (0, 0, 1, 2, 3, 5, 8, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(12)]
    texts += [texts[0].upper(), "", "  \n", None, "one", "ONE", "one two", "Two one", "é one two", "one two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, monkeypatch, size, percent):
    rows = corpus()
    monkeypatch.setattr(minhash, "SHORT", 4)  # both ways of merging lists
    monkeypatch.setattr(minhash, "TILE", 5)
    got = minhash.near_duplicates(documents(spark, rows), size, percent).collect()
    expected = brute_force(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(None, text), (None, None), (7, text), (7, text), (9, text), (3, "x" * 200_000 + " y z")]
    got = sorted(minhash.near_duplicates(documents(spark, rows), 3, 85).collect(), key=str)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.component_id, r.kept))
    assert found == {None: [(None, True)] * 2, 7: [(7, True)] * 2, 9: [(7, False)], 3: [(3, True)]}
    assert minhash.near_duplicates(documents(spark, rows).limit(0)).collect() == []


def test_match_floor():
    assert minhash.match_floor(120, 0.85) == 81
    assert minhash.match_floor(10, 1.0) == 10


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()}
    label = {i: i for e in edges for i in e if i is not None}
    for _ in range(200):
        for u, v in edges:
            if u is not None:
                label[u] = label[v] = min(label[u], label[v])
    assert all(got.get(i, i) == c for i, c in label.items())
    assert components.components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0
