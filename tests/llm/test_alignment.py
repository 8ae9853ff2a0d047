import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from localstat.llm import alignment, queries
from localstat.llm.text import slices
from tests.llm.conftest import documents

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    *"abcXYZ '’<|>.,!12é ÉßñÑ×÷…\t\n\r\x85中Σσς  　᠎\x1c\x00", "́", "  ", "<|endoftext|>", " 'LL", " the ",
    "tion", "▁", "   ", "<0x41>", "<unk>", "<s>", " 　", "  a", "\n b", "﻿",
]


def odd_texts(n, seed=1, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(longest))) for _ in range(n)]


def whole(text):
    """Tokens of a whole text by the libraries, and its groups by intersecting all ends."""
    own = alignment.sides(A, B)
    if not text:
        return [], [], []
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    parts = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return [], [], []
    ends = []
    for p in parts:
        at, found = 0, []
        for x in p:
            at += len(x)
            found.append(at)
        ends.append(found)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = bisect_left(ends[0], end) + 1, bisect_left(ends[1], end) + 1
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return a, b, groups


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected_rows(rows):
    found = [whole(t) for _, t in rows]
    counts = Counter((a[-1], b[-1]) for _, _, groups in found for a, b in groups)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), (a, b, groups) in zip(rows, found, strict=True):
        links = [(x[-1], y[-1]) for x, y in groups]
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), as_text(groups)))
    return out


def got_rows(df, text="groups"):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", text]
    return [tuple(r[c] for c in names) for r in df.collect()]


def none_first(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *map(str, r)))


@pytest.mark.parametrize("scalar", [0, 64])
def test_chunks_equal_whole_texts(sf, monkeypatch, scalar):
    monkeypatch.setattr(alignment, "SCALAR", scalar)
    texts = odd_texts(3000) + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    texts += ["x" * 9000, "中文" * 3000, "a1B2" * 4000, "", None, " ", "  x  "]
    aligner, got = alignment.Aligner(A, B), []
    for lo, hi, data, offsets in slices(pa.array(texts, pa.string())):
        totals, groups, pairs, times, first = aligner.align(data, offsets)
        got += [(*totals[:, i].tolist(), groups[i], int(times[first[i] : first[i + 1]].sum())) for i in range(hi - lo)]
    for text, own in zip(texts, got, strict=True):
        a, b, groups = whole(text)
        assert own == (len(a), len(b), len(groups), as_text(groups), len(groups)), text
    assert sum(g[0] > 0 for g in got) > 1500


def test_full_table_starts_over(monkeypatch):
    monkeypatch.setattr(alignment, "TABLE_CHUNKS", 5)
    aligner, texts = alignment.Aligner(A, B), odd_texts(60, 2)
    for text in texts:
        for _, _, data, offsets in slices(pa.array([text])):
            assert aligner.align(data, offsets)[1] == [as_text(whole(text)[2])]


@pytest.mark.parametrize("seed", range(10))
def test_division_finds_all_shared_ends(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 400)
    a, b = ([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n] for _ in range(2))
    leaves = alignment.divided(a, b)
    assert [a[x[1] - 1] for x in leaves] == [b[x[3] - 1] for x in leaves] == sorted(set(a) & set(b))
    assert [x[0] for x in leaves[1:]] == [x[1] for x in leaves[:-1]]


def test_scored_frames(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(7, "The cat sat on the mat."), (7, "The cat sat on the mat."), (None, "the cat"), (None, None), (8, ""), (9, "a▁b")]
    rows += list(enumerate(odd_texts(40, 5), 10**6))
    want = none_first(expected_rows(rows))
    assert none_first(got_rows(alignment.scored(documents(spark, rows), A, B))) == want
    monkeypatch.setattr("localstat.plans.scale.BROADCAST_ROWS", 0)  # pairs are joined by shuffle
    assert none_first(got_rows(alignment.scored(documents(spark, rows), A, B))) == want
    assert alignment.scored(documents(spark, rows).limit(0), A, B).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in expected_rows(rows)]
    assert none_first(got_rows(queries.op12_tokenizer_alignment(spark, sf), "groups_sha256")) == none_first(want)
