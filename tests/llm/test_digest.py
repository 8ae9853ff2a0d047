import hashlib

import numpy as np
import pytest

from localstat.llm import digest
from tests.llm.conftest import documents


def brute_force_digest(text):
    data, counts = text.encode(), [0] * digest.BUCKETS
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        key = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        # products of bytes with 32-bit numbers are taken modulo 2**32 before they are joined
        key = ((a * 0x9E3779B1) & 0xFFFFFFFF) ^ ((b * 0x85EBCA77) & 0xFFFFFFFF) ^ ((c * 0xC2B2AE3D) & 0xFFFFFFFF)
        counts[(key * 0x27D4EB2F & 0xFFFFFFFF) >> 24] += 1
    ordered, n = sorted(counts), digest.BUCKETS
    marks = [ordered[n * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(c > m for m in marks) for c in counts]
    length = min(255, int(np.round(8 * np.log2(1 + len(data)))))
    packed = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, n, 4)]
    return bytes([length, *packed]).hex()


def brute_force(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        prints = [brute_force_digest(t) for t in (text, changed, following)]
        near = [digest.likeness(digest.parse([prints[0]]), digest.parse([p]))[0] for p in prints[1:]]
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((i, len(text), sha, prints[0], prints[1], *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_edits_equal_brute_force(spark, sf, partitions):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    rows += [(None, "no id"), (None, None), (3, "again"), (3, "again"), (-5, "é中𝒳 x"), (10**12, ""), (77777, "long " * 50_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((tuple(r) for r in digest.edits(documents(spark, rows)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_force(rows)


def test_single_and_empty(spark):
    (row,) = digest.edits(documents(spark, [(1, "abcdef")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1
    assert digest.edits(documents(spark, [(1, "a")]).limit(0)).collect() == []


def test_likeness_bounds_and_order(spark):
    text = " ".join(f"word{i * i % 97}" for i in range(400))
    rows = [(1, text), (2, text), (3, text[:-40] + "something else at the end of it"), (4, "9" * 500), (5, None)]
    prints = {r.doc_id: r.fingerprint for r in digest.fingerprint(documents(spark, rows)).collect()}
    assert prints[1] == prints[2]
    pairs = spark.createDataFrame([(prints[1], prints[k]) for k in (1, 3, 4, 5)], "a string, b string")
    same, near, far, empty = [r.likeness for r in digest.compare(pairs).collect()]
    assert same == 1 and 0.7 < near < 1 and 0 <= far < near and 0 <= empty < near
