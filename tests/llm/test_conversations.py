import hashlib
import random
import re
from zlib import crc32

import pytest

from localstat.llm import conversations, queries
from localstat.plans import scale

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    """Nodes by listing every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(own.get(first, [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    words = {s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0 for s in members}
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(members[s]) - 1) * words[s]
    return {
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s],
         hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest())
        for s, m in members.items()
    }


def frame(spark, rows):
    """A conversations table with clashing extra columns."""
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, path STRING, seq INT, words STRING"
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def random_rows(seed, n=140):
    """Conversations over few distinct turns, so that many share prefixes or are alike."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-45, 400), n):
        for turn in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["a", "a b", "", "x y\x0bz"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_listing_all_prefixes(spark, seed):
    rows = random_rows(seed)
    assert got(conversations.trie(frame(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (20, None, "user", "first by its null turn"), (20, 0, None, "x"), (20, 0, None, "x"), (20, 9, "bot", None),
        (21, 3, "user", "a " * 30_000), (22, 0, "user", "a"), (41, 0, "u", "base is absent"), (41, 1, "u", "b"),
        (43, 0, "u", "only"), (None, 0, "user", "no conversation"), (-3, 0, "user", "a"), (-3, 1, "user", "b"),
    ]
    assert got(conversations.trie(frame(spark, rows))) == expected(rows)
    assert conversations.trie(frame(spark, rows).limit(0)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(41, 60) if crc32(str(c).encode()) % 4 == 3)  # its first one, 40, is absent
    nodes = got(conversations.trie(frame(spark, [(c, 0, "u", "x"), (c, 1, "u", "y")])))
    assert nodes == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_hot_groups(spark, monkeypatch):
    """A long conversation is sliced, and a third of all conversations are one sequence; nothing is broadcast."""
    rows = [(20 * i, t, "user", f"common {t}") for i in range(60) for t in range(3)]
    rows += [(7, t, "user", f"turn {t % 5}") for t in range(300)] + random_rows(3, 60)
    rows = list({(r[0], r[1]): r for r in rows}.values())
    monkeypatch.setattr(scale, "HOT_ROWS", 50)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert got(conversations.trie(frame(spark, rows))) == expected(rows)


def test_ends_of_a_node_pass_as_a_stream():
    import pyarrow as pa

    ids = list(range(1, 900, 2))
    rows = [(1, i) for i in ids] + [(5, 2), (9, 3), (9, 30)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + 7]]) for k in (0, 1)], names=["seq", "conv_id"])
        for lo in range(0, len(rows), 7)
    ]
    found = {r["seq"]: r["ends"] for b in conversations._digest(iter(batches)) for r in b.to_pylist()}
    wanted = {1: ids, 5: [2], 9: [3, 30]}
    assert found == {s: hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for s, i in wanted.items()}


def test_query_equals_listing(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_trie(spark, sf)) == expected(rows)
