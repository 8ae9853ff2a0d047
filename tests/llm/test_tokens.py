import hashlib
import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from localstat.llm import bpe, packing, tokens
from localstat.llm.text import slices
from tests.llm.conftest import documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = list("abcXYZ '’<|>.,!12é ÉßñÑ×÷…\t\n中Σσς") + ["́", " ", "İ", "<|endoftext|>", "'s", "'LL", "the ", "tion"]


def odd_texts(n, seed=1, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(longest))) for _ in range(n)]


def expected(texts):
    found = tokens.tokenizer(PATH)
    return [e.ids for e in found.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_coder_equals_library(sf):
    import pyarrow.parquet as pq

    texts = odd_texts(3000) + pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    coder, got = tokens.WordCoder(PATH), []
    for lo, hi, ids, first in tokens.encoded(pa.array(texts), coder):
        got += [ids[first[i] : first[i + 1]].tolist() for i in range(hi - lo)]
    assert got == expected(texts)


def test_full_table_starts_over(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_PIECES", 5)
    coder, texts = tokens.WordCoder(PATH), odd_texts(60)
    got = []
    for text in texts:
        for lo, hi, ids, _ in tokens.encoded(pa.array([text]), coder):
            got.append(ids.tolist())
    assert got == expected(texts)


def test_chunks_are_reused_and_joins_repaired(monkeypatch):
    monkeypatch.setattr(bpe, "MASK_BITS", 5)
    monkeypatch.setattr(bpe, "WINDOW", 12)
    passage = " ".join(odd_texts(150, 2))
    texts = [a + passage + b for a, b in zip(odd_texts(30, 3), odd_texts(30, 4), strict=True)] + ["", "x" * 5000, None]
    coder, got = bpe.ChunkCoder(PATH), []
    for column in (pa.array(texts[:10]), pa.array(texts[10:], pa.string())):
        for _, _, data, offsets in slices(column):
            got += list(coder.encode(data, offsets))
    assert coder.reused > 100
    assert [np.frombuffer(i, "<u4").tolist() for i, _ in got] == expected(texts)
    decode = tokens.tokenizer(PATH).decode
    assert [d.decode() for _, d in got] == [decode(e, skip_special_tokens=False) for e in expected(texts)]


def test_encode_decode_frames(spark):
    rows = [(1, "The cat, the CAT."), (2, None), (2, ""), (None, "Ünïted 12 days"), (4, "word " * 20_000)]
    out = bpe.encode(documents(spark, rows), PATH)
    got = {(r.doc_id, r.n_tokens): r for r in out.collect()}
    assert len(got) == 4 and got[2, 0].decoded == "" and got[2, 0].ids == b""
    for (_, text), ids in zip(rows, expected([t for _, t in rows]), strict=True):
        assert any(np.frombuffer(r.ids, "<u4").tolist() == ids for r in got.values()), text
    back = {r.doc_id: r.decoded for r in bpe.decode(out.where("doc_id = 1"), PATH).collect()}
    assert back[1] == got[1, len(expected(["The cat, the CAT."])[0])].decoded
    assert bpe.encode(documents(spark, rows).limit(0), PATH).count() == 0


def check_pieces(pieces, ids_of, limit=2048):
    """Every id in exactly one piece, sequences gapless and within the limit; returns the padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids_of)
    for doc, own in by_doc.items():
        at, ids = 0, ids_of[doc]
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_packing(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10**6, None), (10**6 + 1, "word" * 9000), (10**6 + 2, "a " * 9000)]
    pieces = packing.pack(documents(spark, rows), PATH).collect()
    ids_of = {i: [*e, 1] for (i, _), e in zip(rows, expected([t for _, t in rows]), strict=True)}
    padding = check_pieces(pieces, ids_of)
    assert padding < 0.02 * sum(map(len, ids_of.values()))


def test_packing_odd_rows(spark):
    rows = [(5, "one two"), (5, "one two"), (None, "three"), (None, None)]
    got = packing.pack(documents(spark, rows), PATH).collect()
    assert sorted(r.length for r in got) == [1, 2, 3, 3]
    assert packing.pack(documents(spark, rows).limit(0), PATH).count() == 0
    bare = spark.createDataFrame([(1,)], "doc_id BIGINT")
    assert [r.length for r in packing.pack(bare, PATH).collect()] == [1]


def brute_force_cost(places, penalties, limit):
    cost = {places[0]: 0}
    for j, p in enumerate(places[1:], 1):
        options = []
        for q in places[:j]:
            size = p - q
            if size <= limit:
                options.append(cost[q] + (0 if size & (size - 1) == 0 else limit - size))
        cost[p] = min(options) + penalties[j]
    return cost[places[-1]]


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_optimal(seed):
    rng = random.Random(seed)
    places, penalties = [0], [0.0]
    for _ in range(60):
        places.append(places[-1] + rng.randint(1, 20))
        penalties.append(float(rng.choice([0, 2, 16])))
    cuts = packing.plan_cuts(places, penalties, 32)
    cost = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        assert b - a <= 32
        cost += (0 if (b - a) & (b - a - 1) == 0 else 32 - (b - a)) + penalties[places.index(b)]
    assert (cuts[0], cuts[-1]) == (0, places[-1]) and cost == brute_force_cost(places, penalties, 32)


def test_windows_keep_all(monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 300)
    packer = packing.Packer([7], limit=64)
    docs = {d: np.random.default_rng(d).integers(2, 60, n).astype(np.uint32) for d, n in enumerate([5, 900, 1, 64, 250, 3])}
    out = [p for d, ids in docs.items() for p in packer.add(d, ids)] + list(packer.finish())
    from collections import namedtuple

    piece = namedtuple("piece", packing.COLUMNS)
    check_pieces([piece(*p) for p in out], {d: ids.tolist() for d, ids in docs.items()}, 64)
    assert hashlib.sha256(repr(out).encode()).hexdigest()  # plain python numbers, so rows can be built
