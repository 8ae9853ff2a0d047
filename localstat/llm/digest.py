"""Quartile bucket digests: short fingerprints whose distance follows the edits of a text.

Every byte triplet of a text is hashed into one of ``BUCKETS`` buckets. A digest names, for
each bucket, the quartile of the text's own bucket counts it falls into, and the text's
length on a logarithmic scale. Two digests are compared by a bounded score: bucket by bucket
the distance of the quartiles (opposite ends count double), plus the difference of the
length codes up to ``LENGTH_CAP``.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from localstat.llm.shipping import ship
from localstat.llm.text import SLICE_BYTES, slices

BUCKETS = 256
LENGTH_CAP = 48
#: Expected points of two digests with nothing in common; larger sums count as this.
BOUND = 416
_STEP = np.array([0, 1, 2, 6])


def bucket_counts(data, offsets):
    """Byte triplets of each document by hashed bucket."""
    n = len(offsets) - 1
    counts = np.zeros((n, BUCKETS), np.int32)
    if len(data) < 3:
        return counts
    d = data.astype(np.uint32)
    key = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))
    bucket = ((key * np.uint32(0x27D4EB2F)) >> np.uint32(24)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    whole = owner[:-2] == owner[2:]
    flat = owner[:-2][whole] * BUCKETS + bucket[whole]
    return np.bincount(flat, minlength=n * BUCKETS).reshape(n, BUCKETS)


def digests(data, offsets):
    """Quartile codes (0..3 per bucket) and length codes of the documents of a slice."""
    counts = bucket_counts(data, offsets)
    marks = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (counts[:, :, None] > marks[:, None, :]).sum(2).astype(np.uint8)
    size = np.diff(offsets)
    return codes, np.minimum(np.round(8 * np.log2(1 + size)), 255).astype(np.uint8)


def as_text(codes, lengths):
    """Digests as lower-case hex: two digits of length, then two bits a bucket."""
    four = codes.reshape(len(codes), -1, 4)
    packed = (four[:, :, 0] << 6) | (four[:, :, 1] << 4) | (four[:, :, 2] << 2) | four[:, :, 3]
    return [bytes(row).hex() for row in np.column_stack([lengths, packed.astype(np.uint8)])]


def likeness(a, b):
    """1 for equal digests, 0 for a difference of ``BOUND`` or more, row by row."""
    step = np.abs(a[0].astype(int) - b[0].astype(int))
    length = np.minimum(np.abs(a[1].astype(int) - b[1].astype(int)), LENGTH_CAP)
    return 1 - np.minimum(_STEP[step].sum(1) + length, BOUND) / BOUND


def parse(column):
    """Codes and lengths of digests in their text form."""
    raw = np.frombuffer(bytes.fromhex("".join(column)), np.uint8).reshape(len(column), -1)
    codes = np.stack([(raw[:, 1:] >> s) & 3 for s in (6, 4, 2, 0)], 2).reshape(len(column), -1)
    return codes, raw[:, 0]


def _flat(texts):
    """A slice out of a list of encoded texts."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def fingerprint(docs):
    """``docs(doc_id, text)`` to ``doc_id, fingerprint``; a null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                found = pa.array(as_text(*digests(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), found], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


def compare(pairs):
    """``likeness`` of the digests in columns ``a`` and ``b``, as a further column."""
    ship(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            a, b = (parse(batch.column(c).to_pylist()) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(likeness(a, b))], names=[*batch.schema.names, "likeness"]
            )

    return pairs.mapInArrow(run, T.StructType([*pairs.schema, T.StructField("likeness", T.DoubleType())]))


def edited(text, following):
    """The last half of a text replaced by the first code points of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(spark, rows):
    """Descending id bounds that deal the rows to blocks of similar numbers."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = [k / n for k in range(1, n)]
    found = rows.where("doc_id is not null").approxQuantile("doc_id", marks, 0.25 / n) if marks else []
    return sorted({int(b) for b in found}, reverse=True)


def _pairs(batches):
    """Slices of consecutive rows of a block as ``(ids, texts)``, the last text only a next one."""
    held, size, before = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before is not None and row[0] != before[0]:
                if len(held) > 1:
                    yield held
                held, size = [], 0
            held.append(row)
            size += len(row[2])
            before = row
            if size > SLICE_BYTES and len(held) > 1:
                yield held
                held, size = [row], len(row[2])
    if len(held) > 1:
        yield held


def _edit_batches(batches):
    for rows in _pairs(batches):
        texts = [r[2] for r in rows]
        changed = [edited(t, n).encode() for t, n in zip(texts, texts[1:], strict=False)]
        own = digests(*_flat([t.encode() for t in texts]))
        other = digests(*_flat(changed))
        mine, following = (tuple(x[s] for x in own) for s in (slice(None, -1), slice(1, None)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                pa.array(as_text(*mine)),
                pa.array(as_text(*other)),
                pa.array(likeness(mine, other)),
                pa.array(likeness(mine, following)),
            ],
            names=EDIT_COLUMNS,
        )


EDIT_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edits(docs):
    """Fingerprints of all texts, of their edited texts, and how alike they are.

    The edited text takes its end from the next document in descending order of doc_id; the
    last one's next is the first. Rows without a doc_id come last, rows with equal ids follow
    each other by text. Null texts are empty. Returns ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``. Other columns are ignored; an
    empty table gives an empty one.

    Documents are dealt to blocks of neighbouring ids, whose bounds are approximate quantiles.
    The first document of each block, found from the ids alone, is also sent to the block before
    it as a guest, so every document meets its next one with a single shuffle of the texts.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    bounds = _bounds(docs.sparkSession, rows)
    behind = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("doc_id"))) if bounds else F.lit(0)
    no_id = len(bounds) + 1
    rows = rows.withColumn("block", F.when(F.col("doc_id").isNull(), no_id).otherwise(behind).cast("int"))
    # One row per block; the blocks are as many as the partitions.
    first = rows.groupBy("block").agg(F.max("doc_id").alias("doc_id")).orderBy("block").collect()
    if not first:
        return rows.mapInArrow(_edit_batches, _EDIT_SCHEMA)
    host = {b.block: a.block for a, b in zip([first[-1], *first], first, strict=False)}
    heads = F.col("doc_id").isin([r.doc_id for r in first if r.doc_id is not None]) | F.col("doc_id").isNull()
    guests = rows.where(heads).groupBy("doc_id", "block").agg(F.min("text").alias("text"))
    move = F.create_map(*[F.lit(x) for pair in host.items() for x in pair])
    guests = guests.select(move[F.col("block")].alias("block"), "doc_id", "text", F.lit(1).alias("guest"))
    dealt = rows.select("block", "doc_id", "text", F.lit(0).alias("guest")).unionByName(guests)
    dealt = dealt.repartition(len(first), "block").sortWithinPartitions(
        "block", "guest", F.col("doc_id").desc_nulls_last(), "text"
    )
    return dealt.select("block", "doc_id", "text").mapInArrow(_edit_batches, _EDIT_SCHEMA)


_EDIT_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
