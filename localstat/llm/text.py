"""Byte-level helpers for whole texts inside Arrow batches.

A batch column is seen as one flat byte array with document offsets; work is done on
slices of a megabyte at most, so memory stays bounded whatever the number of rows in a batch
(a single longer document is a slice of its own). A null text counts as an empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
#: For work that takes 50 and more times a slice's bytes, in all tasks of an executor at once.
FINE_BYTES = 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = {}


def flat(column):
    """Bytes and document offsets of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may have bytes behind it
        lengths = np.diff(offsets) * column.is_valid().to_numpy(zero_copy_only=False)
        if lengths.sum() != offsets[-1] - offsets[0]:
            return flat(column.fill_null(""))
    return data, offsets


def slices(column, limit=SLICE_BYTES):
    """Yield ``(first row, last row + 1, bytes, offsets from 0)`` of about ``limit`` bytes each."""
    data, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        lo, hi = offsets[at], offsets[end]
        yield at, end, data[lo:hi], offsets[at : end + 1] - lo
        at = end


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n):
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if _powers.get("n", -1) < n:
        size = n + 1 if n > SLICE_BYTES else (1 << max(n - 1, 0).bit_length()) + 2
        up = np.full(size, _P, np.uint64)
        down = np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size - 1, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def span_hashes(data, starts, ends):
    """64-bit hash of each span of bytes, equal exactly for equal spans (up to hash collisions)."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    polynomial = (sums[ends] - sums[starts]) * down[starts]
    return mix(polynomial ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def word_spans(data, offsets):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each document's first word number."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data):
    """A-Z to a-z; every other byte stays."""
    return _LOWER[data]


def shingles(data, offsets, size):
    """Hashes of the ``size``-word shingles of each document, repeats included.

    Returns the hashes and each document's first position. A document of fewer words has
    one shingle, its whole word sequence; one without words has none.
    """
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(lowered(data), starts, ends)
    counts = np.diff(first)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(counts)), many)
    at = first[doc] + np.arange(out_first[-1]) - out_first[doc]
    width = np.minimum(counts, size)[doc]
    result = width.astype(np.uint64)
    for i in range(size):
        here = words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else words
        result = np.where(i < width, mix(result * np.uint64(0xD6E8FEB86659FD93) + here), result)
    return result, out_first


def kept_columns(docs, keep, *added):
    """Schema text of the columns to carry along, which may not be named like added ones."""
    if clash := {k.lower() for k in keep} & {a.lower() for a in added}:
        raise ValueError(f"columns {sorted(clash)} are added here and cannot be carried")
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keep for f in docs.schema.fields if f.name == k)


def with_text(docs, keep):
    """The columns ``keep`` of ``docs`` and its text as a string, and the text's place among them.

    A kept text is that column itself: a batch of texts is the largest thing a task holds, on both
    sides of the way to Python, so it is not sent twice.
    """
    if "text" in keep and any(f.name == "text" and f.dataType == T.StringType() for f in docs.schema.fields):
        return docs.select(*keep), keep.index("text")
    return docs.select(*keep, F.col("text").cast("string").alias("_text")), len(keep)
