"""BPE encoding and decoding with reuse of content-defined chunks.

Each text is cut where a rolling hash of the last ``WINDOW`` bytes hits a mask, so that
passages shared by documents are cut alike wherever they stand. The inside of a chunk,
from its first to its last white space, is encoded once per task and kept in a bounded
table under its hash; later documents take the ids from there. What lies around a cut, the
last piece of a word of one chunk and the first of the next, is the seam: it is repaired by
encoding it anew, widened on both sides until it agrees with the chunks beside it. As the
tokenizer drops white space and no token spans it, a seam agrees as soon as both its ends
are white space (or the text's ends); a chunk without white space belongs to its seam.

Reuse is per task. A table of all chunks of the corpus would mean shuffling the ids of
every shared chunk back to its documents, more bytes than the texts themselves have.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.shipping import ship
from localstat.llm.text import mix, powers, slices, span_hashes
from localstat.llm.tokens import WordCoder, gather

WINDOW, MASK_BITS = 48, 9
TABLE_BYTES = 64 << 20
_SPACES = (0x20, *range(0x09, 0x0E))


def chunk_cuts(data, offsets):
    """Byte positions inside documents where the rolling hash asks for a cut."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    rolling = mix((sums[WINDOW:] - sums[: n + 1 - WINDOW]) * down[: n + 1 - WINDOW])
    cuts = np.flatnonzero(rolling >> np.uint64(64 - MASK_BITS) == 0) + WINDOW
    begin = offsets[np.searchsorted(offsets, cuts, side="left") - 1]
    return cuts[cuts - begin >= WINDOW]  # the window lies in one document


def regions(data, offsets):
    """Texts as alternating seams and chunk insides, all ending at white space or text ends.

    Returns region bounds, which regions are insides, and each document's first region.
    """
    cuts = chunk_cuts(data, offsets)
    edges = np.unique(np.concatenate([cuts, offsets]))
    spaces = np.flatnonzero(np.isin(data, _SPACES))
    a = np.searchsorted(spaces, edges[:-1])
    b = np.searchsorted(spaces, edges[1:]) - 1
    wide = b > a  # chunks with room between their first and last white space
    begin, end = spaces[a[wide]], spaces[b[wide]]
    bounds = np.unique(np.concatenate([begin, end, offsets]))
    inside = np.isin(bounds[:-1], begin)
    return bounds, inside, np.searchsorted(bounds, offsets)


class ChunkCoder:
    """Encodes and decodes the texts of one task."""

    def __init__(self, path):
        self.words = WordCoder(path)
        vocab = self.words.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.token[i] = text.encode()
        self.table, self.bytes, self.reused = {}, 0, 0

    def _encode(self, data, starts, ends):
        """``(ids as little-endian bytes, decoded bytes)`` of each region."""
        flat = gather(data, starts, ends - starts)
        ids, first = self.words.encode(flat, np.concatenate([[0], np.cumsum(ends - starts)]))
        names = [self.token[i] for i in ids.tolist()]
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield ids[lo:hi].astype("<u4").tobytes(), b" ".join(names[lo:hi])

    def encode(self, data, offsets):
        """Yield ``(ids, decoded text)`` as bytes for each document of a slice."""
        bounds, inside, first = regions(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        keys = span_hashes(data, starts, ends).tolist()
        fresh, mine = [], {}
        for r, key in enumerate(keys):
            if not inside[r]:
                fresh.append(r)
            elif key in self.table:
                self.reused += 1
                mine[key] = self.table[key]
            elif key not in mine:
                mine[key] = None
                fresh.append(r)
        done = dict(zip(fresh, self._encode(data, starts[fresh], ends[fresh]), strict=True)) if fresh else {}
        for r, found in done.items():
            if inside[r]:
                mine[keys[r]] = found
                self.bytes += len(found[0]) + len(found[1])
        if self.bytes > TABLE_BYTES:
            self.table, self.bytes = {}, 0
        else:
            self.table.update(mine)
        for d in range(len(offsets) - 1):
            parts = [done.get(r) or mine[keys[r]] for r in range(first[d], first[d + 1])]
            yield b"".join(p[0] for p in parts), b" ".join(p[1] for p in parts if p[0])


def encode(docs, path):
    """Ids and decoded text of ``docs(doc_id, text)``: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit integers, without special tokens added;
    ``decoded`` joins the tokens by spaces, as the tokenizer without a decoder does. Null and
    empty texts have no ids and an empty decoded text. Other columns are ignored; repeated
    rows are encoded each; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        coder = ChunkCoder(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                ids, decoded = zip(*coder.encode(data, offsets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def decode(rows, path):
    """``(doc_id, ids)`` back to ``(doc_id, decoded)``; null ids decode to an empty text."""
    ship(rows.sparkSession)

    def run(batches):
        coder = ChunkCoder(path)
        for batch in batches:
            texts = [
                b" ".join(coder.token[i] for i in np.frombuffer(x or b"", "<u4").tolist()).decode()
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], names=["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded string")
