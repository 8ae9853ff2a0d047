"""Order-preserving packing of documents into sequences by dynamic programming.

The documents of a task, in the order of their ids, form one stream of tokens. The
stream may be cut at document ends, at sentence ends, and inside a sentence longer than
``STRIDE`` tokens at every ``STRIDE``-th token. A plan of cuts costs the padding of its
sequences plus ``SENTENCE`` or ``INSIDE`` tokens for each cut that truncates a document at
a sentence end or elsewhere. With places ``p`` and costs ``f``::

    f[j] = penalty[j] + min(  min over p[j] - p[i] <= limit of f[i] + p[i], plus limit - p[j],
                              min over powers of two of f[i] where p[j] - p[i] is that power )

The inner minimum slides with ``j``, so a monotone queue gives it in constant time; a
sequence whose length is a power of two needs no padding, which the second line uses.
The plan is made for windows of ``WINDOW`` tokens, whose last sequence is left open for the
next window, so memory does not grow with the task.
"""

from collections import deque
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.shipping import ship
from localstat.llm.tokens import WordCoder, encoded

LIMIT, END = 2048, 1
SENTENCE, INSIDE, STRIDE = 2, 16, 32
WINDOW = 1 << 17
# Fixed value: what ends a sentence.
SENTENCE_ENDS = (".</w>", "!</w>", "?</w>")
TASK_SEQUENCES = 1 << 33  # sequence ids set aside for each task


def plan_cuts(places, penalties, limit=LIMIT):
    """Chosen places out of ascending ``places`` (first and last are always chosen).

    Neighbouring places are at most ``limit`` apart. ``penalties`` belong to the places.
    """
    n = len(places)
    cost, back = [0.0] * n, [0] * n
    best = {places[0]: 0}
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k <= limit]
    queue = deque([0])
    for j in range(1, n):
        p = places[j]
        while places[queue[0]] < p - limit:
            queue.popleft()
        i = queue[0]
        least = cost[i] + places[i] + limit - p
        for power in powers:
            k = best.get(p - power)
            if k is not None and cost[k] < least:
                i, least = k, cost[k]
        cost[j], back[j] = least + penalties[j], i
        best[p] = j
        own = cost[j] + p
        while queue and cost[queue[-1]] + places[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    cuts, j = [places[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(places[j])
    return cuts[::-1]


def candidate_places(ids, doc_ends, stops, limit=LIMIT):
    """Where a stream may be cut, and what a cut there costs."""
    ends = np.flatnonzero(np.isin(ids, stops)) + 1
    strong = np.unique(np.concatenate([[0], ends, doc_ends, [len(ids)]]))
    gaps = np.diff(strong)
    more = np.maximum((gaps - 1) // STRIDE, 0)
    first = np.repeat(strong[:-1], more)
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    places = np.concatenate([strong, first + step * STRIDE])
    penalties = np.concatenate([np.full(len(strong), float(SENTENCE)), np.full(len(step), float(INSIDE))])
    order = np.argsort(places, kind="stable")
    places, penalties = places[order], penalties[order]
    penalties[np.isin(places, doc_ends)] = 0
    return places.tolist(), penalties.tolist()


class Packer:
    """Packs one task's documents; ``add`` and ``finish`` yield lists of pieces."""

    def __init__(self, stops, limit=LIMIT):
        self.stops, self.limit, self.sequence = np.array(stops), limit, 0
        self.docs, self.size = [], 0  # (doc_id, ids, tokens before, doc_tokens) still open

    def add(self, doc_id, ids):
        start, total = 0, len(ids)
        while start < total:
            part = ids[start : start + WINDOW]
            self.docs.append((doc_id, part, start, total))
            self.size += len(part)
            start += len(part)
            if self.size >= WINDOW:
                yield from self._flush(last=False)

    def finish(self):
        if self.size:
            yield from self._flush(last=True)

    def _flush(self, last):
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        whole = np.array([d[2] + len(d[1]) == d[3] for d in self.docs])
        places, penalties = candidate_places(ids, ends[whole], self.stops, self.limit)
        cuts = plan_cuts(places, penalties, self.limit)
        if not last:  # the last sequences may do better with what follows
            keep = len(cuts)
            while keep > 2 and cuts[keep - 1] > len(ids) - 2 * self.limit:
                keep -= 1
            cuts = cuts[:keep]
        rest, d, base = [], 0, 0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = lo
            while at < hi:
                doc_id, own, before, total = self.docs[d]
                end = min(hi, base + len(own))
                piece = own[at - base : end - base]
                code = crc32(piece.astype("<u4").tobytes())
                yield (doc_id, before + at - base, len(piece), code, total, self.sequence, at - lo)
                at = end
                if end == base + len(own):
                    base, d = end, d + 1
            self.sequence += 1
        done = cuts[-1]
        for doc_id, own, before, total in self.docs[d:]:
            skip = max(0, done - base)
            rest.append((doc_id, own[skip:], before + skip, total))
            base += len(own)
        self.docs = [x for x in rest if len(x[1])]
        self.size = sum(len(x[1]) for x in self.docs)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs, path, limit=LIMIT, end_id=END):
    """Pack ``docs(doc_id, text)`` into sequences of at most ``limit`` tokens.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Every document ends with ``end_id``; a null or empty text is that id alone. Rows
    that repeat a doc_id, or have none, are documents of their own. Documents keep the order
    of their ids inside a sequence (rows without id first). Other columns are ignored. An
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    names = {n.lower() for n in docs.columns}
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.col("text").cast("string") if "text" in names else F.lit(None).cast("string")).alias("text"),
    )

    def run(batches):
        from pyspark import TaskContext

        coder, task = WordCoder(path), TaskContext.get().partitionId()
        packer = Packer([i for i in map(coder.tokenizer.token_to_id, SENTENCE_ENDS) if i is not None], limit)
        out = []

        def batch_of(out):
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            columns[5] = pa.array([task * TASK_SEQUENCES + s for s in columns[5].to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays(columns, names=COLUMNS)

        for batch in batches:
            for lo, hi, ids, first in encoded(batch.column(1), coder):
                for i, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id))
                    out.extend(packer.add(doc_id, own))
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
        out.extend(packer.finish())
        if out:
            yield batch_of(out)

    schema = ", ".join(f"{c} bigint" for c in COLUMNS)
    return rows.sortWithinPartitions("doc_id").mapInArrow(run, schema)
