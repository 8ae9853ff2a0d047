"""Alignment of the tokens of two tokenizers over the same bytes, by divide and conquer at shared cuts.

Both tokenizers see a text behind one space. Tokenizer A is a byte-level BPE, which splits
before a space that a word follows; tokenizer B marks spaces by U+2581, and none of its
pieces holds that mark behind another character (:class:`Sides` checks this). So a space
between two visible characters is a cut that both share, whatever stands around it: a text is
divided there first, and each distinct chunk is encoded and divided further once per task.

Inside a chunk, a common end is located near the middle: the end of the shorter side that
lies next to the middle is looked up on the other side by bisection, then the ends around it,
outwards. Both halves are divided in the same way. An interval without a common end inside is
a leaf, a group of tokens. A scan costs as much as the cutless stretch it passes, which halves
at least until it is a leaf, so a text of n tokens without any space takes O(n log n) steps.

Links are pairs of tokens that end together, one for each group. Their counts over the corpus
are summed per task and then by pair; the documents look up their distinct pairs in the table
of counts, by broadcast while its size is proven small, else by a shuffle.
"""

from bisect import bisect_left
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.shipping import ship
from localstat.llm.text import slices, span_hashes
from localstat.llm.tokens import gather
from localstat.plans.scale import materialise, sized

# Chunks a task remembers, and the bytes of their groups, before it starts over.
TABLE_CHUNKS, TABLE_BYTES = 800_000, 64 << 20
# Chunks of more tokens are divided one by one.
SCALAR = 64
MARK = "▁"
# Lead bytes of blocks that hold white space beyond ASCII.
SPACE_BLOCKS = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
COLUMNS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, times array<int>"


class Sides:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, path_a, path_b):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings are ordinary text
        # The public byte-to-character rule of byte-level tokenizers.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [x for x in range(256) if x not in set(plain)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in text)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of tokenizer B may span a space")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_b = len(pieces)
        self.long_a, self.long_b = (np.array([*map(len, x)]) for x in (self.bytes_a, self.bytes_b))
        # The decimal id with each sign that may stand behind it: within and behind A's and B's part.
        self.text = [f"{i}{sign}" for i in range(max(len(self.bytes_a), self.size_b)) for sign in ",|,;"].__getitem__

    def encode(self, chunks):
        """Ids of both sides for texts that begin with a space."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        return ids_a, self.b.encode([c[1:] for c in chunks], num_threads=1)

    def same(self, raw, ids_a, ids_b):
        """Whether both sides give the bytes back."""
        return raw == b"".join(map(self.bytes_a.__getitem__, ids_a)) == b"".join(map(self.bytes_b.__getitem__, ids_b))


@cache
def sides(path_a, path_b):
    return Sides(path_a, path_b)


def divided(ends_a, ends_b):
    """Leaf groups ``(first a, last a + 1, first b, last b + 1)`` in order.

    The ends are ascending and both lists end at the same place.
    """
    leaves, open_ = [], [(0, len(ends_a), 0, len(ends_b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        swap = a1 - a0 > b1 - b0  # look up the ends of the shorter side
        x, x0, x1, y, y0, y1 = (ends_b, b0, b1, ends_a, a0, a1) if swap else (ends_a, a0, a1, ends_b, b0, b1)
        middle, at = (x0 + x1 - 2) // 2, None
        for step in range(x1 - x0 - 1):  # middle, then alternately after and before it
            i = middle + (step + 1) // 2 * (1 if step % 2 else -1)
            j = bisect_left(y, x[i], y0, y1 - 1)
            if j < y1 - 1 and y[j] == x[i]:
                at = (j + 1, i + 1) if swap else (i + 1, j + 1)
                break
        if at is None:
            leaves.append((a0, a1, b0, b1))
        else:
            open_ += [(at[0], a1, at[1], b1), (a0, at[0], b0, at[1])]
    return leaves


def divided_many(ends_a, ends_b, bounds):
    """The leaves of many short intervals at once, in any order; ``bounds`` are rows of four.

    The same division, one look-up for every open interval a round. Ends ascend over all
    intervals, so one search serves them all.
    """
    leaves, open_, step = [], bounds, np.zeros(len(bounds), np.int64)
    while len(open_):
        a0, a1, b0, b1 = open_.T
        swap = a1 - a0 > b1 - b0
        x0, x1 = np.where(swap, b0, a0), np.where(swap, b1, a1)
        spent = step >= x1 - x0 - 1
        leaves.append(open_[spent])
        open_, step, swap, x0, x1 = (v[~spent] for v in (open_, step, swap, x0, x1))
        if not len(open_):
            break
        a0, a1, b0, b1 = open_.T
        i = (x0 + x1 - 2) // 2 + (step + 1) // 2 * np.where(step % 2, 1, -1)
        end = np.where(swap, ends_b[np.where(swap, i, 0)], ends_a[np.where(swap, 0, i)])
        at_a, at_b = np.where(swap, np.searchsorted(ends_a, end), i), np.where(swap, i, np.searchsorted(ends_b, end))
        met = (at_a < a1 - 1) & (at_b < b1 - 1) & (ends_a[at_a] == ends_b[at_b])
        left = np.stack([a0, at_a + 1, b0, at_b + 1], 1)[met]
        right = np.stack([at_a + 1, a1, at_b + 1, b1], 1)[met]
        open_, step = np.concatenate([open_[~met], left, right]), np.concatenate([step[~met] + 1, np.zeros(2 * met.sum(), np.int64)])
    return np.concatenate(leaves) if leaves else bounds


def chunk_spans(data, offsets):
    """Texts behind a space each, cut at spaces between visible characters.

    Returns the bytes, starts and ends of the chunks, and each document's first chunk.
    """
    offsets = offsets + np.arange(len(offsets))
    heads = offsets[:-1]
    out = np.full(offsets[-1], 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[heads] = False
    out[body] = data
    visible = (out > 0x20) & (out != 0x7F)
    for lead, second in SPACE_BLOCKS:
        at = np.flatnonzero((out[:-1] == lead) & (out[1:] == second))
        for k in range(2 if lead == 0xC2 else 3):
            visible[np.minimum(at + k, len(out) - 1)] = False
    cut = np.zeros(len(out), bool)
    cut[1:-1] = (out[1:-1] == 0x20) & visible[:-2] & visible[2:]
    cut[offsets[1:-1] - 1] = False  # a last space: what follows is another document
    cut[heads] = True
    starts = np.flatnonzero(cut)
    return out, starts, np.append(starts[1:], len(out)), np.searchsorted(starts, offsets)


class Aligner:
    """Alignments of byte slices, with a table of the chunks met so far; one per task."""

    def __init__(self, path_a, path_b):
        self.sides = sides(path_a, path_b)
        self._clear()

    def _clear(self):
        self.keys, self.slots, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.groups, self.counts, self.links, self.used = [], np.zeros((0, 4), np.int64), np.zeros(1 << 12, np.int64), 0

    def _leaves(self, ends_a, ends_b, first_a, first_b):
        """Bounds of all leaf groups of all chunks, in order; ends count over all chunks."""
        n_a, n_b = np.diff(first_a), np.diff(first_b)
        long = np.minimum(n_a, n_b) > SCALAR
        bounds = np.stack([first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]], 1)
        found = [divided_many(ends_a, ends_b, bounds[~long & (n_a > 0)])]
        for a0, a1, b0, b1 in bounds[long].tolist():
            own = divided(ends_a[a0:a1].tolist(), ends_b[b0:b1].tolist())
            found.append(np.array(own) + [a0, a0, b0, b0])
        found = np.concatenate(found)
        return found[np.argsort(found[:, 0], kind="stable")]

    def _learn(self, keys, data, starts, ends):
        raw, names = data.tobytes(), self.sides
        chunks = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids_a, ids_b = names.encode([c.decode() for c in chunks])
        same = np.fromiter(map(names.same, chunks, ids_a, ids_b), bool, len(chunks))
        counts = np.stack([np.fromiter(map(len, x), np.int64, len(chunks)) for x in (ids_a, ids_b)], 1) * same[:, None]
        first_a, first_b = (np.concatenate([[0], np.cumsum(c)]) for c in counts.T)
        flat_a, flat_b = (
            np.fromiter(chain.from_iterable(compress(x, same)), np.int64, f[-1]) for x, f in ((ids_a, first_a), (ids_b, first_b))
        )
        leaves = self._leaves(np.cumsum(names.long_a[flat_a]), np.cumsum(names.long_b[flat_b]), first_a, first_b)
        last_a, last_b = leaves[:, 1] - 1, leaves[:, 3] - 1
        links = flat_a[last_a] * names.size_b + flat_b[last_b]
        # Tokens in the order of the text, each with the sign behind it.
        behind_a, behind_b = np.zeros(len(flat_a), np.int64), np.full(len(flat_b), 2)
        behind_a[last_a], behind_b[last_b] = 1, 3
        leaf_a, leaf_b = (np.repeat(np.arange(len(leaves)), leaves[:, k + 1] - leaves[:, k]) for k in (0, 2))
        order = np.argsort(np.concatenate([2 * leaf_a, 2 * leaf_b + 1]), kind="stable")
        signs = np.concatenate([flat_a * 4 + behind_a, flat_b * 4 + behind_b])[order].tolist()
        words = [names.text(x) for x in signs]
        text = "".join(words)
        width = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        cuts = width[first_a + first_b].tolist()
        self.groups += [text[lo : hi - 1] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        self.bytes += len(text)
        n_links = np.diff(np.searchsorted(leaves[:, 0], first_a))
        while self.used + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.used : self.used + len(links)] = links
        self.used += len(links)
        first = len(self.counts)
        self.counts = np.concatenate([self.counts, np.column_stack([counts, n_links, ~same])])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, first + np.arange(len(keys)))

    def _known(self, keys):
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def align(self, data, offsets):
        """Per document of a slice: tokens of A and B, groups, their text; pairs, their times, and
        the first pair of each document."""
        n, empty = len(offsets) - 1, np.diff(offsets) == 0
        flat, starts, ends, first = chunk_spans(data, offsets)
        keys, at, inverse = np.unique(span_hashes(flat, starts, ends), return_index=True, return_inverse=True)
        place, known = self._known(keys)
        if not known.all():
            if len(self.keys) > TABLE_CHUNKS or self.bytes > TABLE_BYTES:
                self._clear()
                known[:] = False
            fresh = np.flatnonzero(~known)
            self._learn(keys[fresh], flat, starts[at[fresh]], ends[at[fresh]])
            place, _ = self._known(keys)
        slots = self.slots[place][inverse]
        counts = self.counts[slots]
        doc = np.repeat(np.arange(n), np.diff(first))
        # Documents without tokens: empty ones, and those one of whose chunks does not come back.
        out = empty | (np.bincount(doc, counts[:, 3], n) > 0)
        totals = np.where(out, 0, [np.bincount(doc, counts[:, k], n).astype(np.int64) for k in range(3)])
        slots_of = np.split(slots, first[1:-1])
        groups = ["" if o else ";".join(map(self.groups.__getitem__, s.tolist())) for o, s in zip(out, slots_of, strict=True)]
        link_first = np.cumsum(self.counts[:, 2]) - self.counts[:, 2]
        pairs, of = gather(self.links, link_first[slots], counts[:, 2]), np.repeat(doc, counts[:, 2])
        pairs, of = pairs[~out[of]], of[~out[of]]
        width = self.sides.size_b * len(self.sides.bytes_a)
        both, times = np.unique(of * width + pairs, return_counts=True)
        return totals, groups, both % width, times, np.searchsorted(both // width, np.arange(n + 1))


def align(docs, path_a, path_b):
    """Aligned tokens of ``docs(doc_id, text)`` under tokenizers A and B, one row per row of ``docs``.

    Returns ``doc_id, n_a, n_b, n_groups``, ``groups`` as text ``a1,a2|b1;a3|b2,b3``, and the
    distinct links as ``pairs`` (id of A times the size of B's vocabulary plus id of B) with how
    often each occurs in ``times``. Null and empty texts, and texts whose bytes either tokenizer
    does not give back (for B those with U+2581), have no tokens: zeros, an empty text, no
    pairs. Rows with a null or repeated doc_id are rows like others; an empty table gives an
    empty one; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                totals, groups, pairs, times, first = aligner.align(data, offsets)
                first = pa.array(first.astype(np.int32))
                columns = [
                    batch.column(0).slice(lo, hi - lo), *map(pa.array, totals), pa.array(groups, pa.string()),
                    pa.ListArray.from_arrays(first, pa.array(pairs)),
                    pa.ListArray.from_arrays(first, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]
                )

    return rows.mapInArrow(run, COLUMNS)


def link_counts(rows):
    """How often each of the ``pairs`` occurs in all rows: ``b, pair, n, best``.

    ``best`` marks the pairs whose count is the highest of their id of B, ties included. Both
    groupings combine per task first, so a pair that a third of all links has is no hot spot.
    ``rows`` has a column ``size_b``, the size of B's vocabulary.
    """
    linked = rows.select("size_b", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = linked.groupBy(F.col("l.pairs").alias("pair"), (F.col("l.pairs") % F.col("size_b")).alias("b"))
    counts = materialise(counts.agg(F.sum("l.times").alias("n")), "links")
    most = materialise(counts.groupBy("b").agg(F.max("n").alias("most")), "most")
    return counts.join(sized(most), "b").select("b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs, path_a, path_b, groups="groups"):
    """Alignments with the corpus-wide counts of their links, one row per row of ``docs``.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: links, how many
    of them are their B id's most frequent pair, and the sum of their counts. ``groups`` is an SQL
    expression over the rows of :func:`align`, evaluated before they are staged.
    """
    size_b = F.lit(sides(path_a, path_b).size_b)
    rows = align(docs, path_a, path_b).withColumn("groups", F.expr(groups))
    # The row numbers are fixed by the written table.
    rows = materialise(rows.withColumns({"row": F.monotonically_increasing_id(), "size_b": size_b}), "aligned")
    counts = sized(materialise(link_counts(rows).select("pair", "n", "best"), "counts"))
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    linked = linked.select("row", F.col("l.pairs").alias("pair"), "l.times").join(counts, "pair")
    sums = linked.groupBy("row").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"),
    )
    zero = F.lit(0).cast("bigint")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *numbers, "groups")
