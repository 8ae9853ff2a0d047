"""Token ids of whole texts for lower-casing word tokenizers.

For tokenizers that drop white space, lower-case, and split words into runs of letters,
single digits and runs of other characters before their merges (as ``word_bpe_49k.json``
does). The ids of a text are then those of its pieces in order. Pieces are cut with array
operations where the rule is certain: in words of ASCII and Latin-1 letters, digits and
punctuation. Any other word (apostrophes, special tokens, other scripts, combining marks)
is one piece, so the tokenizer itself sees the whole of it. Each distinct piece is encoded
once and stays in a bounded table for the following slices of the task. New pieces that
are runs of letters are merged many at a time, by the merge table of the tokenizer's own
file; the tokenizer encodes all others.
"""

import json
from functools import cache

import numpy as np

from localstat.llm.text import FINE_BYTES, slices, span_hashes, word_spans

TABLE_PIECES = 1_000_000
LETTER, DIGIT, SIGN, RAW = 1, 2, 3, 4
_KIND = np.full(256, SIGN, np.uint8)
_KIND[ord("0") : ord("9") + 1] = DIGIT
for _a in (ord("A"), ord("a")):
    _KIND[_a : _a + 26] = LETTER
_KIND[0x80:] = RAW
_KIND[[ord("'"), ord("<"), *range(0x20), 0x7F]] = RAW
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32


@cache
def tokenizer(path):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def piece_spans(data, offsets):
    """Lower-cased bytes, starts and ends of the pieces, each document's first piece, kinds of bytes."""
    starts, ends, first_word = word_spans(data, offsets)
    kind, low = _KIND[data], _LOW[data]
    if len(data) > 1:  # Latin-1 letters: C3 80..BF without the two signs; capitals up to 9E
        lead = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[lead + 1]
        letter = (tail != 0x97) & (tail != 0xB7)
        lead, tail = lead[letter], tail[letter]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(tail <= 0x9E, tail + 0x20, tail)
    if not len(starts):
        return low, starts, ends, first_word, kind
    raw = np.bitwise_or.reduceat(kind == RAW, starts) if len(data) else np.zeros(0, bool)
    raw_at = np.repeat(raw, ends - starts)
    within = np.arange(len(raw_at)) + np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts)
    own = kind[within]
    new = np.ones(len(within), bool)  # does a piece start at this byte?
    new[1:] = (own[1:] != own[:-1]) | (own[1:] == DIGIT)
    new[raw_at] = False
    word_at = np.cumsum(ends - starts) - (ends - starts)
    new[word_at] = True
    low[within[raw_at]] = data[within[raw_at]]
    kind[within[raw_at]] = RAW
    at = np.flatnonzero(new)
    piece_starts = within[at]
    piece_ends = within[np.concatenate([at[1:], [len(within)]]) - 1] + 1
    first_piece = np.searchsorted(piece_starts, np.append(starts, len(data) + 1)[first_word])
    return low, piece_starts, piece_ends, first_piece, kind


class Merges:
    """The merge table of a byte-level BPE tokenizer, applied to many short pieces at once."""

    NONE = np.iinfo(np.int64).max
    LONGEST = 48

    def __init__(self, found):
        model = json.loads(found.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        # The public byte-to-character rule of byte-level tokenizers.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.inner = np.array([vocab.get(char[b], -1) for b in range(256)])
        self.final = np.array([vocab.get(char[b] + suffix, -1) for b in range(256)])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs])
        self.result = np.array([vocab[a + b] for a, b in pairs])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def _rank(self, a, b):
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.order[at], self.NONE)

    def encode(self, data, starts, ends):
        """Ids of pieces of 1 to ``LONGEST`` bytes, padded with -1 to a matrix."""
        widths, col = ends - starts, np.arange(self.LONGEST)
        out = np.full((len(starts), self.LONGEST), -1)
        by_width = np.argsort(widths, kind="stable")
        for lo in range(0, len(starts), 1 << 14):
            row = by_width[lo : lo + (1 << 14)]
            wide = int(widths[row[-1]])
            at = starts[row, None] + np.minimum(col[:wide], widths[row, None] - 1)
            s = np.where(col[:wide] < widths[row, None] - 1, self.inner[data[at]], self.final[data[at]])
            s[col[:wide] >= widths[row, None]] = -1
            rank = self._rank(s[:, :-1], s[:, 1:])
            while True:
                done = np.ones(len(row), bool)
                if rank.shape[1]:
                    m = rank.argmin(1)
                    best = rank[np.arange(len(row)), m]
                    done = best == self.NONE
                out[row[done], : s.shape[1]] = s[done]
                if done.all():
                    break
                row, s, rank, m, best = (x[~done] for x in (row, s, rank, m, best))
                n = np.arange(len(row))
                s[n, m] = self.result[best]
                s = np.take_along_axis(s, col[: s.shape[1] - 1] + (col[: s.shape[1] - 1] > m[:, None]), 1)
                wide = s.shape[1]
                if wide == 1:
                    rank = rank[:, :0]
                    continue
                rank = np.take_along_axis(rank, col[: wide - 1] + (col[: wide - 1] > m[:, None]), 1)
                for k in (m - 1, m):
                    ok = (k >= 0) & (k < wide - 1)
                    rank[n[ok], k[ok]] = self._rank(s[n[ok], k[ok]], s[n[ok], k[ok] + 1])
        return out


@cache
def merges(path):
    return Merges(tokenizer(path))


class WordCoder:
    """Ids of byte slices; one per task."""

    def __init__(self, path):
        self.tokenizer, self.merges = tokenizer(path), merges(path)
        self._clear()

    def _clear(self):
        self.keys, self.first, self.counts = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys, low, kind, starts, ends):
        plain = (kind[starts] == LETTER) & (ends - starts <= Merges.LONGEST)
        table = self.merges.encode(low, starts[plain], ends[plain])
        raw, rest = low.tobytes(), np.flatnonzero(~plain)
        pieces = [raw[starts[i] : ends[i]].decode() for i in rest]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.zeros(len(keys), np.int64)
        counts[plain] = (table >= 0).sum(1)
        counts[rest] = np.fromiter(map(len, ids), np.int64, len(ids))
        first = self.used + np.cumsum(counts) - counts
        self.used += int(counts.sum())
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = np.flatnonzero(plain)
        spots = np.repeat(first[at] - np.cumsum(counts[at]) + counts[at], counts[at]) + np.arange(counts[at].sum())
        self.ids[spots] = table[table >= 0]
        for i, own in zip(rest, ids, strict=True):
            self.ids[first[i] : first[i] + len(own)] = own
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.counts = np.insert(self.counts, at, counts)

    def _places(self, keys):
        place = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return place, np.zeros(len(keys), bool)
        return place, self.keys[np.minimum(place, len(self.keys) - 1)] == keys

    def encode(self, data, offsets):
        """Ids of all documents of a slice, one after another, and each document's first id."""
        low, starts, ends, first_piece, kind = piece_spans(data, offsets)
        hashes = span_hashes(low, starts, ends)
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place, known = self._places(unique)
        if not known.all():
            if len(self.keys) > TABLE_PIECES:  # start over with the pieces of this slice
                self._clear()
                known[:] = False
            fresh = np.flatnonzero(~known)
            self._learn(unique[fresh], low, kind, starts[at[fresh]], ends[at[fresh]])
            place, _ = self._places(unique)
        first, counts = self.first[place[inverse]], self.counts[place[inverse]]
        ids = gather(self.ids, first, counts)
        return ids, np.concatenate([[0], np.cumsum(counts)])[first_piece]


def gather(values, first, counts):
    """The runs ``values[first[i] : first[i] + counts[i]]`` one after another."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return values[:0]
    return values[np.arange(total[-1]) + np.repeat(first - (total - counts), counts)]


def encoded(column, coder):
    """Yield ``(first row, last row + 1, ids, each row's first id)`` of an Arrow text column."""
    for lo, hi, data, offsets in slices(column, limit=2 * FINE_BYTES):
        yield lo, hi, *coder.encode(data, offsets)
