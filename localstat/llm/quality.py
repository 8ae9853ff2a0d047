"""Quality scores by a sparse ensemble of rules over text statistics.

Boosted trees are fitted on the statistics of at most ``SAMPLE`` labelled documents. Every
path from a root to a node is a rule, a conjunction of comparisons; a lasso-penalised
logistic regression gives most rules the weight zero. The rest is compiled into one Spark
column expression over the statistics, so scoring is part of generated code.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm import trees
from localstat.llm.shipping import ship
from localstat.llm.text import FINE_BYTES, kept_columns, slices, span_hashes, with_text, word_spans

SAMPLE = 20_000
PENALTY = 1e-3
THRESHOLD = 0.3
STATISTICS = [
    "chars", "words", "word_length", "longest_word", "upper", "digits", "stops", "shouts", "signs", "bars",
    "other_marks", "foreign", "spaces", "lines", "line_words", "repeats", "distinct", "top_word", "ended", "marked",
]


def _class(*chars):
    found = np.zeros(256, bool)
    found[[ord(c) for c in "".join(chars)]] = True
    return found


_UPPER, _DIGIT = _class(*map(chr, range(65, 91))), _class("0123456789")
_LETTER = _UPPER | _class(*map(chr, range(97, 123)))
_LETTER[0x80:] = True
_STOP, _SHOUT, _SIGN, _BAR = _class(".,;:"), _class("!?"), _class("#$%&*@^~=+<>\\/_"), _class("|")
_SPACE = _class(" \t\n\x0b\x0c\r")
_OTHER = ~(_LETTER | _DIGIT | _STOP | _SHOUT | _SIGN | _BAR | _SPACE)
_FOREIGN = np.arange(256) >= 0xC0


def statistics(data, offsets):
    """One row of ``STATISTICS`` per document of a slice; all zero for an empty text."""
    n = len(offsets) - 1
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    size = np.diff(offsets)
    chars = sums((data & 0xC0) != 0x80)
    per_char = lambda table: sums(table[data]) / np.maximum(chars, 1)
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    hashes = span_hashes(data, starts, ends)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, ends - starts)
    by_word = lambda mask: np.bincount(owner, mask, n) / np.maximum(words, 1)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[new], runs)
    lines = sums(data == 10) + (size > 0)
    last = data[ends - 1] if len(ends) else data
    return np.column_stack(
        [
            np.log1p(chars), np.log1p(words), (size - sums(_SPACE[data])) / np.maximum(words, 1), np.log1p(longest),
            sums(_UPPER[data]) / np.maximum(sums(_LETTER[data]), 1), per_char(_DIGIT), per_char(_STOP),
            per_char(_SHOUT), per_char(_SIGN), per_char(_BAR), per_char(_OTHER), per_char(_FOREIGN), per_char(_SPACE),
            np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), by_word(again),
            np.bincount(o[new], minlength=n) / np.maximum(words, 1), top / np.maximum(words, 1),
            by_word(last == ord(".")), by_word(~_LETTER[last]),
        ]
    )


def _statistics_batches(keep, at):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(at), limit=FINE_BYTES):
                found = statistics(data, offsets)
                struct = pa.StructArray.from_arrays([pa.array(c) for c in found.T], names=STATISTICS)
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, struct], names=[*keep, "statistics"])

    return run


def with_statistics(docs, keep=("doc_id",)):
    """The columns ``keep`` of ``docs`` and a struct ``statistics`` of its column ``text``."""
    ship(docs.sparkSession)
    keep = list(keep)
    schema = kept_columns(docs, keep, "statistics")
    fields = ", ".join(f"{s}: double" for s in STATISTICS)
    rows, at = with_text(docs, keep)
    return rows.mapInArrow(_statistics_batches(keep, at), f"{schema}, statistics struct<{fields}>")


def _holds(rule, x):
    ok = np.ones(len(x), bool)
    for f, sign, t in rule:
        ok &= (x[:, f] <= t) if sign == "<=" else (x[:, f] > t)
    return ok


def _lasso(x, y, penalty, steps=400):
    """Accelerated proximal gradient for a logistic loss; the intercept is not penalised."""
    n, width = x.shape
    rate = 4 * n / (np.linalg.norm(x, 2) ** 2 + n)
    w, b, w_at, b_at, t = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    for _ in range(steps):
        slack = 1 / (1 + np.exp(-(x @ w_at + b_at))) - y
        step = w_at - rate * (x.T @ slack) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = b_at - rate * slack.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_at, b_at = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w, b


def fit_rules(x, y):
    """Rules with their weights, and the intercept, out of a sample's statistics and labels."""
    mixed = len(y) and y.min() < y.max()
    model = trees.fit(x, y, n_trees=30, depth=3, rate=0.3)[0] if mixed else []
    rules = sorted({rule for tree in model for rule in tree.paths()})
    if not rules:  # nothing to tell apart: the share of label 1
        share = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(share / (1 - share)))
    held = {}
    for rule in rules:  # rules that hold for the same rows are one; the shorter one stays
        held.setdefault(_holds(rule, x).tobytes(), []).append(rule)
    rules = [min(r, key=lambda r: (len(r), r)) for r in held.values()]
    matrix = np.column_stack([_holds(r, x) for r in rules]).astype(np.float64)
    weights, start = _lasso(matrix, y, PENALTY)
    return [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], float(start)


def compiled(model):
    """The score as a column expression over the statistics."""
    rules, start = model
    log_odds = F.lit(start)
    for rule, weight in rules:
        holds = F.lit(True)
        for f, sign, t in rule:
            c = F.col(f"statistics.{STATISTICS[f]}")
            holds = holds & ((c <= t) if sign == "<=" else (c > t))
        log_odds = log_odds + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-log_odds))


def held_out(doc_id="doc_id"):
    """Whether a document's label is kept from training; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("bigint").cast("string")) % 5 == 0, F.lit(True))


def fit(docs, labels, sample=SAMPLE):
    """Rules from the rows of ``labels(doc_id, quality)`` not held out, at most ``sample`` of them.

    The sample takes the rows whose ids hash lowest. Rows with a null id or quality, and labels
    of no document, teach nothing.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y is not null").where(~held_out())
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = rows.select("doc_id").distinct()  # at most ``sample`` rows, so both may be broadcast
    found = with_statistics(texts.join(F.broadcast(ids), "doc_id")).join(F.broadcast(rows), "doc_id")
    table = found.select("y", "statistics.*").limit(4 * sample).toArrow()
    x = np.column_stack([table.column(s).to_numpy() for s in STATISTICS])
    return fit_rules(x, (table.column("y").to_numpy() > 0).astype(np.float64))


def score(docs, labels, sample=SAMPLE, keep=("doc_id",)):
    """``docs`` scored: the columns ``keep``, then ``score`` and ``predicted``.

    Null and empty texts have zero statistics and get the score of those. Without usable
    labels every score is 0.5. Other columns of ``docs`` are never read; repeated rows are
    scored each; an empty table gives an empty one.
    """
    kept_columns(docs, keep, "score", "predicted")
    stats = with_statistics(docs, keep).select(*keep, compiled(fit(docs, labels, sample)).alias("score"))
    return stats.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
