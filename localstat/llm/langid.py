"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters counts as a space, and runs of spaces as one.
The 1- to ``N``-grams of what remains are hashed into ``BUCKETS`` buckets. Training is one pass:
each task keeps one dense count vector per language and emits its non-zero buckets, and one
combined aggregation sums them. The log-probability matrix has ``BUCKETS`` rows and a column
per language, whatever the input's size, and is broadcast; scoring gathers its rows for the
n-grams of a slice of texts and sums them by document.

The posterior only compares the learned languages. Whether a text is in one of them at all is
told by its mean log-likelihood per n-gram, compared with that of the training texts.
"""

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.shipping import ship
from localstat.llm.text import kept_columns, slices, with_text

BUCKETS, N = 1 << 15, 3
SMOOTHING = 1.0
#: Overlapping n-grams are not independent; the posterior counts each letter this often.
WEIGHT = 1.0 / N
UNDETERMINED = "und"
#: A text is in no learned language if its n-grams are this much less likely (nats, on average)
#: than in all but the least likely ``LOW`` of the training texts of its language, and more for
#: the few n-grams of a short text, by ``CHANCE`` over the root of their number.
LOW, SLACK, CHANCE = 0.05, 2.0, 6.0
MAX_LANGUAGES = 1000  # bounds the matrix; more learned values raise an error
#: Counting n-grams takes some 200 times a slice's bytes of text, in all tasks of an executor at once.
SLICE = 1 << 17
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters():
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(data, offsets):
    """Buckets of all n-grams of the documents of a slice and each document's first one."""
    raw, letters = data.tobytes(), _letters()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets, offsets[1:], strict=False)]
    points = np.frombuffer("".join(t + "\x00" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    letter = letters[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space behind each run of letters
    at = np.flatnonzero(keep)
    points = np.where(letter[at], points[at], 32).astype(np.uint64)
    first = np.searchsorted(at, first)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    owner, buckets, key = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, N + 1):
        if len(points) < n:
            break
        key = (key[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * _MULTIPLIER
        key ^= key >> np.uint64(29)
        same = doc[n - 1 :] == doc[: len(points) - n + 1]
        buckets.append((key[same] >> np.uint64(32)).astype(np.int64) & (BUCKETS - 1))
        owner.append(doc[n - 1 :][same])
    if not owner:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    owner, buckets = np.concatenate(owner), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def _count(batches):
    counts, texts = {}, {}
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1), limit=SLICE):
            buckets, first = ngrams(data, offsets)
            langs = np.array(batch.column(0).slice(lo, hi - lo).to_pylist())
            owner = np.repeat(langs, np.diff(first))
            for lang in np.unique(langs).tolist():
                own = np.bincount(buckets[owner == lang], minlength=BUCKETS)
                counts[lang] = counts.get(lang, 0) + own
                texts[lang] = texts.get(lang, 0) + int((langs == lang).sum())
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(own[at], texts[lang]))
            ],
            names=["lang", "bucket", "n"],
        )


def fit(rows):
    """Languages (sorted), log-probability matrix and log priors out of ``(lang, text)`` rows.

    Rows with a null lang or text teach nothing. Without any row there are no languages.
    """
    ship(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null")
    rows = rows.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = table.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    found = sorted(table.limit(MAX_LANGUAGES + 1).collect())  # a row of at most BUCKETS + 1 numbers each
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts, priors = np.full((BUCKETS, len(found)), SMOOTHING), np.zeros(len(found))
    for k, (_, buckets, n) in enumerate(found):
        at, n = np.array(buckets), np.array(n)
        priors[k] = n[at < 0].sum()
        counts[at[at >= 0], k] += n[at >= 0]
    matrix = np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32)
    return [r[0] for r in found], matrix, np.log(priors / max(priors.sum(), 1)) if len(found) else priors


def _scored(docs, model, keep, *names):
    """``keep`` of ``docs``, and those ``names`` of a text's ``lang_pred, score, likelihood, grams``."""
    ship(docs.sparkSession)
    keep = list(keep)
    schema = kept_columns(docs, keep, *names)
    types = {"lang_pred": "string", "score": "double", "likelihood": "double", "grams": "bigint"}
    langs, matrix, priors = model
    rows, at = with_text(docs, keep)
    shared = docs.sparkSession.sparkContext.broadcast((np.array([*langs, UNDETERMINED]), matrix, priors))

    def run(batches):
        known, table, prior = shared.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(at), limit=SLICE):
                buckets, first = ngrams(data, offsets)
                best, score, mean = np.full(hi - lo, len(known) - 1), np.zeros(hi - lo), np.zeros(hi - lo)
                grams = np.diff(first)
                some = np.flatnonzero(grams)
                if len(some) and len(known) > 1:
                    likely = np.add.reduceat(table[buckets], first[some], axis=0, dtype=np.float64)
                    sums = prior + likely * WEIGHT
                    best[some] = sums.argmax(1)
                    score[some] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                    mean[some] = likely[np.arange(len(some)), best[some]] / grams[some]
                kept = [batch.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                found = {
                    "lang_pred": pa.array(known[best].tolist(), pa.string()), "score": pa.array(score),
                    "likelihood": pa.array(mean), "grams": pa.array(grams, pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([*kept, *[found[n] for n in names]], names=[*keep, *names])

    return rows.mapInArrow(run, ", ".join([*([schema] if keep else []), *[f"{n} {types[n]}" for n in names]]))


def predict(docs, model, keep=("doc_id",)):
    """The columns ``keep`` of ``docs``, then ``lang_pred`` and ``score`` of its column ``text``.

    ``score`` is the posterior of the predicted language. Texts that are null or have no
    letter, and all texts under a model without languages, are ``und`` with score 0.
    Ties go to the language that sorts first. Other columns are never read; repeated rows
    are scored each.
    """
    return _scored(docs, model, keep, "lang_pred", "score")


def held_out(doc_id="doc_id"):
    """Whether a document is kept from training; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("bigint").cast("string")) % 4 == 2, F.lit(True))


def identify(docs, keep=("doc_id",)):
    """Learn from the documents not held out and predict all."""
    return predict(docs, fit(docs.where(~held_out())), keep)


def recognise(docs, keep=("doc_id",)):
    """:func:`identify`, but texts in none of the learned languages are ``und``, too."""
    taught = docs.where(~held_out()).where("lang is not null and text is not null")
    model = fit(taught)
    own = _scored(taught, model, [], "lang_pred", "likelihood", "grams").where("grams > 0")
    low = own.groupBy("lang_pred").agg(F.percentile_approx("likelihood", LOW, 10_000).alias("low"))
    low = {r.lang_pred: r.low - SLACK for r in low.collect()}  # a row per language
    least = F.lit(min(low.values(), default=0.0))  # of languages that no training text is told to be
    if low:
        of = F.create_map(*[F.lit(x) for pair in low.items() for x in pair])
        least = F.coalesce(of[F.col("lang_pred")], least)
    rows = _scored(docs, model, keep, "lang_pred", "score", "likelihood", "grams")
    strange = (F.col("grams") > 0) & (F.col("likelihood") < least - CHANCE / F.sqrt("grams"))
    found = F.when(strange, F.lit(UNDETERMINED)).otherwise(F.col("lang_pred"))
    return rows.select(*keep, found.alias("lang_pred"), "score")
