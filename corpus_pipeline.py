"""Corpus cleaning as five stages over ``documents``, each with the decisions of one operator.

A stage takes ``(spark, docs, sf_dir)`` and returns the columns of documents; the last one
returns the pieces of packed sequences. Rows without a doc_id pass the stages that only need
a text. Further columns of the input are dropped by the first stage.
"""

import public_tokenizers
from pyspark.sql import functions as F

from localstat.llm import langid, minhash, packing, quality, sanitise
from localstat.plans.scale import materialise, sized

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
LANGUAGE_SCORE = 0.5


def keep_quality(spark, docs, sf_dir):
    """Documents stay that the rule ensemble predicts to be of quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, labels, keep=DOCUMENT).where("predicted = 1").select(DOCUMENT)


def keep_language(spark, docs, sf_dir):
    """Documents stay whose language can be told: one of the learned ones, without doubt."""
    found = langid.recognise(docs, keep=DOCUMENT)
    told = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)
    return found.where(told).select(DOCUMENT)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays: 5-word shingles, similarity 0.8.

    Rows of one id and one text are copies, and one of them stays. Unlike texts under one id are
    documents of their own: all but one of them are compared under a number hashed from id and text.
    """
    rows = docs.withColumn("_mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
    unlike = materialise(first.where("_first <> _last").select("doc_id", "_first"), "unlike")
    own = F.when(F.col("_mark") != F.col("_first"), F.xxhash64("doc_id", "_mark")).otherwise(F.col("doc_id"))
    rows = rows.join(sized(unlike), "doc_id", "left").withColumn("_id", own).select("_id", *docs.columns)
    found = minhash.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), size=5, threshold_percent=80)
    kept = materialise(found.where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")), "kept")
    ids = materialise(kept.distinct(), "kept_ids")
    single = rows.join(sized(ids), "_id", "left_semi")
    if ids.count() < kept.count():
        single = single.dropDuplicates(["_id"])
    return single.unionByName(rows.where("_id is null")).select(DOCUMENT)


def mask_personal_data(spark, docs, sf_dir):
    """Personal data, and terms that give it away, are masked in the texts."""
    return sanitise.sanitise(docs).select(DOCUMENT)


def pack_sequences(spark, docs, sf_dir):
    """Texts become pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]
#: SQL cannot express fitted classifiers and tokenizers; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces that come out of all stages, each written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
