"""The registered queries and the pipeline on the small tables."""

import numpy as np
import pytest

import corpus_pipeline
from localstat.llm import langid, quality, queries, sanitise, tokens
from localstat.llm.text import slices
from tests.llm.conftest import documents
from tests.llm.test_minhash import brute_force
from tests.llm.test_sanitise import brute_force_mask, planted
from tests.llm.test_tokens import PATH, check_pieces

COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5": ["page_id", "record_id", "type", "refers_to"],
    "op6": ["query_id", "rank", "vec_id", "score"],
    "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op8": ["doc_id", "held_out", "score", "predicted"],
    "op9": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ],
    "op12": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13": ["vec_id", "n_links", "component_id", "kept"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_columns(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.columns[: len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]
    assert df.count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def flat(text):
    import pyarrow as pa

    return next((d, o) for _, _, d, o in slices(pa.array([text]))) if text else (np.zeros(0, np.uint8), np.zeros(2, np.int64))


def test_pipeline_equals_brute_force(spark, sf):
    """Stage by stage, one document after another, in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    rules, start = quality.fit(docs, labels)
    kept = {}
    for i, text in rows.items():
        x = quality.statistics(*flat(text))
        odds = start + sum(w for rule, w in rules if quality._holds(rule, x)[0])
        if 1 / (1 + np.exp(-odds)) >= quality.THRESHOLD:
            kept[i] = text
    assert 0 < len(kept) < len(rows)

    train = docs.where(docs.doc_id.isin(list(kept))).where(~langid.held_out())
    langs, matrix, priors = langid.fit(train)
    rows, kept = kept, {}
    for i, text in rows.items():
        seen = langid.ngrams(*flat(text))[0]
        if len(seen):
            sums = priors + matrix[seen].sum(0, dtype=np.float64) / langid.N
            if 1 / np.exp(sums - sums.max()).sum() >= corpus_pipeline.LANGUAGE_SCORE:
                kept[i] = text

    groups = brute_force(kept.items(), 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    assert len(kept) < len(groups)

    pieces = corpus_pipeline.run(spark, sf).collect()
    encode = tokens.tokenizer(PATH).encode
    masked = {i: brute_force_mask(t) for i, t in kept.items()}
    ids = {i: [*encode(t, add_special_tokens=False).ids, 1] for i, t in masked.items()}
    padding = check_pieces(pieces, ids)
    assert padding < 0.02 * sum(map(len, ids.values()))


def test_stages_keep_odd_rows(spark, sf):
    """Null columns, empty and repeated rows go through every stage; extra columns are dropped."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as score", "2 as statistics", "3 as key")
    (good,) = docs.where("lang = 'en' and length(text) between 500 and 900").orderBy("doc_id").limit(1).collect()
    odd = [(None, good.text), (good.doc_id, good.text), (10**9, None), (10**9 + 1, ""), (None, None)]
    rows = spark.createDataFrame([(i, t, None, None, None, 1, 2, 3) for i, t in odd], docs.schema)
    docs = docs.unionByName(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.DOCUMENT, name
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert ids.count(None) == 1 and ids.count(good.doc_id) <= 1 and len(ids) > 50
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == [], name


def test_unlike_texts_under_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "blue", "green"))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b + " more"), (4, c), (4, c), (5, None), (5, ""), (None, a), (None, a)]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()]
    by_text = {t: [i for i, x in got if x == t] for t in (a, b, b + " more", c)}
    assert by_text[a].count(None) == 2 and len(by_text[a]) == 3
    assert len(by_text[b]) + len(by_text[b + " more"]) == 1 and by_text[c] == [4]
    assert sum(not t for _, t in got) == 1  # null and empty are one text


STRANGE = {
    "Russian": "Это предложение написано на русском языке и не имеет ничего общего с другими языками.",
    "Japanese": "これは日本語で書かれた文章です。他の言語とは関係がありません。",
    "Polish": "To jest zdanie napisane w języku polskim i nie ma nic wspólnego z innymi językami tego zbioru.",
    "noise": "xqzj wvkk qqzx jjwv kxzq vvkw zzqj " * 3,
}


def test_language_stage_drops_unlearned_languages(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select(corpus_pipeline.DOCUMENT)
    plain = ["This is a sentence about the weather.", "Voici une phrase simple sur la vie.", "Dies ist ein Satz."]
    odd = [*STRANGE.values(), *(t * 40 for t in STRANGE.values())]
    rows = [(10**9 + i, t, "en" if i % 4 == 3 else None, "s", len(t)) for i, t in enumerate([*odd, *plain])]
    ids = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").select("doc_id").collect()}
    kept = corpus_pipeline.keep_language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), None)
    kept = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept - ids == {i for i, t, *_ in rows if t in plain}
    assert ids <= kept  # clean documents stay


def test_personal_data_stage_masks_terms(spark):
    masked = corpus_pipeline.mask_personal_data(spark, documents(spark, planted()), None).collect()
    assert sum("[TERM]" in r.text for r in masked) == 8


def test_masks_leave_clean_text_alone():
    assert set(sanitise.MASKS) == {*sanitise.KINDS, "term"}
