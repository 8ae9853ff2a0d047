"""Registered queries of the training-data operators, and the SQL of those that have one."""

from pyspark.sql import functions as F

from localstat.llm import alignment, bpe, conversations, crosspolytope, digest, html, langid, minhash, packing, quality, quantised, sanitise, warc


def _vocabulary(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_boosted_trees(spark, sf_dir):
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_minhash_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, threshold_percent=85)


def op3_bpe_chunk_reuse(spark, sf_dir):
    rows = bpe.encode(_table(spark, sf_dir, "documents"), _vocabulary())
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op4_quartile_digest(spark, sf_dir):
    return digest.edits(_table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark, sf_dir):
    records = warc.derive(warc.responses(_table(spark, sf_dir, "pages")), keep=["page_id"])
    return records.select(
        "page_id",
        *[c for c in warc.COLUMNS if c != "block"],
        warc.header(F.col).alias("header"),
        F.decode("block", "utf-8").alias("block"),
    )


def op6_cross_polytope_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return crosspolytope.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_language_naive_bayes(spark, sf_dir):
    rows = langid.identify(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark, sf_dir):
    rows = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op9_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary())


def op10_sanitise(spark, sf_dir):
    rows = sanitise.find(_table(spark, sf_dir, "documents"))
    n = [sanitise.count_of(k, "base").alias(f"n_{k}") for k in sanitise.KINDS]
    return rows.select(
        "doc_id",
        *n,
        F.sha2(sanitise.spans_text("base"), 256).alias("base_sha256"),
        sanitise.spans_text("spans").alias("spans"),
    )


def op11_conversation_trie(spark, sf_dir):
    return conversations.trie(_table(spark, sf_dir, "conversations"))


def op12_tokenizer_alignment(spark, sf_dir):
    paths = _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")
    digest = "IF(n_a > 0, sha2(groups, 256), '')"
    rows = alignment.scored(_table(spark, sf_dir, "documents"), *paths, groups=digest)
    return rows.withColumnRenamed("groups", "groups_sha256")


def op13_product_quantisation(spark, sf_dir):
    return quantised.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: All pairs that share a shingle, by an exact join; the components by following links.
NEAR_DUPLICATES = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM split
), sized AS (
  SELECT doc_id, len(s) AS n FROM sets
), terms AS (
  SELECT doc_id, unnest(s) AS t FROM sets
), shared AS (
  SELECT doc_id, t FROM terms WHERE t IN (SELECT t FROM terms GROUP BY t HAVING count(*) > 1)
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY u, v
), links AS (
  SELECT u, v FROM common JOIN sized x ON x.doc_id = u JOIN sized y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT u, u AS v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON b.u = r.v
), found AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM sized LEFT JOIN found ON u = doc_id"""


#: Every prefix of every rebuilt conversation as a list; a node's subtree are the prefixes it begins.
_CRC_STEPS = ", ".join(
    f"c{i + 1} AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM c{i})"
    for i in range(8)
)
CONVERSATION_TRIE = f"""
WITH c0 AS (SELECT i, i AS v FROM range(256) t(i)), {_CRC_STEPS},
crcs AS (SELECT list(v ORDER BY i) AS crc FROM c8),
turns AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(t ORDER BY n) AS turns FROM turns GROUP BY conv_id
), bytes AS (
  SELECT conv_id, turns, [ascii(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')] AS b FROM own
), hashed AS (
  SELECT conv_id, turns, xor(list_reduce(b, lambda a, x: xor(a >> 8, crc[CAST(xor(a, x) & 255 AS BIGINT) + 1]),
    4294967295::BIGINT), 4294967295) % 4 AS h FROM bytes, crcs
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(f.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
  FROM hashed o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS path, d = len(turns) AS ended
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ends
  FROM prefixes GROUP BY path, depth
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT n.path, n.path[1:d] AS top, (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE
    len(regexp_extract_all(n.path[n.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved,
    CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes) n LEFT JOIN children c ON c.path = n.path
), sums AS (
  SELECT top, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY top
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(c.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.path LEFT JOIN children c ON c.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]"""


def oracle_sql():
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op2_minhash_near_duplicates": NEAR_DUPLICATES, "op11_conversation_trie": CONVERSATION_TRIE}
