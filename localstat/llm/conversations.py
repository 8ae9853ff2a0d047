"""Prefix trie of conversations by collapsing whole sequences.

1. Turns become narrow rows: a digest of role and text, and the number of words. The texts are
   read once and never shuffled.
2. Conversations are rebuilt: the head of the first conversation of a block, then the own turns.
3. Every turn has a number that depends on its digest and its place. The sum of a conversation's
   numbers stands for the whole sequence, so identical conversations are grouped by one combined
   sum: weighted sequences, each named after its smallest member, with the ids that end there.
4. Only one conversation of each sequence goes on. Running sums of its numbers name its prefixes.
   Sequences that are proper prefixes of others are dropped by an anti-join; what is left are the
   leaves.
5. Weights and leaves are summed by prefix: at most one row for each turn of a distinct sequence,
   combined per task first. What a subtree sums over its nodes is charged to the sequence with
   the smallest id through each node, accumulated backwards along that sequence, and summed by
   prefix like the weights; so no node is joined with its ancestors or descendants.

Running sums cut conversations of more rows than a task should sort into slices
(``running_weight``). A prefix that a third of all conversations share is one key of combined
sums. Ids that end at one node are hashed in one task, since a digest is sequential, but as a
sorted stream of which no more than a batch is held.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm.shipping import ship
from localstat.plans.scale import materialise, running_weight, sized

BLOCK, HEADS = 20, 4
# Digits of each of the two numbers a turn's place is made of: 93 bits in all, and a sum of
# ten thousand million of them still fits 38 digits.
DIGITS = 14
WORDS = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def narrow(conversations):
    """Turns of ``conversations(conv_id, turn, role, text)`` as ``conv_id, pos, a, b, words``.

    ``pos`` counts from 0 in the order of ``turn``, null first; rows of one turn stand in an order
    fixed by their content. ``a`` and ``b`` digest role and text, null ones as empty. Rows
    without a conv_id are dropped; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    part = lambda start: F.conv(F.substring("_md5", start, 15), 16, 10).cast("bigint")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        digest.alias("_md5"),
        F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"),
    )
    rows = materialise(rows.select("conv_id", "turn", part(1).alias("a"), part(17).alias("b"), "words"), "turns")
    numbered = running_weight(rows, ["conv_id"], ["turn", "a", "b"], "_n")
    return numbered.select("conv_id", (F.col("_n") - 1).alias("pos"), "a", "b", "words")


def rebuilt(turns):
    """Rebuilt conversations and their ids, out of :func:`narrow` rows.

    Conversation c takes the first ``h = crc32(decimal c) % HEADS`` turns of conversation
    ``c - c % BLOCK`` (all if fewer, none if absent; the remainder has the sign of c), then its
    own turns after its first ``h``.
    """
    turns = materialise(turns, "numbered")
    first = F.col("conv_id") - F.col("conv_id") % BLOCK
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("first", first)
    ids = ids.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS)
    ids = materialise(ids, "conversations")
    firsts = ids.where("conv_id = first").select("first", F.col("n").alias("n_first"))
    ids = ids.join(sized(materialise(firsts, "firsts")), "first", "left")
    # The own turns move up where the head is shorter than asked for.
    missing = F.col("h") - F.least("h", F.coalesce("n_first", F.lit(0)))
    ids = materialise(ids.select("conv_id", "first", "h", missing.alias("missing")), "heads")
    heads = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") == first))
    heads = materialise(heads.withColumnRenamed("conv_id", "first"), "first_turns")
    head = ids.where("h > 0").join(sized(heads), "first").where("pos < h")
    own = turns.join(sized(ids), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("missing"))
    columns = ["conv_id", "pos", "a", "b", "words"]
    return head.select(columns).unionByName(own.select(columns)), ids.select("conv_id")


def _terms(rows):
    """The number of each turn at its place (``depth`` counts from 1)."""
    number = lambda *c: F.pmod(F.xxhash64(*c, "pos"), F.lit(10**DIGITS)).cast("decimal(28,0)")
    term = (number("a", "b") * F.lit(10**DIGITS) + number("b", "a", F.lit(1))).cast("decimal(28,0)")
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), term.alias("term"), "words")


def _digest(batches):
    """SHA-256 of the comma-joined ids of each ``seq``; rows come sorted by seq and id."""
    seq, state, out = None, None, ([], [])
    for batch in batches:
        seqs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [0, *[i for i in range(1, len(seqs)) if seqs[i] != seqs[i - 1]], len(seqs)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            text = ",".join(map(str, ids[lo:hi])).encode()
            if seqs[lo] == seq:
                state.update(b"," + text)
                continue
            if seq is not None:
                out[0].append(seq)
                out[1].append(state.hexdigest())
            seq, state = seqs[lo], hashlib.sha256(text)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1])], names=["seq", "ends"])
            out = ([], [])
    if seq is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([state.hexdigest()])], names=["seq", "ends"])


def collapse(rows, ids):
    """Weighted sequences and the conversations of each, out of :func:`_terms` rows and all ids.

    Sequences: ``seq`` (smallest member), ``depth`` (turns), ``path`` (the sum of its numbers),
    ``weight`` (members). Conversations: ``seq, conv_id``.
    """
    sums = rows.groupBy("conv_id").agg(F.count("*").alias("depth"), F.sum("term").alias("path"))
    whole = ids.join(sums, "conv_id", "left").select(
        "conv_id",
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("path", F.lit(0)).cast("decimal(38,0)").alias("path"),
    )
    whole = materialise(whole, "whole")
    sequences = whole.groupBy("depth", "path").agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight"))
    sequences = materialise(sequences, "sequences")
    ends = whole.join(sized(sequences.select("depth", "path", "seq")), ["depth", "path"]).select("seq", "conv_id")
    return sequences, ends


def prefix_trie(rows, ids):
    """The trie of rebuilt conversations, one row per node; see :func:`trie`."""
    rows = materialise(_terms(rows), "terms")
    sequences, ends = collapse(rows, ids)
    ends = ends.repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_digest, "seq bigint, ends string")
    ends = sequences.join(sized(materialise(ends, "ends")), "seq").select("depth", "path", "ends")

    seqs = sized(materialise(sequences.select("seq"), "seqs"))
    walks = rows.withColumnRenamed("conv_id", "seq").join(seqs, "seq", "left_semi")
    walks = running_weight(materialise(walks, "walks"), ["seq"], ["depth"], "path", weight="term")
    walks = walks.withColumn("path", F.col("path").cast("decimal(38,0)"))
    above = (F.col("path") - F.col("term")).cast("decimal(38,0)").alias("above")
    root = sequences.select(
        "seq", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("decimal(38,0)").alias("path"),
        F.lit(None).cast("decimal(38,0)").alias("above"), F.lit(0).cast("bigint").alias("words"),
    )
    walks = materialise(walks.select("seq", "depth", "path", above, "words").unionByName(root), "paths")

    up = walks.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("above").alias("path"))
    leaves = sequences.join(up.distinct(), ["depth", "path"], "left_anti").select("seq", F.lit(1).alias("leaf"))
    weights = sequences.select("seq", "weight").join(leaves, "seq", "left")
    weights = sized(materialise(weights.select("seq", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf")), "weights"))
    nodes = walks.join(weights, "seq").groupBy("depth", "path").agg(
        F.min("seq").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.max("words").alias("words"),
        F.max("above").alias("above"),
    )
    nodes = materialise(nodes, "nodes")

    # Sums over subtrees: the nodes of a sequence from its end up to each depth.
    saves = nodes.select(
        F.col("conv_id").alias("seq"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saves")
    )
    tails = walks.select("seq", "depth", "path").join(saves, ["seq", "depth"], "left").na.fill(0, ["saves"])
    tails = materialise(tails.withColumn("up", -F.col("depth")), "tails")
    tails = running_weight(tails, ["seq"], ["up"], "saved_tokens", weight="saves")
    saved = tails.groupBy("depth", "path").agg(F.sum("saved_tokens").alias("saved_tokens"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("path"))
    children = children.agg(F.count("*").alias("n_children"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id")
    )
    at = ["depth", "path"]
    found = nodes.join(saved, at).join(children, at, "left").join(ends, at, "left")
    found = found.join(sized(materialise(parents, "parents")), ["depth", "above"], "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def trie(conversations):
    """Prefix trie of the rebuilt ``conversations(conv_id, turn, role, text)``, one row per node.

    A node is a distinct sequence of the first d turns (role and text) of a rebuilt conversation;
    the root has none. ``conv_id`` (smallest member) and ``depth`` name a node and say where its
    turns stand: the first ``depth`` ones of that rebuilt conversation. Columns: ``conv_id, depth,
    parent_conv_id`` (root: null), ``n_convs`` (conversations that start with the node),
    ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included),
    ``saved_tokens`` (over its subtree, ``n_convs - 1`` times the words of each node's last text)
    and ``ends_sha256`` (of the ids of conversations that end there, ascending, joined by commas).

    Null roles and texts are empty ones. Null turns come first; rows of one turn stand in an order
    fixed by their content; repeated rows are turns of their own. Rows without a conv_id are
    dropped. A conversation left without turns ends at the root. Without conversations there is
    no node. Other columns are ignored.
    """
    ship(conversations.sparkSession)
    return prefix_trie(*rebuilt(narrow(conversations)))
