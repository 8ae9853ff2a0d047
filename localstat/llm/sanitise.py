"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by
pattern and checked. Each distinct value, however it is spelt, is a protected entity. A term in
a document of an entity discloses it when their pointwise mutual information, estimated over
the documents of the corpus, comes close to all the information the entity carries::

    ln(N (df(e, t) + 1/2) / ((df(e) + 1/2) (df(t) + 1/2)))  >=  DISCLOSURE * ln(N / df(e))

Such terms become spans of their own wherever they stand in a document with that entity. An
entity and a term must have met in ``SUPPORT`` different texts: equal texts, and near ones by
minhashes of their words, count once, so that copies of one document prove nothing. What
stands in a single text only cannot be told from the rest of that text. Everything is built
from DataFrame functions; the counts are combined aggregations over all documents.
"""

from pyspark.sql import functions as F

from localstat.llm.components import components
from localstat.plans.scale import materialise, sized

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 2
BANDS, ROWS = 6, 3  # texts are near if all minhashes of a band agree
DISCLOSURE = 0.9
BLOCK = 256  # elements of an array that are folded together
TERM = r"\p{L}{3,}"
MASKS = {k: f"[{k.upper()}]" for k in KINDS} | {"term": "[TERM]"}

# The patterns of the four kinds. The look-behinds (or the end of the last match,
# \G) only skip starts that cannot succeed, and the possessive quantifiers only steps back that
# cannot help, so the matches are those of the plain patterns, in time linear in the text.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _digits(c):
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind, c):
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        low = lambda p: (F.length(plain(p)) <= 3) & (F.lpad(plain(p), 3, "0") <= "255")
        return F.forall(F.split(c, r"\."), low)
    n = F.length(_digits(c))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(c))
    return n.between(10, 15)


def _let(value, use):
    """``use(value)`` with the value worked out once, though ``use`` may name it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(xs):
    last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))


def _running(xs, value, merge, start):
    """``struct(before, x)`` for each ``x``: ``before`` merges the values of all elements before it.

    Blocks are merged first, so no accumulator grows with the array: the time is linear in it.
    """
    def within(block, first):
        def step(acc, x):
            seen = F.concat(acc["seen"], F.array(acc["at"]))
            return F.struct(merge(acc["at"], value(x)).alias("at"), seen.alias("seen"))

        empty = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("seen"))
        seen = F.aggregate(block, empty, step, lambda acc: acc["seen"])
        return F.zip_with(seen, block, lambda s, x: F.struct(s.alias("before"), x.alias("x")))

    def all_blocks(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, start, lambda acc, x: merge(acc, value(x))))
        firsts = F.aggregate(totals, F.array(start), lambda acc, t: F.concat(acc, F.array(merge(F.element_at(acc, -1), t))))
        firsts = F.slice(firsts, 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, firsts, within))

    return _let(xs, lambda held: _let(_blocks(held), all_blocks))


def _placed(matches, pieces):
    """``start, end, value`` of each match; the pieces of text between them give the positions."""
    steps = F.slice(F.arrays_zip(matches.alias("m"), pieces.alias("p")), 1, F.size(matches))
    long = lambda c: F.length(c).cast("bigint")
    placed = _running(steps, lambda s: long(s["p"]) + long(s["m"]), lambda a, b: a + b, F.lit(0).cast("bigint"))

    def span(r):
        start = r["before"] + long(r["x"]["p"])
        return F.struct(start.alias("start"), (start + long(r["x"]["m"])).alias("end"), r["x"]["m"].alias("value"))

    return F.transform(placed, span)


def _found(kind, text):
    """Checked matches of a kind, in order: ``start, end, value``."""
    placed = _placed(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1))
    needs = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(needs, F.filter(placed, lambda s: _valid(kind, s["value"]))).otherwise(empty)


def base_spans(docs):
    """``doc_id``, a hash of the text, and one array of checked matches per kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), *[_found(k, F.col("text")).alias(k) for k in KINDS])


def _entity(kind, x):
    value = F.lower(x["value"])
    if kind == "ip":
        value = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
    elif kind != "email":
        value = _digits(value)
    return F.concat(F.lit(f"{kind}:"), value).alias("entity")


def _entities():
    """All entities of a row of :func:`base_spans`."""
    def named(k):
        return F.transform(k, lambda x: _entity(k, x))

    return F.array_distinct(F.concat(*[named(k) for k in KINDS]))


def _terms(text):
    """Lower-cased words in order, outside of e-mail addresses (the other kinds have no words)."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, PATTERNS["email"], " ")), F.lit(TERM), F.lit(0))


def _groups(rows):
    """``rows(mark, text)``, a row per text, to ``mark, group, terms``: near texts share a group."""
    rows = rows.select("mark", _terms(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1)))
    shingles = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i, 3))))
    rows = rows.select("mark", F.array_distinct("words").alias("terms"), shingles.alias("shingles"))
    least = lambda seed: F.array_min(F.transform("shingles", lambda h: F.xxhash64(h, F.lit(seed))))
    bands = [F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)]
    rows = materialise(rows.select("mark", "terms", F.array(*bands).alias("bands")), "profiles")
    each = rows.select(F.col("mark").alias("u"), F.explode("bands").alias("band"))
    first = each.groupBy("band").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").select("band", "v")
    near = components(each.join(sized(materialise(first, "bands")), "band").select("u", "v"))
    near = near.select(F.col("id").alias("mark"), F.col("component").alias("group"))
    rows = rows.join(sized(materialise(near, "near")), "mark", "left")
    return materialise(rows.select("mark", F.coalesce("group", "mark").alias("group"), "terms"), "groups")


def disclosing_terms(base, docs):
    """``entity, term`` pairs above the threshold; ``base`` is the staged :func:`base_spans`."""
    met = materialise(base.select("mark", F.explode(_entities()).alias("entity")).distinct(), "met")
    several = met.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("entity")
    met = materialise(met.join(sized(materialise(several, "several")), "entity"), "met")
    marks = materialise(met.select("mark").distinct(), "marks")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("mark"), text.alias("text"))
    groups = _groups(texts.join(sized(marks), "mark", "left_semi").dropDuplicates(["mark"]))

    of_group = met.join(groups.select("mark", "group"), "mark").select("entity", "group").distinct()
    of_entity = of_group.groupBy("entity").agg(F.count("*").alias("df_e")).where(F.col("df_e") >= SUPPORT)
    of_entity = materialise(of_entity, "entities")
    both = met.join(sized(of_entity), "entity").join(groups, "mark")
    both = both.select("entity", "df_e", "group", F.explode("terms").alias("term")).distinct()
    both = both.groupBy("entity", "df_e", "term").agg(F.count("*").alias("df_et")).where(F.col("df_et") >= SUPPORT)
    both = materialise(both, "pairs")
    wanted = sized(materialise(both.select("term").distinct(), "terms"))
    # Texts of these entities count by group, all other documents by row.
    inside = groups.select("group", F.explode("terms").alias("term")).join(wanted, "term").distinct()
    inside = inside.groupBy("term").agg(F.count("*").alias("n"))
    others = texts.join(sized(marks), "mark", "left_anti")
    if not both.count():
        return both.select("entity", "term")
    documents = groups.select("group").distinct().count() + others.count()
    outside = others.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(wanted, "term")
    outside = outside.groupBy("term").agg(F.count("*").alias("n"))
    of_term = inside.unionByName(outside).groupBy("term").agg(F.sum("n").alias("df_t"))

    n = F.lit(float(max(documents, 1)))
    known = F.log(n / F.col("df_e"))
    shared = F.log(n * (F.col("df_et") + 0.5) / ((F.col("df_e") + 0.5) * (F.col("df_t") + 0.5)))
    found = both.join(of_term, "term").where((known > 0) & (shared >= DISCLOSURE * known))
    return materialise(found.select("entity", "term"), "disclosing")


def _term_spans(base, docs):
    """``doc_id, mark, term``: spans of disclosing terms, outside of base spans, per document."""
    disclosing = disclosing_terms(base, docs)

    held = base.where(F.col("doc_id").isNotNull()).select("doc_id", "mark", F.explode(_entities()).alias("entity"))
    held = held.join(sized(disclosing), "entity").groupBy("doc_id", "mark")
    held = materialise(held.agg(F.sort_array(F.collect_set("term")).alias("terms")), "held")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    rows = rows.join(sized(held), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    rows = rows.select("doc_id", "mark", "text", pattern.alias("pattern"))
    matches, pieces = F.expr("regexp_extract_all(text, pattern, 0)"), F.expr("split(text, pattern, -1)")
    placed = F.transform(_placed(matches, pieces), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", "mark", placed.alias("term"))


def _free(spans, base_last):
    """Spans of ``spans``, sorted by start and rank, that overlap none of rank up to ``base_last``."""
    is_base = lambda s: s["rank"] <= base_last
    far = F.lit(1 << 62).cast("bigint")
    ends = lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0).cast("bigint"))
    left = _running(spans, ends, lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"))
    left = F.transform(F.filter(left, lambda r: is_base(r["x"]) | (r["before"] <= r["x"]["start"])), lambda r: r["x"])
    starts = lambda s: F.when(is_base(s), s["start"]).otherwise(far)
    right = _running(F.reverse(left), starts, lambda a, b: F.least(a, b), far)
    right = F.filter(right, lambda r: ~is_base(r["x"]) & (r["before"] >= r["x"]["end"]))
    return F.transform(right, lambda r: r["x"])


def find(docs):
    """All spans of ``docs(doc_id, text)``: ``doc_id, mark, base, spans``.

    ``base`` and ``spans`` are arrays of ``start, rank, kind, end`` (code points, end
    exclusive) in order of start, then kind; ``spans`` also has the disclosing terms, of kind
    ``term``, that overlap no base span. Null texts are empty. Rows without a doc_id have base
    spans only. Repeated rows get the same spans each; other columns are ignored; ``mark`` is
    the text's xxhash64.
    """
    base = materialise(base_spans(docs), "spans")
    terms = materialise(_term_spans(base, docs), "terms")
    rows = base.join(sized(terms), ["doc_id", "mark"], "left")
    order = {k: i for i, k in enumerate([*KINDS, "term"])}

    def named(k, column):
        return F.transform(
            column,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(order[k]).alias("rank"), F.lit(k).alias("kind"), x["end"].alias("end")
            ),
        )

    found = F.array_sort(F.concat(*[named(k, F.col(k)) for k in KINDS]))
    rows = rows.select("doc_id", "mark", found.alias("base"), "term")
    terms = F.coalesce("term", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    free = _free(F.array_sort(F.concat("base", named("term", terms))), order["term"] - 1)
    spans = F.when(F.size(terms) > 0, F.array_sort(F.concat("base", free))).otherwise(F.col("base"))
    return rows.select("doc_id", "mark", "base", spans.alias("spans"))


def count_of(kind, column):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("bigint")


def spans_text(column):
    """``kind:start:end`` of the spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(column, one), ",")


def masked(text, spans):
    """``text`` with each span, or run of overlapping spans, replaced by the mask of its kind."""
    mask = lambda s: F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])[s["kind"]]
    runs = _running(spans, lambda s: s["end"], lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"))
    runs = F.filter(runs, lambda r: r["x"]["start"] >= r["before"])
    part = lambda t, start, end: F.substring(t, (start + 1).cast("int"), (end - start).cast("int"))

    def cleaned(block):  # positions are counted from the block's own piece of the text, not from the start of it
        first = F.get(block, F.lit(0))["before"]
        cut = part(text, first, F.element_at(block, -1)["x"]["start"])

        def pieces(held):
            one = lambda r: F.concat(part(held, r["before"] - first, r["x"]["start"] - first), mask(r["x"]))
            return F.array_join(F.transform(block, one), "")

        return _let(cut, pieces)

    tail = part(text, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text).cast("bigint"))
    clean = F.array_join(_let(runs, lambda held: F.transform(_blocks(held), cleaned)), "")
    return F.when(F.size(spans) > 0, F.concat(clean, tail)).otherwise(text)


def sanitise(docs):
    """``docs`` with personal data and disclosing terms masked in ``text``; other columns stay.

    Null texts stay null. The order of columns is kept, and so are repeated rows.
    """
    names = docs.columns
    rows = docs.withColumn("_mark", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = find(docs).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_doc_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans")
    )
    found = materialise(found.dropDuplicates(["_doc_id", "_mark"]), "found")
    rows = rows.withColumn("_doc_id", F.col("doc_id").cast("bigint"))
    same = F.col("l._doc_id").eqNullSafe(F.col("r._doc_id")) & (F.col("l._mark") == F.col("r._mark"))
    rows = rows.alias("l").join(sized(found).alias("r"), same, "left")
    spans = F.coalesce("r._spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    clean = F.when(F.col("l.text").isNull(), F.lit(None)).otherwise(masked(F.col("l.text"), spans))
    return rows.select(*[clean.alias(n) if n == "text" else F.col(f"l.`{n}`") for n in names])
