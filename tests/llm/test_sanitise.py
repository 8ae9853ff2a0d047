import random
import re
import time

import pytest
from pyspark.sql import functions as F

from localstat.llm import sanitise
from tests.llm.conftest import documents


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_force(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only(m)) <= 15),
    ]
    found = [
        (m.start(), k, name, m.end())
        for k, (name, pattern, ok) in enumerate(rules)
        for m in re.finditer(pattern, text or "")
        if ok(m)
    ]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


def spans_of(df):
    rows = df.select("doc_id", sanitise.spans_text("base").alias("base"), sanitise.spans_text("spans").alias("spans"))
    return {r.doc_id: (r.base, r.spans) for r in rows.collect()}


def test_base_spans_equal_brute_force(spark, sf):
    rng = random.Random(4)
    alpha = list("a1.@-+_ 0(9)") + ["é", "𝒳", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "255", "256"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [
        "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "0000255.001.1.1", "1.2.3.999", "4111-1111-1111-1111x", "+1" + " " * 50 + "2",
        "@" * 9, None, "", "a" * 200_000 + "@", "1 " * 100_000, "x@y.z " * 3000,
    ]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = list(enumerate(texts))
    got = spans_of(sanitise.find(documents(spark, rows)))
    assert {i: b for i, (b, _) in got.items()} == {i: brute_force(t) for i, t in rows}


def test_disclosing_terms(spark):
    noise = random.Random(1)
    word = lambda: "".join(noise.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"{word()} {word()} the {word()}") for i in range(60)]
    for i in range(4):  # the same name near the same address in different contexts
        rows.append((100 + i, f"{word()} the Zyxwelt, {word()} zed@mail.org {word()} end. Later zyxwelt or zyxwelts"))
    for i in range(5):  # copies of one text prove nothing
        rows.append((200 + i, "the unique qqqqq stands by copy@mail.org here"))
    got = spans_of(sanitise.find(documents(spark, rows)))
    for i in range(4):
        text = dict(rows)[100 + i]
        terms = [(m.start(), m.end()) for m in re.finditer(r"(?i)\b(zyxwelt|end|later|zyxwelts)\b", text)]
        spans = [s.split(":") for s in got[100 + i][1].split(",")]
        own = {(int(a), int(b)) for k, a, b in spans if k == "term"}
        assert own <= set(terms) and {t for t in terms if text[slice(*t)].lower() == "zyxwelt"} <= own
        assert not any(text[a:b] == "the" for a, b in own)
    assert all("term" not in got[200 + i][1] for i in range(5))
    clean = sanitise.sanitise(documents(spark, rows))
    assert clean.columns == documents(spark, rows).columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(texts[i] == t for i, t in rows if i < 60)
    assert "[EMAIL]" in texts[100] and "[TERM]" in texts[100] and "zyxwelt" not in texts[100].lower()
    assert texts[200] == "the unique qqqqq stands by [EMAIL] here"


def planted():
    """Entities in two unlike texts each, the term far away; and one in near copies of a text."""
    noise = random.Random(3)
    words = lambda n: " ".join("".join(noise.choice("abcdefgh") for _ in range(12)) for _ in range(n))
    rows = [(i, f"the {words(40)}") for i in range(150)]
    spelt = [("zed@mail.org", "ZED@mail.org"), ("+1 (988) 555-2485", "+1 988 555 2485"), ("10.1.2.3", "010.001.2.03")]
    spelt += [("4111 1111 1111 1111", "4111-1111-1111-1111")]
    for k, pair in enumerate(spelt):
        for j, value in enumerate(pair):
            rows.append((1000 + 10 * k + j, f"the Zyxwelt{'abcd'[k]} {words(60)} {value} or 9.8.7.{k}{j} {words(20)}"))
    copied = words(80)
    rows += [(2000 + j, f"Qqqqq {copied} copy@mail.org {words(1)}") for j in range(6)]
    return rows


def test_two_texts_suffice_and_near_copies_count_once(spark):
    rows = planted()
    texts = {r.doc_id: r.text for r in sanitise.sanitise(documents(spark, rows)).collect()}
    for i, text in rows:
        if 1000 <= i < 2000:
            assert texts[i].startswith("the [TERM] ") and texts[i].count("[TERM]") == 1, i
        else:
            assert "[TERM]" not in texts[i]


def brute_force_mask(text):
    spans = [s.split(":") for s in brute_force(text).split(",") if s]
    out, at = "", 0
    for kind, a, b in spans:
        if int(a) >= at:
            out += text[at : int(a)] + sanitise.MASKS[kind]
        at = max(at, int(b))
    return out + text[at:]


def test_masks_and_odd_rows(spark):
    text = "é𝒳 a@b.cd, +4111111111111111, then 1.2.3.4!"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (4, "a@b.cd")]
    docs = documents(spark, rows).withColumn("spans", F.lit("clash")).withColumn("mark", F.lit(1))
    got = sanitise.sanitise(docs).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted(
        (str(i), str(None if t is None else brute_force_mask(t))) for i, t in rows
    )
    assert sanitise.sanitise(docs.limit(0)).collect() == [] and sanitise.find(docs.limit(0)).collect() == []


def test_many_matches_in_a_text(spark):
    """Folds work by blocks, so their time grows with the text, not with its square."""
    n = 100_000
    text = "".join(f"a{i}@b.cc 1.2.3.{i % 300} " for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    start = time.perf_counter()
    (row,) = sanitise.find(docs).collect()
    (clean,) = sanitise.sanitise(docs).collect()
    assert time.perf_counter() - start < 60
    expected = sorted((m.start(), m.end()) for p in (r"a[0-9]+@b\.cc", r"1\.2\.3\.(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?= )") for m in re.finditer(p, text))
    assert [(s.start, s.end) for s in row.base] == expected
    assert clean.text == "".join(f"[EMAIL] {'[IP]' if i % 300 < 256 else f'1.2.3.{i % 300}'} " for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 700])
def test_free_spans_and_masks_equal_brute_force(spark, n):
    """Sizes around a block, with spans of all kinds of overlap."""
    rng = random.Random(n)
    text = "".join(rng.choice("xyzä𝒳 ") for _ in range(n * 4 + 10))
    spans = set()
    while len(spans) < n:
        start, rank = rng.randrange(len(text) - 6), rng.choice([0, 3, 4, 4])
        spans.add((start, rank, [*sanitise.KINDS, "term"][rank], start + rng.randint(1, 6)))
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    rows = spark.createDataFrame([(text, sorted(spans))], f"text string, spans {kind}")
    (row,) = rows.select(sanitise._free(F.col("spans"), 3).alias("free"), sanitise.masked(F.col("text"), F.col("spans")).alias("clean")).collect()
    base = [s for s in spans if s[1] < 4]
    free = [s for s in spans if s[1] == 4 and not any(b[0] < s[3] and s[0] < b[3] for b in base)]
    assert sorted(map(tuple, row.free)) == sorted(free)
    clean, at = "", 0
    for start, _, name, end in sorted(spans):
        if start >= at:
            clean += text[at:start] + sanitise.MASKS[name]
        at = max(at, end)
    assert row.clean == clean + text[at:]


def test_plan_is_native(spark):
    docs = documents(spark, [(1, "a@b.cd")])
    plan = sanitise.sanitise(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", ["+1 2345 6789 0123", "9" * 5000])
def test_long_digits(spark, text):
    assert spans_of(sanitise.find(documents(spark, [(1, text)])))[1][0] == brute_force(text)
