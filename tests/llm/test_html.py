import html as entities
import re
import time

import pytest

from localstat.llm import html, warc


def brute_force(page):
    """The article of a page of the test tables: its text between block tags."""
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article[1]) if article else []
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_equals_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    expected = {r.page_id: brute_force(r.html) for r in pages.collect()}
    got = html.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got)


PROSE = "Seven long sentences stand here, one after another, so that a reader has something to read. " * 3
UNSEEN = f"""<html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body>
<header class="site-header"><a href=/>Home</a> <a href=/n>News</a></header>
<div id="cookie-notice"><p>We use cookies. <button>OK</button></p></div>
<div class="wrap"><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>
<div class="post-content"><h1>A &amp; B</h1><p>{PROSE}</p><p>{PROSE} Second&nbsp;part.</p><ul><li>{PROSE}</li></ul></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice article, thanks for writing it.</p></div></section>
<form action="/s"><label>Search</label><input name=q></form></div>
<footer>&copy; 2024 Some company. All rights reserved.</footer></body></html>"""


@pytest.fixture(scope="module")
def model(spark, sf):
    return html.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def test_unseen_layout(model):
    (text,) = html._texts([html.parse(UNSEEN)], model)
    p = PROSE.strip()
    assert text.split("\n") == ["A & B", p, p + " Second part.", p]


def test_decoder_is_consistent_and_optimal():
    import itertools

    import numpy as np

    page = html.parse("<div><p>a</p><ul><li>b<li>c</ul></div><div>d</div>")
    rng = np.random.default_rng(1)
    n = len(page.nodes)
    up = [node.parent for node in page.nodes]
    for _ in range(30):
        chance = rng.random(n)
        best = max(
            (k for k in itertools.product([0, 1], repeat=n) if k[0] and all(k[up[i]] >= k[i] for i in range(1, n))),
            key=lambda k: sum(np.log(p if on else 1 - p) for p, on in zip(chance[1:], k[1:], strict=True)),
        )
        assert html.decode(page, chance).astype(int).tolist() == list(best)


@pytest.mark.parametrize(
    "markup,blocks",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("a<!-- <p>x</p> -->b<script>var t='</p>'</script>c", ["abc"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<p title='a>b'>x &lt;tag&gt; &amp;amp; 3 < 4", ["x <tag> &amp; 3 < 4"]),
        ("</div></p><b>bold</i> rest", ["bold rest"]),
        ("<script>never closed <p>x", []),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ('<p class="x>unclosed', ["unclosed"]),
        ("<p>a</p><title-bar>t</title-bar><article>rest</article>", ["a", "t", "rest"]),
        ("<video-js>v</video-js><p>rest<svg-icon></svg-icon>", ["v", "rest"]),
        ("a<svg/>b<SVG class='x' d=\"1>2\" />c<math a=b />d", ["abcd"]),
        ("a<svg class=x/>hidden</svg>b<svg/ x>hidden</svg>c", ["abc"]),  # the slash closes nothing here
        ("a<svg><path/>hidden</svg>b<script/>hidden</script>c<template>hidden</template>d", ["abcd"]),
    ],
)
def test_parse(markup, blocks):
    assert [t for _, t in html.parse(markup).blocks] == blocks


MB = 1_000_000
HOSTILE = {
    "open tags": "<a " * (MB // 3),
    "one end": "<a " * (MB // 3) + ">",
    "empty elements": "<svg a=b " * (MB // 9) + ">",
    "open quotes": '<a href="x ' * (MB // 11) + ">",
    "ends in quotes": '<a "> " ' * (MB // 8),
    "hidden in quotes": '<svg a="></svg>" ' * (MB // 17),
    "stray ends": "<div>" * 100_000 + "</section>" * 100_000,
    "cells": "<td><table>" + "<div>" * 50_000 + "<td></td>" * 50_000,
    "comments": "<!--" * (MB // 4),
    "equals": "<svg " + "=" * MB + "/>",
    "long number": "<p>&#" + "1" * MB + ";",
}


@pytest.mark.parametrize("markup", HOSTILE.values(), ids=HOSTILE.keys())
def test_time_is_linear(markup):
    start = time.perf_counter()
    html.parse(markup)
    assert time.perf_counter() - start < 4  # about 0.5 s at most on an idle core; a quadratic parser takes hours


def test_quotes_that_never_close():
    assert [t for _, t in html.parse('<p a="1>x<p>y').blocks] == ["x", "y"]
    assert html.parse("&#" + "0" * 5000 + "65;").blocks[0][1] == "A"


NAV, FOOT = "<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav>", "<footer><p>Copyright 2024</p></footer>"


@pytest.mark.parametrize(
    "article,text",
    [
        ("<main><h1>Note</h1><p>Closed today.</p></main>", ["Note", "Closed today."]),
        ("<article><p>Hi</p></article>", ["Hi"]),
        ("<article>bare text</article>", ["bare text"]),
        ("<article><table><tr><td>only</td></tr></table></article>", ["only"]),
        ("<article><h1>T</h1><p>P</p><pre>x = 1\ny = 2</pre><p>P</p></article>", ["T", "P", "x = 1 y = 2", "P"]),
        (
            "<article><h1>T</h1><p>P</p><table><tr><th>A<th>B<tr><td>1<td>2</table><p>End.</p></article>",
            ["T", "P", "A", "B", "1", "2", "End."],
        ),
        (
            "<article><h1>T</h1><div class=comments><p>Nice one, thanks.</p></div><dl><dt>k<dd>v</dl><ul><li>one<li>two</ul></article>",
            ["T", "k", "v", "one", "two"],
        ),
    ],
)
def test_marked_articles_stay_whole(model, article, text):
    """Short ones, and blocks that are set differently."""
    expected = [t.replace("P", PROSE.strip()) if t == "P" else t for t in text]
    page = article.replace("<p>P</p>", f"<p>{PROSE}</p>")
    for before, after in (("", ""), (NAV, FOOT)):
        (found,) = html._texts([html.parse(f"<html><body>{before}{page}{after}</body></html>")], model)
        assert found.split("\n") == expected


def test_sample_takes_marked_pages(spark):
    """However rare they are; long ones count with nodes from all over the page."""
    plain = [(i, "u", f"<div><p>{PROSE}</p></div>") for i in range(40)]
    marked = [(100, "u", "<main>" + f"<p>{PROSE}</p>" * 700 + "</main>" + FOOT)]
    pages = spark.createDataFrame(plain + marked, "page_id BIGINT, url STRING, html STRING")
    only = spark.createDataFrame(marked, "page_id BIGINT, url STRING, html STRING")
    a, b = (html.fit(p, sample=1) for p in (pages, only))
    assert a[1] == b[1] and all((x.value == y.value).all() for x, y in zip(a[0], b[0], strict=True))


@pytest.mark.parametrize("part", ["<title-bar>t</title-bar>", "<video-js></video-js>", "<p>i <svg width='1'/></p>", "<math/>"])
def test_rest_of_page_after_custom_and_empty_elements(spark, sf, part):
    """In the main text and in conversion records."""
    page = f"<html><body>{part}<article><h1>A</h1><p>{PROSE}</p><p>{PROSE}</p></article></body></html>"
    assert html.visible_text(page).split("\n")[-2:] == [PROSE.strip()] * 2
    pages = spark.createDataFrame([(1, "http://a/", page)], "page_id BIGINT, url STRING, html STRING")
    (row,) = html.extract(pages).collect()
    assert row.text.split("\n")[-2:] == [PROSE.strip()] * 2
    made = {r.type: bytes(r.block).decode() for r in warc.derive(warc.responses(pages)).collect()}
    assert made["conversion"].split("\n")[-2:] == [PROSE.strip()] * 2


def test_odd_rows(spark, sf):
    schema = "page_id BIGINT, url STRING, html STRING, text STRING, n_chars STRING"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (None, "u", ""), (3, "u", deep), (4, "u", "<p>" + "word " * 100_000), (4, "u", "x"), (4, "u", "x")]
    pages = spark.createDataFrame([(*r, "t", "n") for r in rows], schema)
    got = html.extract(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == "" and html.extract(pages.limit(0)).collect() == []


def test_warc_round_trip(spark, tmp_path):
    schema = "page_id BIGINT, url STRING, html STRING, block STRING"
    rows = [(1, "http://a/", "<p>Hé</p><script>x</script>WARC/1.1\r\n\r\nb"), (2, None, None), (2, None, None), (None, "http://c/", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    sources = warc.responses(pages).collect()
    out = warc.derive(warc.responses(pages), keep=["page_id"])
    got = out.collect()
    assert len(got) == 8 and warc.derive(warc.responses(pages).limit(0)).collect() == []
    by_source = {s.record_id: s for s in sources}
    for r in got:
        block = bytes(by_source[r.refers_to].block)
        assert r.source_block_digest == warc.digest(block)
        assert r.source_payload_digest == warc.digest(block.partition(b"\r\n\r\n")[2])
        assert r.block_digest == warc.digest(bytes(r.block))
    first = {r.type: r for r in got if r.page_id == 1}
    assert bytes(first["conversion"].block).decode() == "Hé\nWARC/1.1 b"
    about = bytes(first["metadata"].block).decode()
    assert "http-status: HTTP/1.1 200 OK" in about and "http-header: Content-Type: text/html; charset=utf-8" in about
    assert f"conversion: {first['conversion'].record_id}" in about
    warc.write_warc(out, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w") + "/*.gz").collect()
    key = lambda r: (r.type, r.record_id, bytes(r.block))
    assert sorted(map(key, back)) == sorted(map(key, got))
    assert all(r.headers["warc-refers-to"] == r.refers_to for r in back)


def test_warc_codings():
    import gzip
    import zlib

    for head, body in (
        ("Content-Encoding: gzip", gzip.compress(b"<p>x")),
        ("Content-Encoding: deflate", zlib.compress(b"<p>x")),
        ("Transfer-Encoding: chunked", b"2\r\n<p\r\n2;e=1\r\n>x\r\n0\r\n\r\n"),
        ("Content-Type: text/html; charset=utf-16-le", "<p>x".encode("utf-16-le")),
        ("Content-Type: text/html; charset=none", b"<p>x"),
    ):
        status, headers, data = warc.split_http(b"HTTP/1.1 200 OK\r\nA: b\r\n c\r\n" + head.encode() + b"\r\n\r\n" + body)
        assert headers == ["A: b c", head] and warc.decoded_body(headers, data)[0] == "<p>x"
    assert list(warc.derivatives(None, None, None, None))[1][-1] == b""
    assert warc.decoded_body(["Content-Encoding: gzip"], b"junk") == ("", "undecodable")
