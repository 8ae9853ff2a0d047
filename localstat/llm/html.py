"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block-level elements. Each node gets features of its subtree
(text, link and punctuation density), its attribute tokens, its depth, its siblings and
its ancestors; boosted trees estimate the chance that it holds any of the main text. The
decoder then takes the likeliest labelling in which a node can only be kept if its parent
is: with ``p`` the chances, ``drop(v)`` is the sum of ``log(1 - p)`` over the subtree of ``v`` and
``keep(v) = log p(v) + sum over children of max(keep, drop)``.

There are no labelled pages. The trees learn from at most ``SAMPLE`` pages among those of the
input that mark their article themselves (a teacher reads the marks; of longer pages ``SAMPLE_NODES``
nodes, spread evenly over the page), from templates of common page parts, and from copies of both
whose marks are hidden, so that the shape of the text has to tell.
"""

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from localstat.llm import trees
from localstat.llm.shipping import ship

SAMPLE = 400
SAMPLE_NODES = 500
BATCH_NODES = 20_000

# Elements of the HTML standard by their role here, and the usual names of page parts.
HIDDEN = [
    "script", "style", "noscript", "template", "title", "iframe", "svg", "math", "object", "textarea", "select",
    "canvas", "audio", "video",
]
BLOCKS = [
    "html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
BREAKS = ["br", "hr", "wbr", "img", "input"]
AWAY_TAGS = ["nav", "aside", "footer", "form", "header", "button", "menu", "dialog", "fieldset", "search", "head"]
MAIN_TAGS = ["article", "main"]
AWAY_WORDS = [
    "ad", "ads", "advert", "advertisement", "alert", "author", "banner", "bar", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "contentinfo", "cookie", "cookies", "copyright", "discussion", "disclaimer", "dropdown",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "pagination", "pager", "popup", "promo", "promotion", "reaction", "related", "replies", "reply", "responses",
    "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar",
    "topbar", "tracking", "widget",
]
MAIN_WORDS = ["article", "body", "content", "entry", "main", "post", "story", "text"]
CLOSES = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"]}
SCOPES = ["ul", "ol", "dl", "table", "menu", "dir"]

_HIDDEN, _BLOCKS, _BREAKS = set(HIDDEN), set(BLOCKS), set(BREAKS)
_AWAY_TAGS, _MAIN_TAGS, _AWAY, _MAIN = set(AWAY_TAGS), set(MAIN_TAGS), set(AWAY_WORDS), set(MAIN_WORDS)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_SPECIAL = re.compile(r"[>\"']")
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in HIDDEN}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LONG_NUMBER = re.compile(r"&#([0-9]{1000,}+)")


@dataclass
class Node:
    tag: str
    words: frozenset
    parent: int
    depth: int
    children: list = field(default_factory=list)
    chars: int = 0  # of the own text, links included
    links: int = 0
    marks: int = 0  # punctuation
    digits: int = 0


@dataclass
class Page:
    nodes: list
    blocks: list  # (node, text) in page order


class Tags:
    """Where tags end. Every character is looked at a bounded number of times, whatever the markup."""

    def __init__(self, text):
        self.text, self.last, self.ends = text, text.rfind(">"), None

    def end(self, at):
        """Place of the ``>`` that ends the tag whose name ends at ``at``.

        Quoted values may hold a ``>``; where quotes never close, the next ``>`` ends the tag.
        """
        if self.ends is None:
            found = _QUOTED.match(self.text, at)
            if found:
                return found.end() - 1
            self._fill()
        found = self.ends.get(self._next_special(at), -1)
        return found if found >= 0 else self.text.find(">", at)

    def _next_special(self, at):
        found = _SPECIAL.search(self.text, at)
        return found.start() if found else -1

    def _fill(self):
        """The end for each place where the next special character stands outside of quotes.

        Filled from right to left, and only for pages in which a quote does not close: a second
        scan of the same stretch would make such pages quadratic.
        """
        self.ends, later, after = {}, {}, {}
        places = [m.start() for m in _SPECIAL.finditer(self.text)]
        for i in range(len(places) - 1, -1, -1):
            at, c = places[i], self.text[places[i]]
            if c == ">":
                self.ends[at] = at
            else:
                closer = later.get(c)
                self.ends[at] = after.get(closer, -1) if closer is not None else -1
                later[c] = at
            # What a closing quote here leads to: the end found from the next special character.
            after[at] = self.ends[places[i + 1]] if i + 1 < len(places) else -1


def _closes_itself(attrs):
    """Whether a tag ends in a slash that is not the last character of an unquoted value."""
    if not attrs.endswith("/"):
        return False
    head = attrs[:-1]
    value = re.split(r"[\s\"']", head)[-1]
    return "=" not in value and not head[: len(head) - len(value)].rstrip().endswith("=")


def _tokens(text):
    """Text pieces ``(piece, None, None, None)`` and tags ``("", name, is an end tag, attributes)`` in page order."""
    tags, at, look = Tags(text), 0, 0
    while True:
        i = text.find("<", look)
        if i > tags.last or i < 0:  # no tag can end any more; an open comment hides the rest
            i = text.find("<!--", max(i, 0)) if i >= 0 else -1
            piece = text[at:] if i < 0 else text[at:i]
            if piece:
                yield piece, None, None, None
            return
        end, name, tag = -1, "", _NAME.match(text, i)
        if tag:
            name = tag[2].lower()
            end = tags.end(tag.end())
            attrs = text[tag.end() : end]
            if not tag[1] and name in _HIDDEN and not (name in ("svg", "math") and _closes_itself(attrs)):
                closer = _ENDS[name].search(text, end)
                end, name = closer.end() - 1 if closer else len(text) - 1, ""
            elif name in _HIDDEN:
                name = ""
        elif text.startswith("<!--", i):
            closer = text.find("-->", i + 4)
            end = closer + 2 if closer >= 0 else len(text) - 1
        elif text.startswith(("<!", "<?", "</"), i):
            end = text.find(">", i + 2)
        if end < 0:  # an ordinary character
            look = i + 1
            continue
        if i > at:
            yield text[at:i], None, None, None
        if name:
            yield "", name, bool(tag[1]), attrs
        at = look = end + 1


def _decoded(text):
    """Character references decoded; numbers of thousands of digits are cut to what tells their value."""
    return entities.unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), text))


def parse(text):
    """Tree of block elements and the texts of its blocks; never fails, and takes time linear in the page."""
    nodes, blocks, stack, run, link = [Node("#root", frozenset(), -1, 0)], [], [0], [], False
    open_at = {}  # tag: places in the stack where it is open

    def close_run():
        if run:
            words = " ".join(_decoded("".join(t for t, _ in run)).split())
            if words:
                node = nodes[stack[-1]]
                blocks.append((stack[-1], words))
                node.chars += len(words)
                node.links += min(sum(len(t.strip()) for t, linked in run if linked), len(words))
                node.marks += sum(map(words.count, ".,;:!?"))
                node.digits += sum(map(words.count, "0123456789"))
            run.clear()

    def innermost(tags):
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def pop_to(tags, limits=()):
        """Close the innermost open element of ``tags``, unless one of ``limits`` stands between."""
        k = innermost(tags)
        if k and k > innermost(limits):
            close_run()
            for at in range(len(stack) - 1, k - 1, -1):
                open_at[nodes[stack[at]].tag].pop()
            del stack[k:]

    for piece, tag, ends, attrs in _tokens(text):
        if tag is None:
            run.append((piece, link))
        elif tag == "a":
            link = not ends
        elif tag in _BREAKS:
            run.append((" ", False))
        elif tag in _BLOCKS:
            if ends:
                pop_to((tag,))
                close_run()
                link = False
                continue
            if nodes[stack[-1]].tag == "p":  # a paragraph ends where a block begins
                pop_to(("p",))
            if tag in CLOSES:
                pop_to(CLOSES[tag], SCOPES)
            close_run()
            link = False
            found = _ATTRIBUTE.findall(attrs) if attrs else ()
            words = frozenset(w.lower() for v in found for x in v for w in _WORD.findall(x))
            nodes.append(Node(tag, words, stack[-1], len(stack)))
            nodes[stack[-1]].children.append(len(nodes) - 1)
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
    close_run()
    return Page(nodes, blocks)


FEATURES = [
    "main_tag", "away_tag", "paragraph", "heading", "listing", "division", "cell", "main_word", "away_word",
    "under_main", "under_away", "holds_main", "depth", "chars", "link_share", "marks_per_char", "digits_per_char", "blocks",
    "chars_per_block", "page_share", "parent_share", "place", "siblings", "sibling_place", "sibling_chars", "paragraphs",
    "own_chars",
]
#: Columns that say what the page calls its parts; hidden in copies of the training rows.
MARKED = [FEATURES.index(f) for f in ("main_tag", "away_tag", "main_word", "away_word", "under_main", "under_away", "holds_main")]


def features(page):
    """One row of ``FEATURES`` per node."""
    nodes = page.nodes
    n = len(nodes)
    total = np.zeros((n, 6))  # chars, links, marks, digits, blocks, paragraphs of the subtree
    for node, _ in page.blocks:
        total[node, 4] += 1
    holds = np.zeros(n, bool)
    start = np.zeros(n)
    first = {}
    seen = 0
    for node, text in page.blocks:
        first.setdefault(node, seen)
        seen += len(text)
    start[:] = seen
    for i, node in enumerate(nodes):
        total[i, :4] = node.chars, node.links, node.marks, node.digits
        total[i, 5] = node.tag == "p" and node.chars > 0
        start[i] = first.get(i, seen)
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        total[up] += total[i]
        holds[up] |= holds[i] or nodes[i].tag in _MAIN_TAGS
        start[up] = min(start[up], start[i])
    x = np.zeros((n, len(FEATURES)))
    for i, node in enumerate(nodes):
        up = node.parent
        main, away = node.tag in _MAIN_TAGS, node.tag in _AWAY_TAGS
        named_main, named_away = bool(node.words & _MAIN), bool(node.words & _AWAY)
        chars, links, marks, digits, blocks, paragraphs = total[i]
        row = x[i]
        row[:9] = (
            main, away, node.tag == "p", node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            node.tag in ("ul", "ol", "li", "dl", "dd", "dt"), node.tag in ("div", "section"),
            node.tag in ("table", "tbody", "tr", "td", "th"), named_main, named_away,
        )
        if up >= 0:
            row[9] = x[up, 9] or x[up, 0] or x[up, 7]
            row[10] = x[up, 10] or x[up, 1] or x[up, 8]
            brothers = nodes[up].children
            row[20] = chars / max(total[up, 0], 1)
            row[22] = np.log1p(len(brothers))
            row[24] = np.log1p(total[up, 0] / len(brothers))
        row[11] = holds[i]
        row[12:20] = (
            node.depth, np.log1p(chars), links / max(chars, 1), marks / max(chars, 1), digits / max(chars, 1),
            np.log1p(blocks), np.log1p(chars / max(blocks, 1)), chars / max(total[0, 0], 1),
        )
        row[21] = start[i] / max(seen, 1)
        row[25:] = np.log1p(paragraphs), np.log1p(node.chars)
        for k, child in enumerate(node.children):
            x[child, 23] = (k + 1) / len(node.children)
    return x


def decode(page, chance):
    """Which nodes are kept: the likeliest labelling without a kept child of a dropped node."""
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    for i in range(len(page.nodes) - 1, 0, -1):
        up = page.nodes[i].parent
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = np.zeros(len(page.nodes), bool)
    kept[0] = True  # text outside of all elements
    for i in range(1, len(page.nodes)):
        kept[i] = kept[page.nodes[i].parent] and keep[i] > drop[i]
    return kept


def taught(page, named=False):
    """Node labels read from the page's own marks, or nothing if it has none.

    Main text is what stands in the elements for it, or ``named`` so, outside of other parts.
    """
    mark = [bool(n.words & _MAIN) if named else n.tag in _MAIN_TAGS for n in page.nodes]
    if not any(mark):
        return None
    state = ["out"] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        above = state[n.parent] if n.parent >= 0 else "out"
        if above == "away" or n.tag in _AWAY_TAGS or (n.words & _AWAY and not mark[i]):
            state[i] = "away"
        elif above == "in" or mark[i]:
            state[i] = "in"
    holds = np.zeros(len(page.nodes), bool)
    for node, _ in page.blocks:
        holds[node] |= state[node] == "in"
    for i in range(len(page.nodes) - 1, 0, -1):
        holds[page.nodes[i].parent] |= holds[i]
    return holds


def templates():
    """Pages made of common parts, and whether a name marks their main text, not an element."""
    word = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "erat", "vero"]
    rng = np.random.default_rng(7)

    def prose(n):
        return " ".join(word[i] + ("." if rng.random() < 0.1 else "") for i in rng.integers(0, len(word), n)) + "."

    def anchors(n, wrap="li"):
        return "".join(f'<{wrap}><a href="/x">{prose(2)}</a></{wrap}>' for _ in range(n))

    parts = [f"<p>{prose(n)}</p>" for n in (4, 9, 25, 60, 140)]
    parts += [f"<h2>{prose(4)}</h2>", f"<ul><li>{prose(12)}</li><li>{prose(15)}</li></ul>", f"<blockquote>{prose(30)}</blockquote>"]
    lines = "\n".join(f"{word[i]}_{i} = {word[i - 1]}({i})" for i in range(8))
    cells = "".join(f"<tr><td>{prose(1)}</td><td>{i * 37}</td></tr>" for i in range(4))
    other = [
        f"<pre>{lines}</pre>", f"<pre><code>{lines[:40]}</code></pre>", f"<table><tr><th>{prose(1)}</th><th>{prose(1)}</th></tr>{cells}</table>",
        f"<table><tbody>{cells}</tbody></table>", f"<dl><dt>{prose(2)}</dt><dd>{prose(9)}</dd></dl>", f"<p>{prose(1)}</p>", f"<div>{prose(2)}</div>",
        f"<figure><figcaption>{prose(6)}</figcaption></figure>", f"<ol><li>{prose(3)}</li><li>{prose(2)}</li></ol>", f"<h3>{prose(2)}</h3>",
        f'<p><a href="/x">{prose(3)}</a></p>', f'<p>{prose(3)} <a href="/x">{prose(5)}</a></p>',
    ]
    for k in range(320):
        short, pool = k >= 160 and k % 4 < 2, parts if k < 160 else parts + other
        body = "".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 3) if short else rng.integers(2, 14)))
        if short:
            body = other[5 + k // 4 % 2] if k % 8 < 4 else body
        name = AWAY_WORDS[k % len(AWAY_WORDS)]
        asides = [
            f"<nav><ul>{anchors(5)}</ul></nav>", f"<header><div>{prose(3)}</div>{anchors(3, 'span')}</header>",
            f"<footer><p>&copy; {prose(6)}</p></footer>", f'<div class="{name}">{prose(8)}</div>',
            f'<div id="{name}"><p>{prose(25)}</p><p>{prose(12)}</p></div>', f"<aside><h3>{prose(2)}</h3><p>{prose(20)}</p></aside>",
            f'<form action="/s"><label>{prose(2)}</label><button>{prose(1)}</button></form>',
            f'<section class="{name}"><h3>{prose(1)}</h3><div class="item"><p>{prose(30)}</p></div></section>',
        ]
        before, inside, after = (
            "".join(asides[i] for i in rng.integers(0, len(asides), rng.integers(0, 4))) for _ in range(3)
        )
        named = k % 2 == 1
        tag = "div" if named else MAIN_TAGS[k % 4 // 2]
        about = f' class="{MAIN_WORDS[k % len(MAIN_WORDS)]}"' if named else ""
        inside = inside if k % 3 == 0 else ""
        head = f"<h1>{prose(int(rng.integers(1, 9)))}</h1>"
        main = f"<{tag}{about}>{head}{body}{inside}</{tag}>"
        main = f"<div>{before}{main}{after}</div>" if k % 5 == 0 else f"{before}{main}{after}"
        yield f"<html><body>{main}</body></html>", named


def _taught_rows(text, named=False):
    page = parse(text)
    holds = taught(page, named)
    if holds is None or not page.blocks:
        return np.zeros((0, len(FEATURES) + 1))
    x = features(page)
    rows = np.column_stack([x, holds])[x[:, FEATURES.index("chars")] > 0]
    return rows[1:]


def fit(pages, sample=SAMPLE):
    """Trees learnt from templates and the ``sample`` pages, of those with marks, whose ids hash lowest."""
    ship(pages.sparkSession)
    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    marked = F.col("html").rlike(rf"(?i)<(?:{'|'.join(MAIN_TAGS)})[\s/>]")
    chosen = chosen.where(marked).orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def run(batches):
        for batch in batches:
            for text in batch.column(1).to_pylist():
                rows = _taught_rows(text)
                rows = rows[np.linspace(0, len(rows) - 1, min(len(rows), SAMPLE_NODES)).astype(int)]
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["rows"])

    own = [np.frombuffer(r.rows).reshape(-1, len(FEATURES) + 1) for r in chosen.mapInArrow(run, "rows binary").collect()]
    rows = np.concatenate([*own, *(_taught_rows(*t) for t in templates())])
    hidden = rows.copy()
    hidden[:, MARKED] = 0
    rows = np.concatenate([rows, rows, hidden])
    return trees.fit(rows[:, :-1], rows[:, -1], n_trees=40, depth=4, rate=0.25)


def _texts(pages, model):
    """Main texts of parsed pages; all their nodes are scored together."""
    x = [features(p) for p in pages]
    chance = 1 / (1 + np.exp(-trees.margins(model, np.concatenate(x)))) if x else []
    at = 0
    for page, rows in zip(pages, x, strict=True):
        kept = decode(page, chance[at : at + len(rows)])
        at += len(rows)
        yield "\n".join(text for node, text in page.blocks if kept[node])


def extract(pages, model=None):
    """``pages(page_id, url, html)`` to ``page_id, url, text, n_chars``.

    ``text`` holds the kept blocks in page order, one a line, character references decoded and
    white space inside a block made one space; it is empty for null or empty pages and for
    pages without main text. Repeated rows are extracted each; other columns are ignored; an
    empty table gives an empty one.
    """
    ship(pages.sparkSession)
    model = fit(pages) if model is None else model
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            held, size, lo = [], 0, 0

            def done(hi):
                found = list(_texts(held, model))
                columns = [batch.column(c).slice(lo, hi - lo) for c in (0, 1)]  # noqa: B023
                columns += [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

            for i, text in enumerate(batch.column(2)):
                held.append(parse(text.as_py() or ""))
                size += len(held[-1].nodes)
                if size >= BATCH_NODES:
                    yield done(i + 1)
                    held, size, lo = [], 0, i + 1
            if held:
                yield done(len(batch))

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def visible_text(text):
    """All visible text of a page, one block a line."""
    return "\n".join(t for _, t in parse(text or "").blocks)
