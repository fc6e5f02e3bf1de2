"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a node with a hidden label, content or not. What is seen of it (tag, names in
class and id, link share, length of text) depends on its label, and its label on its parent's.
Messages go up from the leaves and down from the root (sum-product), which on a tree gives exact
marginals; the text of nodes with a content marginal of a half or more is kept. All tables are
counted, with smoothing, on labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title|textarea|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|([^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""display\s*:\s*none|(?:^|\s)hidden(?:\s|=|$)""", re.I)
KEEP = re.compile(r"data-keep=(\d)")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BREAKS_P = set("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Name parts that sites use for what isn't, and for what is, their main text.
OTHER = set("ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu sidebar side footer foot header masthead comment comments reply replies disqus cookie cookies consent notice gdpr alert popup modal overlay share social related recommended subscribe newsletter signup login search breadcrumb breadcrumbs pagination pager widget toolbar tags author bio legal copyright complementary contentinfo form".split())
MAIN = set("article content post entry story body main text page prose".split())


BARRED = set("form button select dialog datalist".split())


class Node:
    __slots__ = ("tag", "parent", "names", "own", "words", "links", "keep", "barred")

    def __init__(self, tag: str, parent: int, attributes: str, barred: bool = False):
        self.tag, self.parent, self.own, self.words, self.links = tag, parent, 0, 0, 0
        parts = {p for m in NAMES.finditer(attributes) for p in re.split(r"[^a-z]+", next(g for g in m.groups("") if g or g == "").lower())} if "=" in attributes else set()
        self.names = "hidden" if HIDDEN.search(attributes) else "other" if parts & OTHER else "main" if parts & MAIN else "none"
        m = KEEP.search(attributes)
        self.keep = m and int(m[1])
        #: in a form or control, so known not to be content
        self.barred = barred or tag in BARRED


class Open:
    """The open elements: (node or -1 where inline markup has none, tag), with the places of each tag."""

    def __init__(self):
        self.stack, self.places, self.blocks, self.nodes = [(0, "#root")], {}, [0], [0]

    def push(self, node: int, tag: str) -> None:
        at = len(self.stack)
        self.stack.append((node, tag))
        self.places.setdefault(tag, []).append(at)
        if node >= 0:
            self.nodes.append(node)
            if tag not in INLINE:
                self.blocks.append(at)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            node, tag = self.stack.pop()
            self.places[tag].pop()
            if node >= 0:
                self.nodes.pop()
                if tag not in INLINE:
                    self.blocks.pop()

    def last(self, tags) -> int:
        """Place of the last open element of these tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents first, and blocks (node, text) in page order; time linear in the page."""
    nodes, held, blocks, run = [Node("#root", -1, "")], Open(), [], []

    def flush():
        if run:
            text = " ".join(entities.unescape("".join(t for t, _ in run)).split())
            if text:
                at = held.nodes[-1]
                words = text.count(" ") + 1
                blocks.append((at, text))
                nodes[at].own += words
                nodes[at].words += words
                nodes[at].links += sum(len(t.split()) for t, a in run if a)
            run.clear()

    def close(k: int):
        if len(held.nodes) > 1 and any(n >= 0 for n, _ in held.stack[k:]):
            flush()
        held.pop_to(k)

    links = 0
    for m in TOKEN.finditer(page):
        raw, slash, tag, attributes, text = m.groups()
        if text is not None:
            run.append((text, links > 0))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                links = max(0, links - 1)
            k = held.last((tag,))
            # inline markup doesn't end across the block that it is in
            if k and not (tag in INLINE and held.blocks[-1] > k):
                if held.stack[k][0] < 0 and k < len(held.stack) - 1:
                    if all(n < 0 for n, _ in held.stack[k:]):
                        held.pop_to(k)
                else:
                    close(k)
            continue
        if tag in INLINE or tag in VOID:
            if tag in ("br", "wbr", "hr", "img", "input"):
                run.append((" ", False))
                if tag == "hr":
                    flush()
                continue
            if tag in VOID:
                continue
            links += tag == "a"
            named = attributes and NAMES.search(attributes)
            if not named or tag == "a":
                held.push(-1, tag)
                continue
        else:
            flush()
            links = 0
            if tag in BREAKS_P:
                k = held.last(("p",))
                if k and held.blocks[-1] == k:
                    close(k)
            if tag in CLOSES:
                k = held.last(CLOSES[tag])
                if k > held.last(STOPS[tag]):
                    close(k)
        if tag in INLINE:
            flush()
        parent = held.nodes[-1]
        nodes.append(Node(tag, parent, attributes or "", nodes[parent].barred))
        held.push(len(nodes) - 1, tag)
    flush()
    for n in reversed(nodes[1:]):  # children come after their parents
        up = nodes[n.parent]
        up.words += n.words
        up.links += n.links
    return nodes, blocks


def seen(n: Node) -> tuple:
    share = 0 if not n.links else 1 if 3 * n.links < n.words else 2 if 3 * n.links < 2 * n.words else 3
    return (("tag", n.tag), ("names", n.names), ("links", share), ("own", 0 if not n.own else 1 if n.own < 8 else 2 if n.own < 30 else 3))


def labelled_pages(count: int = 160, seed: int = 11) -> list[str]:
    """Pages made by rule from usual layouts; data-keep marks what is main text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "nu", "pe", "ro", "su", "ti", "vo", "ze")) for _ in range(rng.randint(1, 4)))
    say = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))) + "."
    link = lambda: f"<a href='/x'>{word()} {word()}</a>"
    menu = lambda: f"<ul data-keep=0>{''.join(f'<li data-keep=0>{link()}</li>' for _ in range(rng.randint(2, 4)))}</ul>"

    def body(k: str) -> str:
        out = [f"<h1 data-keep={k}>{say(2, 10)}</h1>"]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                inner = say(1, 90)
                out.append(f"<p data-keep={k}>{inner if rng.random() < 0.7 else f'<b>{inner}</b> {link()} {say(3, 20)}'}</p>")
            elif kind < 0.8:
                out.append(f"<h2 data-keep={k}>{say(1, 8)}</h2>")
            elif kind < 0.88:
                out.append(f"<ul data-keep={k}>{''.join(f'<li data-keep={k}>{say(2, 20)}</li>' for _ in range(3))}</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote data-keep={k}><p data-keep={k}>{say(5, 40)}</p></blockquote>")
            else:
                out.append(f"<table data-keep={k}><tr data-keep={k}><td data-keep={k}>{say(1, 9)}</td><td data-keep={k}>{say(1, 9)}</td></tr></table>")
        return "".join(out)

    def aside(tag: str, name: str) -> str:
        text = f"<p data-keep=0>{say(1, 40)}</p>"
        inner = rng.choice((menu(), text, text + f"<p data-keep=0>{say(2, 30)}</p>", say(2, 25), f"<h3 data-keep=0>{say(1, 4)}</h3>{text}", f"<h3 data-keep=0>{say(1, 4)}</h3>{menu()}"))
        return f"<{tag} {f'class={chr(34)}{name}{chr(34)} ' if name else ''}data-keep=0>{inner}</{tag}>"

    extras = [("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "ad"), ("div", "ads banner"), ("div", "sidebar"), ("div", "cookie-notice"), ("section", "comments"), ("div", "comment"), ("div", "menu"), ("div", "share social"), ("div", "related"), ("div", "newsletter signup"), ("div", "footer"), ("div", "nav"), ("p", "advert"), ("div", "popup"), ("button", ""), ("span", "ad")]
    pages = []
    for i in range(count):
        main = (lambda x: f"<article data-keep=1>{x}</article>", lambda x: f"<main data-keep=1>{x}</main>", lambda x: f"<div class='content' data-keep=1>{x}</div>", lambda x: f"<main data-keep=1><article data-keep=1>{x}</article></main>", lambda x: f"<div id='post-body' data-keep=1>{x}</div>", lambda x: f"<article data-keep=1><div data-keep=1>{x}</div></article>", lambda x: f"<div data-keep=1>{x}</div>", lambda x: f"<section data-keep=1>{x}</section>")[i % 8]
        inside = body("1")
        if i % 3 == 0:
            inside += aside(*rng.choice(extras))
        before, after = [aside(*rng.choice(extras)) for _ in range(rng.randint(1, 4))], [aside(*rng.choice(extras)) for _ in range(rng.randint(1, 4))]
        rest = ["<nav data-keep=0>" + menu() + "</nav>"] if i % 2 else []
        pages.append(f"<html><body>{''.join(rest + before)}{main(inside)}{''.join(after)}<footer data-keep=0>{say(2, 12)}</footer></body></html>")
    return pages


def fit(pages: list[str]) -> dict:
    """Log tables counted on labelled pages: seen given label, and label given the parent's."""
    what, total, pair, values = [Counter(), Counter()], [0, 0], [[1.0, 1.0], [1.0, 1.0]], {}
    for page in pages:
        nodes, _ = parse(page)
        labels = [n.keep for n in nodes]
        for n in nodes:
            if n.keep is None:
                continue
            total[n.keep] += 1
            for f in seen(n):
                what[n.keep][f] += 1
                values.setdefault(f[0], set()).add(f[1])
            if n.parent >= 0 and labels[n.parent] is not None:
                pair[labels[n.parent]][n.keep] += 1
    seen_log = {}
    for f in set(what[0]) | set(what[1]):
        k = len(values[f[0]]) + 1
        seen_log[f] = tuple(math.log((what[y][f] + 0.5) / (total[y] + 0.5 * k)) for y in (0, 1))
    step = tuple(tuple(math.log(pair[a][b] / sum(pair[a])) for b in (0, 1)) for a in (0, 1))
    return {"seen": seen_log, "step": step}


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """P(content) of each node by one pass of messages up and one down."""
    get, step = model["seen"].get, model["step"]
    add = lambda x, y: x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))
    n = len(nodes)
    up = []
    for node in nodes:
        a = b = 0.0
        if node.parent >= 0 and node.tag not in ("html", "body"):
            for f in seen(node):
                if v := get(f):
                    a += v[0]
                    b += v[1]
            if node.barred:
                b -= 1e4
        up.append([a, b])
    sent = [None] * n
    (s00, s01), (s10, s11) = step
    for i in range(n - 1, 0, -1):
        a, b = up[i]
        if nodes[i].tag in ("html", "body"):
            sent[i] = m = (0.0, 0.0)
        else:
            sent[i] = m = (add(s00 + a, s01 + b), add(s10 + a, s11 + b))
        p = up[nodes[i].parent]
        p[0] += m[0]
        p[1] += m[1]
    out, belief = [0.5] * n, [None] * n
    belief[0] = tuple(up[0])
    for i in range(1, n):
        a, b = up[i]
        p = nodes[i].parent
        if nodes[i].tag not in ("html", "body") and nodes[p].tag not in ("html", "body", "#root"):
            q0, q1 = belief[p][0] - sent[i][0], belief[p][1] - sent[i][1]
            a, b = a + add(q0 + s00, q1 + s10), b + add(q0 + s01, q1 + s11)
        belief[i] = (a, b)
        out[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, a - b))))
    return out


def main_text(page: str | None, model: dict) -> str:
    if not page:
        return ""
    nodes, blocks = parse(page)
    p = marginals(nodes, model)
    # a page without any element is its text
    return "\n".join(t for i, t in blocks if (p[i] >= 0.5 if i else len(nodes) == 1))


def extract_pages(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text of every row; no shuffle.

    A null or empty html has an empty text; html of any length is read whole and need not be well
    formed; a text without markup is the main text itself; repeated rows are read each; null ids and
    urls stay null; other columns are ignored; an empty table gives no rows.
    """
    model = model or fit(labelled_pages())
    schema = pages.select("page_id", "url").schema.add("text", "string")
    held = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, held.value) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, schema)
