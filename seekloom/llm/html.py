"""Main-text extraction by a tree-structured graphical model over the DOM.

A page is parsed into block elements and their runs of text. Each node has a hidden
label (content or not). A node's own evidence (tag, words of class and id, length, share
of link text, ...) and a potential for each parent-child edge make a tree model, trained by
counting on labelled pages. Messages are summed upward from the leaves and
downward from the root, which gives each text block's exact marginal; blocks that are
likelier content than not are the page's text.

Defined cases: a null or empty page, and one without content, has an empty text; unclosed
and stray tags, open comments and broken attributes are read as browsers do, in
outline; pages of any length and depth are read whole; repeated rows each give a
row; extra columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._shared import table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder semantics annotation object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is neither markup nor text of the page: it ends at the first end tag.
RAW = frozenset("script style textarea title iframe noembed select".split())
#: Old elements that are as another.
ALIKE = {"xmp": "pre", "listing": "pre", "noframes": "object"}
#: What these hold is not shown as text; they end where as many end tags as start tags of theirs have come.
HIDDEN = frozenset("svg template".split())
#: A start tag of the key closes an open element of the value, if no element of the last group is between.
_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
CLOSES = {t: frozenset(["p"]) for t in _BLOCKS.split()} | {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
    "tbody": frozenset(["tbody", "thead", "tr", "td", "th", "p"]),
    "body": frozenset(["head", "p"]),
}
SCOPE = frozenset("html body table div article section main aside nav header footer form ul ol dl blockquote figure fieldset td th button".split())

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</\s*+([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.S,
)
_attr = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_name_part = re.compile(r"[a-z]+")
_space = re.compile(r"\s+")
_raw_end = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)", re.I) for t in RAW}
_nested = {t: re.compile(rf"<(/?){t}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:>|\Z)", re.I) for t in HIDDEN}


class Node:
    __slots__ = ("children", "label", "links", "parent", "tag", "text", "words")

    def __init__(self, tag: str, parent: int, words: tuple = (), label: str | None = None) -> None:
        self.tag, self.parent, self.words, self.label = tag, parent, words, label
        self.text, self.links = "", 0


def parse(page: str) -> list[Node]:
    """Nodes in page order, each after its parent. Text blocks have the tag ``#text``."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # of all open elements: the tag, and the block it stands for or is in
    run: list[str] = []
    state = {"links": 0, "in_link": 0}

    def flush() -> None:
        if run:
            text = _space.sub(" ", "".join(run)).strip()
            if text:
                node = Node("#text", stack[-1][1])
                node.text, node.links = text, state["links"]
                nodes.append(node)
            run.clear()
            state["links"] = 0

    def pop() -> None:
        tag, _ = stack[-1]
        if tag not in INLINE:
            flush()
        elif tag == "a":
            state["in_link"] = max(0, state["in_link"] - 1)
        stack.pop()

    def text(raw: str) -> None:
        if raw:
            made = htmllib.unescape(raw)
            run.append(made)
            if state["in_link"]:
                state["links"] += len(made.strip())

    at, end = 0, len(page)
    while at < end:
        found = _token.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, opening = found[1], found[2]
        if closing:
            tag = ALIKE.get(closing.lower(), closing.lower())
            if tag == "br":
                run.append(" ")
            elif tag == "p" and all(t != "p" for t, _ in stack):
                flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
        elif opening:
            tag = ALIKE.get(opening.lower(), opening.lower())
            if tag in RAW:
                ended = _raw_end[tag].search(page, at)
                at = ended.end() if ended else end
                flush()
                continue
            if tag in HIDDEN:
                depth = 0 if found[3].rstrip().endswith("/") else 1
                while depth:
                    mark = _nested[tag].search(page, at)
                    at = mark.end() if mark else end
                    depth = 0 if mark is None else depth - 1 if mark[1] else depth if mark[0].rstrip("> \t\r\n").endswith("/") else depth + 1
                if tag != "svg":
                    flush()
                continue
            if closes := CLOSES.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        while len(stack) > k:
                            pop()
                    elif stack[k][0] in SCOPE and tag not in ("body",):
                        break
            if tag == "br":
                run.append(" ")
            elif tag in VOID:
                if tag not in INLINE:
                    flush()
            elif tag in INLINE:
                stack.append((tag, stack[-1][1]))
                state["in_link"] += tag == "a"
            else:
                flush()
                words, label = (), None
                if found[3]:
                    for m in _attr.finditer(found[3]):
                        name = m[1].lower()
                        if name in ("class", "id", "role"):
                            words += tuple(_name_part.findall((m[2] or m[3] or m[4] or "").lower()))
                        elif name == "data-label":
                            label = m[2]
                nodes.append(Node(tag, stack[-1][1], words, label))
                stack.append((tag, len(nodes) - 1))
    flush()
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """What is seen of each node."""
    made = []
    for node in nodes:
        if node.tag != "#text":
            made.append([f"tag {node.tag}", *{f"word {w}" for w in node.words}])
            continue
        size, text = len(node.text), node.text
        seen = [f"in {nodes[node.parent].tag}", f"size {min(8, size.bit_length())}", f"links {min(4, 4 * node.links // max(size, 1))}"]
        if "©" in text[:80]:
            seen.append("copyright")
        if text[-1] in ".!?…:\"”":
            seen.append("sentence")
        made.append(seen)
    return made


def _edge(node: Node) -> str:
    """Which potential joins a node to its parent: an unnamed element is as its parent more often than a named one."""
    return "named" if node.words else node.tag


class TreeModel:
    """Node evidence and edge potentials, all in logarithms: index 1 is content."""

    def __init__(self, pages: list[str]) -> None:
        seen, total = defaultdict(lambda: [0.0, 0.0]), {"#text": [0.0, 0.0], "other": [0.0, 0.0]}
        edges = defaultdict(lambda: [[0.2, 0.02], [0.02, 0.2]])
        for page in pages:
            nodes = parse(page)
            labels: list[int] = []
            for node, seen_here in zip(nodes, features(nodes), strict=True):
                above = labels[node.parent] if node.parent >= 0 else 1
                label = above if node.label is None else int(node.label)
                labels.append(label)
                kind = "#text" if node.tag == "#text" else "other"
                total[kind][label] += 1
                for f in seen_here:
                    seen[kind, f][label] += 1
                if node.parent >= 0:
                    edges[_edge(node)][above][label] += 1
        self._seen = {k: tuple(math.log((n[c] + 0.5) / (total[k[0]][c] + 1)) for c in (0, 1)) for k, n in seen.items()}
        self._edges = {k: [[math.log(x / sum(row)) for x in row] for row in rows] for k, rows in edges.items()}
        self._unseen = [[math.log(x) for x in row] for row in ((0.98, 0.02), (0.1, 0.9))]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each node is content."""
        n = len(nodes)
        own = [[0.0, 0.0] for _ in range(n)]
        for k, (node, seen) in enumerate(zip(nodes, features(nodes), strict=True)):
            kind = "#text" if node.tag == "#text" else "other"
            for f in seen:
                if logs := self._seen.get((kind, f)):
                    own[k][0] += logs[0]
                    own[k][1] += logs[1]
        edges = [self._edges.get(_edge(node), self._unseen) for node in nodes]
        up = [[0.0, 0.0] for _ in range(n)]  # what a node tells its parent
        for k in range(n - 1, 0, -1):
            e, (a, b) = edges[k], own[k]
            for y in (0, 1):
                up[k][y] = _add(e[y][0] + a, e[y][1] + b)
            parent = own[nodes[k].parent]  # from here on own[k] holds the evidence at and below k
            parent[0] += up[k][0]
            parent[1] += up[k][1]
        down = [[math.log(0.5), math.log(0.5)] for _ in range(n)]
        for k in range(1, n):
            p = nodes[k].parent
            a, b = own[p][0] - up[k][0] + down[p][0], own[p][1] - up[k][1] + down[p][1]
            top = max(a, b)
            e = edges[k]
            for y in (0, 1):
                down[k][y] = _add(e[0][y] + a - top, e[1][y] + b - top)
        return [1 / (1 + math.exp(min(700.0, max(-700.0, own[k][0] + down[k][0] - own[k][1] - down[k][1])))) for k in range(n)]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        return "\n\n".join(node.text for node, p in zip(nodes, self.marginals(nodes), strict=True) if p >= 0.5 and node.tag == "#text")


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


# Labelled pages. Boilerplate is marked by data-label="0", the article by "1"; what is not marked is as its parent.

_SLOTS = {
    "nav": ["nav", "ul.menu", "div.navbar", "div.nav", "ul.navigation", "div#menu", "div.breadcrumb", "div.breadcrumbs", "ol.breadcrumb", "div.topbar", "ul.tabs", "div.pagination", "nav.pager", "div.toc", "div.skip", "div.navigation"],
    "head": ["header", "div.header", "div#header", "div.masthead", "div.site-header", "div.logo", "div.branding", "div.top", "header.site"],
    "foot": ["footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.legal", "div.bottom", "div.colophon", "footer.page"],
    "side": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.widget", "div.related", "section.related", "div.recommended", "ul.popular", "div.trending", "div.more", "aside.rail", "div.tags", "div.categories", "div.archive", "div.recent", "div.column-right", "div.teaser"],
    "note": ["div.cookie", "div.cookie-banner", "div.consent", "div.notice", "div.alert", "div.popup", "div.modal", "div.overlay", "div.gdpr", "div.banner", "div#cookies", "section.notice", "div.message", "div.paywall", "dialog", "div.disclaimer", "div.announcement"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.sponsor", "div.promo", "div.promotion", "ins.adsbygoogle", "aside.ad", "div.ad-slot", "div.adbox", "section.sponsored", "div.affiliate", "div.partner", "figure.ad", "p.ad", "p.sponsored"],
    "form": ["form", "form.search", "div.newsletter", "div.subscribe", "div.signup", "div.login", "form.login", "div.contact", "div.search", "form.newsletter", "div.share", "ul.social", "div.social", "div.sharing", "div.follow", "fieldset", "div.poll"],
    "talk": ["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "div.reply", "div#disqus_thread", "div.discussion", "section.responses", "div.reviews", "ul.comment-list", "article.comment", "div.respond", "section#comments", "div.replies", "div.user-comments"],
}
_MAIN = ["article", "div.article", "main", "div.content", "div#content", "div.post", "div.entry-content", "section.story", "div.article-body", "div.main", "article.post", "div.text", "div.story-body", "section.body", "div.page-content", "div.entry"]
_WORDS = "time house stone river field light winter paper glass window garden letter market bridge mountain silver corner morning story number question answer table engine forest harbour street music colour station little great early strong never often under after where before people small north".split()


def labelled_pages(count: int = 240, seed: int = 11, part: int | None = None) -> list[str]:
    """Pages of many layouts with labels, the same for the same arguments.

    ``part`` 0 or 1 takes every other name of the elements only, so models can be tested on names they haven't seen.
    """
    r = random.Random(seed)
    mine = lambda names: names if part is None else names[part::2]
    pages = []

    def words(low: int, high: int, stop: str = "") -> str:
        return " ".join(r.choice(_WORDS) for _ in range(r.randint(low, high))).capitalize() + stop

    def element(slot: str, body: str, label: str) -> str:
        tag, mark, name = re.match(r"(\w+)([.#]?)(.*)", slot).groups()
        attribute = {"": "", ".": f' class="{name}"', "#": f' id="{name}"'}[mark]
        return f'<{tag}{attribute} data-label="{label}">{body}</{tag}>'

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(r.randint(low, high))) + "</ul>"

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{words(8, 60, r.choice(['.', '.', '.', '?', '!', '']))}</p>" for _ in range(r.randint(low, high)))

    def boiler(kind: str) -> str:
        slot = r.choice(mine(_SLOTS[kind]))
        if kind == "nav":
            body = links(3, 8)
        elif kind == "head":
            body = r.choice([words(1, 4), f"<div>{words(1, 3)}</div>" + links(2, 5), f"<p>{words(2, 6)}</p>"])
        elif kind == "foot":
            body = r.choice([f"© {words(2, 8, '.')}", f"<p>{words(3, 12, '.')}</p>" + links(1, 4), f"© {words(1, 2)} · {words(6, 20, '.')}"])
        elif kind == "side":
            body = r.choice([f"<h3>{words(1, 3)}</h3>" + links(2, 6), f"<p>{words(4, 25, '.')}</p>", f"<h2>{words(1, 3)}</h2><div><p>{words(5, 30, '.')}</p></div>"])
        elif kind in ("note", "ad"):
            body = r.choice([words(3, 20, "."), f"<p>{words(5, 30, '.')}</p>", f"<p>{words(4, 18, '.')}</p><button>{words(1, 2)}</button>", f'<a href="/x">{words(2, 10)}</a>'])
        elif kind == "form":
            body = r.choice([f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>", f"<p>{words(3, 15, '.')}</p><input>", links(2, 4)])
        else:
            one = lambda: r.choice([f"<div class=\"comment\"><p>{words(1, 2)}</p><p>{words(4, 40, '.')}</p></div>", f"<li><p>{words(4, 40, '.')}</p></li>", f"<p>{words(3, 30, '.')}</p>"])
            body = r.choice(["", f"<h3>{words(1, 2)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 5)))
        return element(slot, body, "0")

    for _ in range(count):
        parts = [f"<h1>{words(3, 16)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 7)):
            x = r.random()
            if x < 0.6:
                parts.append(paragraphs(1, 3))
            elif x < 0.7:
                parts.append(f"<h2>{words(1, 8)}</h2>{paragraphs(1, 2)}")
            elif x < 0.76:
                parts.append(f"<ul><li>{words(2, 20)}</li><li>{words(2, 20, '.')}</li></ul>")
            elif x < 0.8:
                parts.append(f"<blockquote><p>{words(6, 40, '.')}</p></blockquote>")
            elif x < 0.83:
                parts.append(f"<pre>{words(3, 20)}</pre>")
            elif x < 0.86:
                parts.append(f"<figure><figcaption>{words(3, 14)}</figcaption></figure>")
            elif x < 0.89:
                parts.append(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>")
            elif x < 0.92:
                parts.append(f"<p>{words(2, 12)} <a href='/y'>{words(1, 6)}</a> {words(3, 20, '.')}</p>")
            else:
                parts.append(boiler(r.choice(["ad", "form", "side", "note", "talk"])))
        main = element(r.choice(mine(_MAIN)), "".join(parts), "1")
        if r.random() < 0.3:
            main = f"<div class=\"{r.choice(['wrapper', 'container', 'row', 'page', 'layout'])}\">{main}</div>"
        above = [boiler(k) for k in ("head", "nav", "note", "ad", "form", "side") if r.random() < 0.5]
        below = [boiler(k) for k in ("talk", "side", "ad", "form", "note", "foot") if r.random() < 0.5]
        r.shuffle(above)
        pages.append("<html><head></head><body>" + "".join(above) + main + "".join(below) + "</body></html>")
    return pages


@cache
def default_model() -> TreeModel:
    return TreeModel(labelled_pages())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (with ``html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = default_model()
        for batch in batches:
            texts = [model.extract(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.select("page_id", "url", "html").mapInArrow(run, T.StructType(kinds))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
SQL: dict[str, str] = {}
