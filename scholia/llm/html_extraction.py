"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree."""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .shared import pick

#: A comment, a tag, or what browsers take as a comment.  A value after ``=`` may be quoted, at any length, and then hold ``>``; a quote that never closes is a stray one.
_MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
#: Attributes whose words are features.
NAMED = {"class", "id", "role", "aria-label"}
_TOKEN = re.compile(r"[a-z]+")
#: HTML's element classes: those without an end, those whose content is no markup, those whose content a page does not show as text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes".split())
UNSEEN = set("template noscript select datalist button canvas audio video desc metadata annotation annotation-xml".split())
#: Controls, which end where a block begins if they have not before.
CONTROLS = set("select datalist button".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var object math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics svg g text tspan".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Groups of tags, and of tokens in class, id, role and label attributes, each one feature.
TAGS = [("article", "main"), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label", "input"), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("a",), ("body", "html"), ("#text",), ("dialog", "details", "ins")]
GROUPS = [
    "article post entry story content main body text blog page single prose",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar tabs pager pagination toc skip links",
    "header masthead banner top logo branding site",
    "footer bottom copyright legal colophon imprint contentinfo",
    "sidebar side aside widget rail complementary related recommended popular trending more also",
    "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle commercial dfp",
    "cookie cookies consent notice alert warning gdpr privacy popup modal overlay toast message announcement",
    "form newsletter subscribe signup login search contact register",
    "comment comments commentlist reply replies respond discussion disqus reader responses thread",
    "share social follow tools toolbar meta tags tag byline author actions",
]
_GROUP = {token: k for k, line in enumerate(GROUPS) for token in line.split()}
_TAG_GROUP = {tag: k for k, tags in enumerate(TAGS) for tag in tags}


#: Elements of drawings and formulas, which may close themselves.
FOREIGN = set("svg math g text tspan path rect circle ellipse line polyline polygon use image stop desc metadata mi mn mo ms mtext mspace mrow annotation".split())


@lru_cache(32)
def _closing(tag: str) -> re.Pattern:
    """The end tag of an element whose content is no markup; it may carry attributes."""
    return re.compile(rf"</{re.escape(tag)}(?:[\s/][^>]*+)?>", re.I)


class Node:
    __slots__ = ("attributes", "end", "hidden", "kids", "linked", "marks", "parent", "pieces", "start", "tag", "text_at", "words")

    def __init__(self, tag: str, parent: int, attributes: set[int], hidden: bool, start: int):
        self.tag, self.parent, self.attributes, self.hidden, self.start = tag, parent, attributes, hidden, start
        self.pieces, self.words, self.linked, self.marks, self.kids = [], 0, 0, 0, 0


def parse(source: str) -> list[Node]:
    """A page's nodes in page order: elements that set blocks apart or carry names, and runs of text inside elements that also hold nodes.

    Every node's ``pieces`` are (place, text) of its own text; a place tells the order in the page and
    blocks' ends stand as a line break.  Unclosed, misnested and cut-off markup is repaired as browsers do.
    """
    nodes = [Node("body", -1, set(), False, 0)]
    stack: list[tuple[str, int]] = [("body", 0)]
    opened: dict[str, list[int]] = {}  # depths at which each tag is open
    links, at, end, place = 0, 0, len(source), 0
    last = source.rfind(">") + 1  # beyond it stands no whole tag

    def add(raw: str) -> None:
        nonlocal place
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        owner = nodes[stack[-1][1]]
        place += 1
        owner.pieces.append((place, text))
        if n := len(text.split()):
            owner.words += n
            owner.linked += n if links else 0
            owner.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    def cut() -> None:
        nonlocal place
        place += 1
        nodes[stack[-1][1]].pieces.append((place, "\n"))

    def pop(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, _ = stack[-1]
            if tag not in INLINE:
                cut()
            stack.pop()
            opened[tag].pop()
            links -= tag == "a"

    def innermost(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    from_here = 0
    while at < end:
        start = source.find("<", at)
        if start < 0:
            add(source[from_here:])
            break
        m = _MARKUP.match(source, start, last) if start < last else None
        if not m:
            at = start + 1
            if source[at : at + 1].isalpha() and source[at : at + 1].isascii() or source[at : at + 1] in ("/", "!", "?"):
                add(source[from_here:start])  # markup cut off at the page's end
                break
            if at >= end:
                add(source[from_here:])
            continue  # a bare "<" is text
        add(source[from_here:start])
        at = from_here = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                break  # a comment that never closes
            continue
        if m[1]:
            if depth := innermost((tag,)):
                pop(depth)
            elif tag == "p":
                cut()
            continue
        if tag in RAW:
            close = _closing(tag).search(source, at)
            at = from_here = close.end() if close else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                cut()
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in CLOSES_P:
            if depth := innermost(CONTROLS):
                pop(depth)
            depth = innermost(("p",))
            if depth and all(s[0] in INLINE for s in stack[depth + 1 :]):
                pop(depth)
        if tag in SCOPE and (depth := innermost(SAME[tag])) > innermost(SCOPE[tag]):
            pop(depth)
        names, hidden = set(), tag in UNSEEN
        for a in _ATTRIBUTE.finditer(m[3]):
            name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if name == "hidden":
                hidden = True
            elif name == "style":
                hidden |= bool(re.search(r"(?:^|;)\s*display\s*:\s*none\b", value))
            elif name in NAMED:
                names.update(_GROUP[t] for t in _TOKEN.findall(value) if t in _GROUP)
        if tag not in INLINE:
            cut()
        if m[3].endswith("/") and tag in FOREIGN:
            continue
        opened.setdefault(tag, []).append(len(stack))
        if tag not in INLINE or names or hidden:
            nodes.append(Node(tag, stack[-1][1], names, hidden, place))
            nodes[stack[-1][1]].kids += 1
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, stack[-1][1]))
        links += tag == "a"
    pop(1)

    # Runs of text beside other nodes become nodes of their own, so that each is judged by itself.
    for k in range(len(nodes)):
        if nodes[k].kids and nodes[k].words:
            own = nodes[k]
            run = Node("#text", k, set(), False, own.pieces[0][0])
            run.pieces, run.words, run.linked, run.marks = own.pieces, own.words, own.linked, own.marks
            own.pieces, own.words, own.linked, own.marks = [], 0, 0, 0
            own.kids += 1
            nodes.append(run)
    return nodes


FEATURES = len(TAGS) + 2 * len(GROUPS) + 21


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: its tag, its and its ancestors' names and tags, subtree density, depth, place, and its siblings' statistics."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    words, linked, marks = (np.array([getattr(x, k) for x in nodes], np.float64) for k in ("words", "linked", "marks"))
    count, heads, paragraphs = np.ones(n), np.zeros(n), np.zeros(n)
    own = np.zeros((n, len(GROUPS)))
    above = np.zeros((n, len(GROUPS)))
    tags = np.zeros((n, len(TAGS)))
    depth = np.zeros(n)
    inside = np.zeros((n, 4))  # article or main, nav or aside, header or footer, form or list
    kind = np.zeros(n, np.int64)
    order = sorted(range(n), key=lambda k: (nodes[k].parent, k))
    for k in range(n):  # a parent stands before its children, but for runs of text, whose parents do as well
        x = nodes[k]
        own[k, list(x.attributes)] = 1
        g = kind[k] = _TAG_GROUP.get(x.tag, len(TAGS) - 1)
        tags[k, g] = 1
        heads[k], paragraphs[k] = g == 4, g == 3
        if k:
            depth[k] = depth[x.parent] + 1
            above[k] = np.maximum(above[x.parent], own[x.parent])
            inside[k] = inside[x.parent]
            p = kind[x.parent]
            inside[k, 0] += p == 0
            inside[k, 1] += p in (7, 10)
            inside[k, 2] += p in (8, 9)
            inside[k, 3] += p in (5, 11)
    total = np.stack([words, linked, marks, count, heads, paragraphs], 1)
    for k in sorted(range(1, n), key=lambda k: -depth[k]):
        total[nodes[k].parent] += total[k]
    kids = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    kid_words = np.bincount(parent[1:], total[1:, 0], n) if n > 1 else np.zeros(n)
    kid_links = np.bincount(parent[1:], total[1:, 1], n) if n > 1 else np.zeros(n)
    same = np.ones(n)
    index = np.zeros(n)
    seen: dict[tuple[int, int], int] = {}
    for k in order[1:]:
        key = (nodes[k].parent, int(kind[k]))
        seen[key] = seen.get(key, 0) + 1
    first: dict[int, int] = {}
    for k in order[1:]:
        p = nodes[k].parent
        index[k] = first[p] = first.get(p, -1) + 1
        same[k] = seen[p, int(kind[k])]
    begins = np.array([x.start for x in nodes], np.float64)
    up = np.maximum(parent, 0)
    page = max(1.0, total[0, 0])
    others = np.maximum(kids[up] - 1, 0)
    return np.column_stack(
        [
            tags, own, above, inside, depth, np.array([x.hidden for x in nodes], float),
            np.log1p(words), np.log1p(total[:, 0]), total[:, 0] / page, total[:, 0] / total[:, 3],
            total[:, 1] / np.maximum(1, total[:, 0]), total[:, 2] / np.maximum(1, total[:, 0]), np.log1p(total[:, 3]), total[:, 5] / total[:, 3], total[:, 4] / total[:, 3],
            begins / max(1.0, begins.max()), index / np.maximum(1, kids[up]), np.log1p(kids[up]), same / np.maximum(1, kids[up]),
            np.where(others > 0, (kid_words[up] - total[:, 0]) / np.maximum(1, others), 0), np.where(others > 0, (kid_links[up] - total[:, 1]) / np.maximum(1, kid_words[up] - total[:, 0]), 0),
        ]
    )


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes hold main text: the likeliest choice in which nothing stands below a node that is left out.

    Two sums go up the tree: of leaving a node and all below it out, and of keeping it with the best
    choice for each child.  Then the choices go down.
    """
    n = len(nodes)
    keep, leave = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep[0] = 0.0
    levels = np.zeros(n, np.int64)
    for k in range(1, n):
        levels[k] = levels[nodes[k].parent] + 1
    for k in sorted(range(1, n), key=lambda k: -levels[k]):
        p = nodes[k].parent
        keep[p] += max(keep[k], leave[k])
        leave[p] += leave[k]
    kept = np.zeros(n, bool)
    kept[0] = True
    for k in sorted(range(1, n), key=lambda k: levels[k]):
        kept[k] = kept[nodes[k].parent] and keep[k] > leave[k] and not nodes[k].hidden
    return kept


def assemble(nodes: list[Node], kept: np.ndarray) -> str:
    """The kept nodes' text in page order; blocks' ends are line breaks among the pieces, so each becomes a space."""
    return " ".join("".join(text for _, text in sorted(p for x, k in zip(nodes, kept) if k for p in x.pieces)).split())


# ---- the labelled pages that the model is fitted on: layouts by rule, labels by construction ----

#: Pages that the model is fitted on; seed of their layouts.
PAGES, SEED = 1200, 7
#: Names that sites give to the parts of a page.
PARTS = {
    "main": ["article", "main", "main>article", "div.content", "div.post", "div.entry-content", "div#main", "div.article-body", "section.story", "div", "div.page>div.text", "main>div"],
    "nav": ["nav", "ul.menu", "div.navbar", "nav.main-navigation", "div#menu", "div.breadcrumbs", "nav.pagination", "div"],
    "header": ["header", "div.header", "div#masthead", "header.site-header", "div.topbar"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div"],
    "side": ["aside", "div.sidebar", "div.widget", "aside.related", "div.related", "section.recommended", "div#side"],
    "ad": ["div.ad", "ins.adsbygoogle", "div.sponsored", "aside.promo", "div.advert", "section.ads", "p.ad"],
    "notice": ["div.cookie-notice", "div#consent", "div.alert", "section.gdpr", "div.popup", "dialog", "p.notice", "div.banner"],
    "form": ["form", "form.newsletter", "div.subscribe", "form.search", "div.login"],
    "comments": ["div.comments", "section#comments", "ol.commentlist", "div#disqus", "section.reader-comments", "div.responses"],
    "share": ["div.share", "ul.social", "div.toolbar", "div.tags", "p.byline"],
}


class Maker:
    """Pages of many layouts whose main words all begin with ``m``, so that every node's label is known."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def text(self, low: int, high: int, main: bool) -> str:
        r = self.random
        words = [("m" if main else "b") + "".join(r.choices("aeioustrnl", k=r.randint(1, 8))) for _ in range(r.randint(low, high))]
        words = [w + r.choice(["", "", "", "", "", ",", "."]) for w in words]
        return " ".join(words).capitalize() + r.choice([".", ".", "", "!"])

    def wrap(self, how: str, inner: str) -> str:
        for part in reversed(how.split(">")):
            m = re.match(r"(\w+)(?:([.#])(.+))?", part)
            name = f' {"class" if m[2] == "." else "id"}="{m[3]}"' if m[2] else ""
            inner = f"<{m[1]}{name}>{inner}</{m[1]}>"
        return inner

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="#">{self.text(1, 4, False)}</a>' for _ in range(self.random.randint(low, high))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if self.random.random() < 0.7 else " ".join(items)

    def boiler(self, part: str) -> str:
        r = self.random
        if part in ("nav", "header"):
            inner = self.links(2, 9) + (f"<h2>{self.text(1, 4, False)}</h2>" if r.random() < 0.3 else "")
        elif part == "side":
            inner = f"<h3>{self.text(1, 4, False)}</h3>" * r.randint(0, 1) + self.links(2, 8) + f"<p>{self.text(4, 40, False)}</p>" * r.randint(0, 2)
        elif part == "form":
            inner = f"<label>{self.text(1, 4, False)}</label><input><p>{self.text(2, 12, False)}</p>"
        elif part == "comments":
            one = lambda: r.choice(["<div class='comment'>{}</div>", "<li class='comment'>{}</li>", "<div>{}</div>", "<article>{}</article>"]).format("".join(f"<p>{self.text(3, 60, False)}</p>" for _ in range(r.randint(1, 3))))
            inner = f"<h3>{self.text(1, 3, False)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6)))
        elif part == "share":
            inner = self.text(1, 6, False)
        else:
            inner = self.text(3, 40, False) if r.random() < 0.6 else "".join(f"<p>{self.text(3, 30, False)}</p>" for _ in range(r.randint(1, 3)))
        return self.wrap(r.choice(PARTS[part]), inner)

    def block(self) -> str:
        r, t = self.random, self.random.random()
        if t < 0.66:
            inner = self.text(1, 9, True) if r.random() < 0.25 else self.text(8, 160, True)
            if r.random() < 0.25:
                inner += f' <a href="#">{self.text(1, 5, True)}</a> {self.text(1, 12, True)}'
            if r.random() < 0.15:
                inner = f"<b>{inner}<br>"
            # Some paragraphs carry a name that other sites give to other parts; their length tells.
            name = f' class="{r.choice(GROUPS[1:]).split()[0]}"' if len(inner) > 100 and r.random() < 0.06 else ""
            return f"<p{name}>{inner}" + ("</p>" if r.random() < 0.75 else "")
        if t < 0.76:
            return f"<h2>{self.text(1, 8, True)}</h2>"
        if t < 0.84:
            return f"<ul>{''.join(f'<li>{self.text(2, 20, True)}</li>' for _ in range(r.randint(1, 6)))}</ul>"
        if t < 0.89:
            return f"<blockquote>{self.text(5, 60, True)}</blockquote>"
        if t < 0.93:
            return f"<table>{''.join(f'<tr><td>{self.text(1, 5, True)}</td><td>{self.text(1, 5, True)}</td></tr>' for _ in range(r.randint(1, 4)))}</table>"
        name = f' class="{"-".join(r.choice(g).split()[0] for g in r.sample([[x] for x in GROUPS], 2))}"' if r.random() < 0.2 else ""
        return f"<div{name}>{self.text(12 if name else 5, 90, True)}</div>"

    def page(self) -> str:
        r = self.random
        blocks = [self.block() for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20]))]
        for part in ("ad", "share", "side", "notice"):
            if r.random() < 0.2:
                blocks.insert(r.randint(0, len(blocks)), self.boiler(part))
        title = f"<h1>{self.text(1, 12, True)}</h1>" if r.random() < 0.8 else ""
        if title:
            blocks.insert(0, title if r.random() < 0.8 else f"<header>{title}</header>")
        if r.random() < 0.15:
            blocks.append(self.boiler("comments"))
        main = self.wrap(r.choice(PARTS["main"]), "".join(blocks))
        before = [self.boiler(p) for p in ("notice", "header", "nav", "ad", "side", "form") if r.random() < 0.45]
        after = [self.boiler(p) for p in ("ad", "share", "comments", "side", "form", "nav", "notice", "footer") if r.random() < 0.4]
        r.shuffle(before)
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.25:
            # A bare page: menu, one advert, an article of a title and paragraphs, a footer line.
            body = self.boiler("nav") + self.boiler("ad") * r.randint(0, 1) + f"<article>{title}{''.join(f'<p>{self.text(1, r.choice([3, 12, 200]), True)}</p>' for _ in range(r.randint(1, 14)))}</article>" + self.wrap(r.choice(PARTS["footer"]), self.text(2, 12, False))
        elif r.random() < 0.15:
            # Hardly more than the article: a paragraph or two, alone or with a menu or a footer.
            some = [self.boiler(p) if r.random() < 0.4 else "" for p in ("nav", "footer")]
            inner = "".join(f"<p>{self.text(1, r.choice([14, 60]), True)}</p>" for _ in range(r.randint(1, 2)))
            body = some[0] + self.wrap(r.choice(PARTS["main"]), inner) + some[1]
        if r.random() < 0.3:
            body = self.wrap(r.choice(["div.wrapper", "div#page", "div", "div.container>div.row"]), body)
        return f"<html><head><title>{self.text(1, 5, True)}</title></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def truth(nodes: list[Node]) -> np.ndarray:
    """1 for nodes with main words in them or below, by the first letters of Maker's words."""
    good = np.array([sum(w[:1].lower() == "m" for _, t in x.pieces for w in t.split()) > 0 for x in nodes], float)
    for k in sorted(range(1, len(nodes)), key=lambda k: -depth_of(nodes, k)):
        good[nodes[k].parent] = max(good[nodes[k].parent], good[k])
    return good


def depth_of(nodes: list[Node], k: int) -> int:
    n = 0
    while k > 0:
        k, n = nodes[k].parent, n + 1
    return n


@lru_cache(1)
def model(pages: int = PAGES, seed: int = SEED) -> BoostedTrees:
    """Fitted on the driver, on a fixed number of made pages: its cost and size don't depend on the input."""
    maker = Maker(seed)
    parsed = [parse(maker.page()) for _ in range(pages)]
    return BoostedTrees().fit(np.concatenate([features(x)[1:] for x in parsed]), np.concatenate([truth(x)[1:] for x in parsed]))


def texts_of(sources: list[str | None], trees: BoostedTrees) -> list[str]:
    """The main text of each page; the trees see the nodes of all pages together."""
    parsed = [parse(s) if s else [] for s in sources]
    rows = [features(x) if x else np.zeros((0, FEATURES)) for x in parsed]
    odds = trees.log_odds(np.concatenate(rows)) if any(parsed) else np.zeros(0)
    ends = np.cumsum([len(x) for x in parsed])
    return [assemble(x, decode(x, odds[e - len(x) : e].copy())) if x else "" for x, e in zip(parsed, ends)]


def extracted(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row's whole html.

    A null or empty html, and one without main text, has an empty text; null ids and urls are kept; a page of
    any length and depth is read whole, on its own beyond a megabyte; where keeping and leaving out a node
    are equally likely it is left out; repeated rows each give a row, equal pages equal texts; an empty
    table gives an empty one; other columns are left out.
    """
    held = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(batches):
        for batch in batches:
            sources, out, start = batch.column(2).to_pylist(), [], 0
            while start < len(sources):
                size, end = 0, start
                while end < len(sources) and (end == start or size < 1_000_000):
                    size, end = size + len(sources[end] or ""), end + 1
                out += texts_of(sources[start:end], held.value)
                start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
