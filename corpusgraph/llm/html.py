"""HTML main-text extraction by a tree-structured graphical model.

A tolerant parser makes a tree of block-level elements and of the text runs in them. Each node is a binary variable:
it is, or holds, main text. Node potentials are linear in features of tag, parts of names, length and links;
parent-child potentials are a table for each kind of parent. Messages pass upward, then downward; a run is kept if its
marginal is above one half. Both kinds of potentials, and which parts of names count, are learned by exact likelihood on
labelled pages, which are made by rule (labelled_page), because the tables have no labels.

A null html, or one without main text, gives the empty text. Scripts, styles, controls and the like never are text.
Unclosed and crossed tags are closed as browsers do for the common cases, and a head or body tag may be absent; controls
of a form are dropped, the form itself is judged like other elements. Nesting of any depth and pages of any length are
read whole, in time that grows with the page only. Repeated rows each get a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, read

#: A tag whose quoted values have no angle brackets; others are read by Tags.slow.
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><"']*)([^<>"']*+(?:"[^"<>]*"[^<>"']*+|'[^'<>]*'[^<>"']*+)*+)>""")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; all but noscript and title end at their own end tag only.
RAW = frozenset("script style textarea title iframe xmp noembed noframes template".split())
#: Nothing in them is text of the page.
DROPPED = frozenset("head button select option datalist svg math canvas object audio video noscript dialog".split())
#: Any other start tag, or text, ends an open head.
OF_HEAD = frozenset("head title meta link base script style noscript template noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead td th tr caption ul".split()
)
CLOSES_P = BLOCKS - frozenset("html body tbody tfoot thead td th tr caption".split())
#: A start tag ends an open element of these, up to the nearest of the stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
SCOPES = frozenset(["td", "th", "table", "button", "object"])
TAGS = "html body article main section div form p nav header footer aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption address details summary #run".split()
TAG = {t: i for i, t in enumerate(TAGS)}
N_TAGS = len(TAGS) + 1
#: Tag, whether the element is inside an article, the parent's tag for runs, lengths and links. Then come the names.
N_FIXED = N_TAGS + 2 + N_TAGS + 8
#: A part of class, id and role names is a feature if so many labelled pages have it.
LEAST_PAGES = 4
#: The weight of a part of a name from which on it speaks against main text inside a block too.
AGAINST = -0.5
ROOT, OUTER, INNER, INLINE = 0, 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "names", "label", "children", "words", "chars", "linked", "text", "article", "ends", "block", "inline")

    def __init__(self, tag: str, parent: int, names: tuple = (), label: str | None = None, article: bool = False):
        self.tag, self.parent, self.names, self.label, self.article = tag, parent, names, label, article
        self.words = self.chars = self.linked = self.children = self.ends = self.block = 0
        self.text, self.inline = "", False


class Tags:
    """Where the tags of a page end, in time that grows with the page only."""

    def __init__(self, page: str):
        self.page, self.hopeless = page, set()

    def slow(self, at: int) -> int:
        """The end of a tag that begins before at: its first > outside quotes; without one the first >; 0 if there is none.

        A quote that leads to no such > is remembered, so that no stretch is read for two tags."""
        page, tried, i = self.page, [], at
        while (m := TAG_STOP.search(page, i)) is not None and m.start() not in self.hopeless:
            if m[0] == ">":
                return m.end()
            tried.append(m.start())
            if (close := page.find(m[0], m.end())) < 0:
                break
            i = close + 1
        self.hopeless.update(tried)
        return page.find(">", at) + 1


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*/?>", re.I)


def is_block(tag: str) -> bool:
    """Elements that HTML doesn't know, whose names have a hyphen, are blocks: a page's own menus and notices."""
    return tag in BLOCKS or "-" in tag


def tree(page: str, apart: frozenset[str] = frozenset()) -> list[Node]:
    """Nodes in page order, parents first; runs are nodes with tag #run, and those of one block have its number.

    apart: an inline element with one of these parts of names is a node too, so that its text is judged by itself."""
    nodes = [Node("html", -1)]
    stack = [("html", 0)]  # open elements, inline ones too, with the node that each is in
    opened: dict[str, list[int]] = {"html": [0]}  # of each tag, where it stands in the stack
    blocks = [0]  # where blocks stand in the stack
    drops: list[int] = []  # where dropped elements stand in the stack
    tags = Tags(page)
    links = 0
    run: list[str] = []
    linked = block = 0
    at, n = 0, len(page)

    def flush(ends_block: bool = True) -> None:
        nonlocal linked, block
        if run:
            whole = "".join(run)
            text = " ".join(whole.split())
            run.clear()
            if text:
                where = stack[-1][1]
                node = Node("#run", where, nodes[where].names, nodes[where].label, nodes[where].article)
                node.text, node.chars, node.words, node.linked = text, len(text), text.count(" ") + 1, min(linked, len(text))
                node.ends = sum(map(text.count, ".!?:;,"))
                node.block = block
                if not ends_block or nodes[-1].block == block and apart:  # white space at its ends stands between runs
                    node.text = " " * whole[:1].isspace() + text + " " * whole[-1:].isspace()
                nodes.append(node)
        linked = 0
        block += ends_block

    def nearest(of) -> int:
        """Where the innermost open element of some tags stands, or 0."""
        return max((x[-1] for t in of if (x := opened.get(t))), default=0)

    def end_head() -> None:
        if len(drops) == 1 and stack[drops[0]][0] == "head":
            close_to(drops[0])

    def add(text: str) -> None:
        nonlocal linked
        if drops and text and not text.isspace():
            end_head()
        if text and not drops:
            if "&" in text:
                text = entities.unescape(text)
            run.append(text)
            if links:
                linked += len(text)

    def close_to(k: int) -> None:
        nonlocal links
        if blocks[-1] >= k:
            flush()
        elif any(a[1] != b[1] for a, b in zip(stack[k - 1 :], stack[k:], strict=False)):
            flush(False)  # the end of an inline node
        for t, _ in stack[k:]:
            opened[t].pop()
            if t == "a":
                links = max(0, links - 1)
        while blocks[-1] >= k:
            blocks.pop()
        while drops and drops[-1] >= k:
            drops.pop()
        del stack[k:]

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        m = PLAIN_TAG.match(page, begin)
        if m is not None:
            add(page[at:begin])
            at = m.end()
            closing, tag, attrs = m[1], m[2].lower(), m[3]
        elif (m := TAG_NAME.match(page, begin)) is not None:
            add(page[at:begin])
            if not (at := tags.slow(m.end())):  # no tag can end from here on
                add(page[begin:])
                break
            closing, tag, attrs = m[1], m[2].lower(), page[m.end() : at - 1]
        elif page[begin + 1 : begin + 2] in ("!", "?"):
            add(page[at:begin])
            if page.startswith("<!--", begin):
                end = page.startswith((">", "->"), begin + 4) and page.find(">", begin) + 1 or ((c := COMMENT_END.search(page, begin + 4)) and c.end())
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin) + 3
                end = end if end > 2 else 0
            else:
                end = page.find(">", begin) + 1
            at = end or n
            continue
        else:
            add(page[at : begin + 1])
            at = begin + 1
            continue
        if closing:
            if tag == "br":
                add(" ")
            elif (k := nearest((tag,))) and (is_block(tag) or k > blocks[-1]):  # an inline end tag doesn't end blocks
                close_to(k)
            elif tag == "p":
                flush()
            continue
        if drops and tag not in OF_HEAD:
            end_head()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag in RAW:
            end = raw_end(tag).search(page, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES_P and (k := nearest(("p",))) > nearest(SCOPES):
            close_to(k)
        if tag in IMPLIED:
            over, stops = IMPLIED[tag]
            if (k := nearest(over)) > nearest(stops):
                close_to(k)
        where = stack[-1][1]
        named = [(a.lower(), b or c or d) for a, b, c, d in ATTRIBUTE.findall(attrs)] if attrs and (apart or is_block(tag)) else []
        names = tuple({w for k, v in named if k != "data-y" for w in NAME_PART.findall(v.lower())})
        if is_block(tag):
            flush()
            label = next((v for k, v in named if k == "data-y"), None)
            if "-" in tag:
                names = tuple({*names, *NAME_PART.findall(tag)})
            node = Node("div" if "-" in tag else tag, where, names, label or nodes[where].label, nodes[where].article or nodes[where].tag == "article")
            nodes.append(node)
            where = len(nodes) - 1
            blocks.append(len(stack))
        elif attrs.endswith("/"):
            continue
        elif not drops and not apart.isdisjoint(names):
            flush(False)
            nodes.append(Node(tag, where, names, nodes[where].label, nodes[where].article or nodes[where].tag == "article"))
            where = len(nodes) - 1
            nodes[where].inline = True
        if tag == "a":
            links += 1
        if tag in DROPPED:
            drops.append(len(stack))
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, where))
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        a, b = nodes[i], nodes[nodes[i].parent]
        b.chars += a.chars
        b.words += a.words
        b.linked += a.linked
        b.ends += a.ends
        b.children += 1
    return nodes


def active(node: Node, nodes: list[Node], names: dict[str, int]) -> list[tuple[int, float]]:
    """The features of a node that aren't zero. names: the feature of each known part of a name."""
    out = [(TAG.get(node.tag, N_TAGS - 1), 1.0), (N_TAGS + node.article, 1.0)]
    at = N_TAGS + 2
    if node.tag == "#run":
        out.append((at + TAG.get(nodes[node.parent].tag, N_TAGS - 1), 1.0))
    else:
        out += [(names[x], 1.0) for x in node.names if x in names]
    at += N_TAGS
    share = node.linked / node.chars if node.chars else 0.0
    out += [(at, min(1.0, math.log1p(node.words) / 6)), (at + 1, share), (at + 2, float(share > 0.5)), (at + 3, float(node.words > 12)), (at + 4, min(1.0, 8 * node.ends / (node.words + 1)))]
    if not node.chars:
        out.append((at + 5, 1.0))
    if node.text[:1] in ("©", "→", "«", "»"):
        out.append((at + 6, 1.0))
    out.append((at + 7, 1.0))
    return out


def kind(node: Node) -> int:
    return ROOT if node.parent < 0 else OUTER if node.tag in ("body", "div", "section", "main", "form") else INNER


def edge(nodes: list[Node], i: int) -> int:
    """Which potential joins a node to its parent: by the parent's kind. An inline node says nothing of the block that it is in."""
    return INLINE if nodes[i].inline else kind(nodes[nodes[i].parent])


def marginals(nodes: list[Node], unary: list[float], pair: list) -> tuple[list[float], list]:
    """Of each node the probability of 1, and of each edge the table of (parent, child) probabilities (row-major)."""
    n = len(nodes)
    exp, log = math.exp, math.log

    def plus(a: float, b: float) -> float:
        return a + log(1 + exp(b - a)) if a > b else b + log(1 + exp(a - b))

    up0, up1 = [0.0] * n, list(unary)
    m0, m1 = [0.0] * n, [0.0] * n  # messages to the parent
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        t = pair[edge(nodes, i)]
        a, b = up0[i], up1[i]
        m0[i], m1[i] = plus(t[0] + a, t[1] + b), plus(t[2] + a, t[3] + b)
        up0[p] += m0[i]
        up1[p] += m1[i]
    out, edges = [0.0] * n, [None] * n
    all0, all1 = list(up0), list(up1)
    for i in range(n):
        if i:
            p = nodes[i].parent
            t = pair[edge(nodes, i)]
            a, b = all0[p] - m0[i], all1[p] - m1[i]  # what the parent believes without this child
            all0[i] += plus(a + t[0], b + t[2])
            all1[i] += plus(a + t[1], b + t[3])
            e = [a + t[0] + up0[i], a + t[1] + up1[i], b + t[2] + up0[i], b + t[3] + up1[i]]
            top = max(e)
            e = [exp(x - top) for x in e]
            s = sum(e)
            edges[i] = [x / s for x in e]
        d = all1[i] - all0[i]
        out[i] = 1 / (1 + exp(-d)) if d > -700 else 0.0
        if d > 30 or d < -30 or abs(all0[i]) > 1e6:
            top = max(all0[i], all1[i])
            all0[i] -= top
            all1[i] -= top
    return out, edges


#: Names that made pages give to their elements, by what the element is.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager skip tabs toolbar",
    "head": "header masthead banner topbar branding logo hero",
    "foot": "footer foot copyright colophon contentinfo legal bottom",
    "side": "sidebar side aside widget widgets related recommended recommendations more rail complementary trending popular archive tags tagcloud author bio meta byline",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense affiliate",
    "notice": "cookie cookies notice notices consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall message toast",
    "comment": "comment comments commentlist disqus reply replies respond discussion reader responses feedback reviews",
    "social": "share sharing social follow like buttons",
    "form": "search form input",
    "text": "content article post entry main story body text page copy prose blog",
}


def labelled_page(rng: random.Random) -> str:
    """A made page whose elements say in data-y what is main text."""
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=1, b=20: words(a, b).capitalize() + rng.choice("..!?")
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'

    def named(tag: str, groups: str, inner: str, y: int | None = None, plain: float = 0.1) -> str:
        name = rng.choice(NAMES[rng.choice(groups.split())].split()) if groups and rng.random() > plain else ""
        if name and rng.random() < 0.4:
            name = rng.choice((f"{name}-{word()}", f"{word()}-{name}", f"{name} {word()}", f"site-{name}"))
        attr = rng.choice(("class", "class", "id", "role")) if name else ""
        return f"<{tag}{f' {attr}={chr(34)}{name}{chr(34)}' if name else ''}{'' if y is None else f' data-y={chr(34)}{y}{chr(34)}'}>{inner}</{tag}>"

    items = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"
    prose = lambda a=1, b=3: "".join(f"<p>{' '.join(sentence() for _ in range(rng.randint(1, 5)))}</p>" for _ in range(rng.randint(a, b)))

    def clutter() -> str:
        pick = rng.randrange(9)
        if pick == 0:
            return named("nav", "menu", items(), 0, 0.5) if rng.random() < 0.6 else named("div", "menu", items(), 0, 0)
        if pick == 1:
            return named(rng.choice(("aside", "div", "section")), "side", rng.choice((items(), prose(), f"<h3>{words(1, 4)}</h3>{items()}")), 0, 0)
        if pick == 2:
            return named(rng.choice(("div", "aside", "section", "p")), "advert", rng.choice((sentence(), link() + sentence(), prose())), 0, 0)
        if pick == 3:
            return named("div", "notice", rng.choice((prose(1, 2), f"{sentence()} <button>{word()}</button>", sentence())), 0, 0)
        if pick == 4:
            one = lambda: named(rng.choice(("div", "li", "article")), "comment", f"<h4>{words(1, 2)}</h4>{prose(1, 2)}", None, 0.4)
            return named(rng.choice(("section", "div", "ol")), "comment", f"<h3>{words(1, 3)}</h3>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 5))), 0, 0)
        if pick == 5:
            return named(rng.choice(("div", "ul")), "social", rng.choice((link() + " " + link(), "<li>" + link() + "</li>")), 0, 0)
        if pick == 6:
            return named("aside", "side advert notice", rng.choice((prose(1, 2), items(), sentence())), 0, 0.5)
        if pick == 7:
            label = lambda: rng.choice((f"<label>{words(1, 3)}</label><input>", f"<p>{words(1, 6)}</p><input>", f"{words(1, 4)}<input>", f"<fieldset><legend>{words(1, 3)}</legend><input>{words(1, 2)}</fieldset>"))
            return named("form", "form", "".join(label() for _ in range(rng.randint(1, 4))) + f"<button>{word()}</button>" * rng.randint(0, 1), 0, 0.6)
        return named("div", "foot head", rng.choice((words(1, 5), items(), sentence())), 0, 0)

    body = [f"<h1>{words(1, 9)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 8)):
        body.append(rng.choice((
            prose(1, 2), prose(1, 3), f"<p>{word()}.</p>", f"<p>{words(1, 4)}</p>", f"<h{(k := rng.randint(2, 4))}>{words(1, 6)}</h{k}>", f"<blockquote>{rng.choice((prose(1, 1), sentence()))}</blockquote>",
            f"<{(k := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{rng.choice((sentence(), link(), words(1, 5)))}</li>" for _ in range(rng.randint(1, 5))) + f"</{k}>",
            f"<pre>{words(3, 12)}</pre>", f"<p>{sentence()} {link()} {sentence()}</p>", f"<p>{link()}</p>", f"<div>{rng.choice((prose(1, 2), sentence()))}</div>",
            "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>",
            f"<section>{prose(1, 2)}</section>", f"<figure><figcaption>{sentence()}</figcaption></figure>", sentence(),
        )))
        if rng.random() < 0.15:
            body.append(clutter())
    if rng.random() < 0.15:
        body.insert(0, f"<header>{body.pop(0)}</header>" if body[0].startswith("<h1") else "")
    inner = "".join(body)
    if rng.random() < 0.25:
        inner = named("div", "text", inner, None, 0.3)
    article = named(*rng.choice((("article", "text"), ("article", ""), ("main", "text"), ("div", "text"), ("section", "text"), ("article", ""))), inner, 1, 0)
    before = [named("header", "head", rng.choice((words(1, 4), link() + items(), f"<h1>{words(1, 3)}</h1><p>{sentence()}</p>")), 0, 0.5)] * (rng.random() < 0.6) + [named("nav", "menu", items(), 0, 0.6)] * (rng.random() < 0.7)
    around = before + [clutter() for _ in range(rng.randint(0, 3))], [clutter() for _ in range(rng.randint(0, 3))]
    foot = [named("footer", "foot", rng.choice((f"© {sentence()}", items(), f"<p>{sentence()}</p>", f"{words(1, 3)} · {sentence()}")), 0, 0.6)] * (rng.random() < 0.85)
    page = "".join([*around[0], article, *around[1]])
    for _ in range(rng.choice((0, 0, 1, 2))):
        page = named("div", rng.choice(("", "text")), page, None, 0.5)
    whole = f"{page}{''.join(foot)}"
    if rng.random() < 0.08:  # pages made by some servers are one form
        whole = f'<form action="/{word()}" method="post"><input type="hidden">{whole}</form>'
    return f"<html><body>{whole}</body></html>"


def truth(nodes: list[Node]) -> list[int]:
    """1 for runs of main text and for what holds one."""
    out = [int(x.tag == "#run" and x.label == "1") for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] |= out[i]
    return out


class Model(NamedTuple):
    weights: list[float]
    #: Of each kind of edge, the table of (parent, child), row-major.
    pair: list[list[float]]
    names: dict[str, int]

    def apart(self) -> frozenset[str]:
        """Parts of names that speak against main text so much that inline elements of them are judged by themselves."""
        return frozenset(x for x, f in self.names.items() if self.weights[f] < AGAINST)


@cache
def trained(pages: int = 800, rounds: int = 10, seed: int = 3) -> Model:
    """Gradient ascent on the likelihood of labelled pages, whose gradient is what was seen less what is expected."""
    rng, order = random.Random(seed), np.random.default_rng(seed)
    trees = [tree(labelled_page(rng)) for _ in range(pages)]
    seen = Counter(x for nodes in trees for x in {x for node in nodes for x in node.names})
    names = {x: N_FIXED + i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= LEAST_PAGES))}
    made = [(nodes, [active(x, nodes, names) for x in nodes], truth(nodes)) for nodes in trees]
    w, pair = np.zeros(N_FIXED + len(names)), np.zeros((3, 4))
    seen_w, seen_pair = np.full(len(w), 1.0), np.full((3, 4), 1.0)
    for _ in range(rounds):
        for k in order.permutation(pages):
            nodes, feats, y = made[k]
            flat = w.tolist()
            p, edges = marginals(nodes, [sum(flat[f] * v for f, v in x) for x in feats], pair.tolist())
            gw, gp = -1e-3 * w, -1e-3 * pair
            for i, x in enumerate(feats):
                for f, v in x:
                    gw[f] += (y[i] - p[i]) * v
                if i:
                    j = kind(nodes[nodes[i].parent])
                    gp[j] -= edges[i]
                    gp[j, 2 * y[nodes[i].parent] + y[i]] += 1
            seen_w += gw * gw
            seen_pair += gp * gp
            w += 0.4 * gw / np.sqrt(seen_w)
            pair += 0.4 * gp / np.sqrt(seen_pair)
    return Model(w.tolist(), [*pair.tolist(), [0.0] * 4], names)


def main_text(page: str | None, model: Model, apart: frozenset[str] | None = None) -> str:
    """apart: model.apart(), if it is at hand."""
    nodes = tree(page or "", model.apart() if apart is None else apart)
    if len(nodes) == 1:
        return ""
    w = model.weights
    p, _ = marginals(nodes, [sum(w[f] * v for f, v in active(x, nodes, model.names)) for x in nodes], model.pair)
    blocks: dict[int, list[str]] = {}
    for x, y in zip(nodes, p, strict=True):
        if x.tag == "#run" and y > 0.5:
            blocks.setdefault(x.block, []).append(x.text)
    found = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n\n".join(t for t in found if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model, apart = pages.sparkSession.sparkContext.broadcast(trained()), trained().apart()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h, model.value, apart) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_slices(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long", "html")


def op2_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
