"""Main text of web pages by a graphical model on the DOM tree.

A page is parsed to a tree of elements. Each element has a hidden label (content or not) with a
potential from its features (tag, class and id words, amount of text and links, place), and each
parent and child have a potential for their two labels, by the kinds of the two. Sum-product
messages run from the leaves to the root and back; the product at each element is its exact
marginal. Text whose element is content with probability one half or more is the main text.

The parameters maximise the likelihood of labelled pages; the gradient is what the labels show
less what the marginals expect. Labelled pages are drawn from a grammar of page layouts
(:func:`labelled_pages`), since no table holds labels; no page of the input is used in training.

Many pages are handled at once: the trees' levels are arrays, and a message pass is one step for
each level. The model is trained once on the driver (seconds, fixed size) and broadcast; scoring
is a map over pages, without a shuffle.

Output: text by blocks (the text of an element between its block-level children), white space
inside a block as one space, trimmed, empty blocks left out, joined by a blank line in page
order; character references decoded. Scripts, styles and other elements that never hold text for
readers are left out before; a head ends where an element begins that can't stand in it, and others that
lack an end tag where an enclosing element ends or a block begins. Null and empty html gives an empty
text. Unclosed and stray tags are accepted, and nesting of any depth. Declarations and marked sections, known or not, are
no text: they end at the next ``>`` (a document type with a subset of its own at ``]>``, CDATA at ``]]>``), or at the page's end. Formulas (math) are text.
Inline elements with a class, id or role are elements of the tree with a label of their own (an advert inside a paragraph goes, the paragraph
stays); the text of others is their parent's.
Repeated rows stay repeated; an empty table gives no rows; other columns of pages play no part.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import ship

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style template noscript head iframe object svg canvas select textarea button option datalist audio video title".split())
#: Elements that may stand in a head; any other ends it.
IN_HEAD = set("html head base basefont bgsound link meta title style script template noscript noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes open elements of the value, up to the nearest of the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Block elements that may stand in a paragraph's place close an open one.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "figcaption", "summary", "dd", "dt", "li"} | {"li", "dd", "dt"}
P_SCOPE = {"td", "th", "table", "caption", "button", "object", "body", "html"}
#: End tags of inline elements do not reach beyond these.
CELLS = ("td", "th", "table")

TAGS = "html body main article section div p span a h1 h2 h3 h4 h5 h6 ul ol li nav header footer aside form table tr td blockquote pre figure figcaption dl dt dd label fieldset details summary address other".split()
TAG = {t: i for i, t in enumerate(TAGS)}
NAMES = 1024  # hashed words of class, id and role, of the element and of its parent
NUMBERS = 10
FEATURES = len(TAGS) + NAMES + NUMBERS + 1
#: Kinds of children (inline elements are one) that have potentials of their own with their parent.
INLINE = 4
KINDS = {"p": 1, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "blockquote": 1, "pre": 1, "li": 2, "ul": 2, "ol": 2, "td": 2, "tr": 2, "table": 2, "div": 3, "section": 3, "article": 3, "main": 3}
#: And kinds of parents.
OVER = {"article": 1, "main": 1, "nav": 2, "header": 2, "footer": 2, "aside": 2, "form": 2, "ul": 3, "ol": 3, "table": 3, "tr": 3, "dl": 3}
N_KINDS = 20
SEED, PAGES, ROUNDS = 5, 700, 200


#: What the parser does not read as markup: comments, and scripts and styles up to their end tags.
UNREAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(</\1|\Z)", re.S)
COMMENT_END = re.compile("--!?>")
DECLARATION = re.compile(r"<!\[cdata\[.*?\]\]>|<!doctype[^\[>]*\[(?:[^\]<]|<![^>]*>)*\]\s*>|<![^>]*>", re.S | re.I)


def names_of(attrs: dict[str, str | None]) -> tuple[str, ...]:
    """The words of class, id and role, and whether the element is hidden."""
    names = " ".join(filter(None, (attrs.get("class"), attrs.get("id"), attrs.get("role"))))
    hidden = "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "")
    return (*re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()), *["hidden"] * hidden)


class Dom(HTMLParser):
    """Elements of a page with their own text, in blocks. Inline elements without names belong to the element around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.links, self.own = [-1], ["html"], [()], [0], [0]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []  # (block element, pieces of text with their elements) in page order
        self.open: list[tuple[str, int, int]] = [("html", 0, 0)]  # (tag, element that text in it belongs to, block element)
        self.at: dict[str, list[int]] = {"html": [0]}  # tag -> its places in open
        self.dropped: list[str] = []  # a dropped element and those open in it
        self.inside: Counter[str] = Counter()  # how many of each tag these are
        self.ends: dict[str, int] = {}  # end tags of dropped elements that are still to come
        self.in_link = 0
        self.commented = True  # ends of comments may still come
        self.fresh = True  # the next text begins a block

    def feed(self, data):
        shown = UNREAD.sub(lambda m: m[2] or "", data.lower())
        self.ends = {t: n for t, n in Counter(re.findall(r"</([a-z]+)", shown)).items() if t in DROPPED}
        super().feed(data)

    def parse_comment(self, i, report=True):
        """Where a comment ends; one without an end goes to the next ``>``."""
        end = COMMENT_END.search(self.rawdata, i + 2) if self.commented else None
        self.commented = end is not None
        return end.end() if end else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i):
        """Where a declaration or marked section ends; what it holds is no text."""
        end = DECLARATION.match(self.rawdata, i)
        return end.end() if end else len(self.rawdata)

    def handle_starttag(self, tag, attrs):
        if self.dropped and self._ends_dropped(tag):
            self._undrop(0)
        if self.dropped:
            if tag == "button" and self.inside[tag]:
                self._undrop(self.dropped.index(tag))
            if tag not in VOID and tag not in ("html", "head", "basefont", "bgsound"):
                self._drop(tag)
            return
        if tag in DROPPED:
            self._drop(tag)
            return
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and tag != "wbr":
                self.handle_data(" ")
            self.fresh |= tag == "hr"
            return
        if tag in ("html", "body") and self.at.get(tag):
            return
        if tag in ENDS_P:
            self._close({"p"}, P_SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self.at.setdefault(tag, []).append(len(self.open))
        names, block = names_of(dict(attrs)), tag in BLOCK
        self.in_link += tag == "a"
        at, own_block = self.open[-1][1:]
        if block or names:
            self.parent.append(at)
            self.tag.append(tag)
            self.names.append(names)
            self.links.append(0)
            self.own.append(0)
            at = len(self.tag) - 1
        self.open.append((tag, at, at if block else own_block))
        self.fresh |= block

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _drop(self, tag: str) -> None:
        self.dropped.append(tag)
        self.inside[tag] += 1

    def _undrop(self, i: int) -> None:
        for t in self.dropped[i:]:
            self.inside[t] -= 1
        del self.dropped[i:]

    def _ends_dropped(self, tag: str) -> bool:
        if tag == "body":
            return not self.at.get("body")
        if self.dropped == ["head"]:
            return tag not in IN_HEAD
        return tag in BLOCK and self.dropped[0] != "head" and not self.ends.get(self.dropped[0])

    def handle_endtag(self, tag):
        if tag in self.ends:
            self.ends[tag] -= 1
        if self.dropped:
            if self.inside[tag]:
                self._undrop(next(i for i in range(len(self.dropped) - 1, -1, -1) if self.dropped[i] == tag))
                return
            if tag == "html" or not self.at.get(tag):
                return
            self._undrop(0)
        if tag in ("html", "body") or not self.at.get(tag):
            return
        last = self.at[tag][-1]
        if tag in BLOCK or all(not self.at.get(t) or self.at[t][-1] < last for t in CELLS):
            self._pop(last)

    def _close(self, tags: set, scope: set) -> None:
        """Pops from the first of the tags that is open inside the innermost of the scope."""
        edge = max((self.at[t][-1] for t in scope if self.at.get(t)), default=0)
        inner = [places[bisect_right(places, edge)] for t in tags if (places := self.at.get(t)) and places[-1] > edge]
        if inner:
            self._pop(min(inner))

    def _pop(self, i: int) -> None:
        for t, *_ in self.open[i:]:
            self.at[t].pop()
            self.in_link -= t == "a"
            self.fresh |= t in BLOCK
        del self.open[i:]

    def handle_data(self, data):
        if self.dropped:
            return
        _, at, block = self.open[-1]
        if self.fresh or not self.blocks or self.blocks[-1][0] != block:
            if not data.strip():
                return
            self.blocks.append((block, []))
            self.fresh = False
        self.blocks[-1][1].append((at, data))
        n = len(data)
        self.own[at] += n
        if self.in_link > 0:
            self.links[at] += n

    def texts(self, content) -> list[str]:
        """The text of each block in elements for which ``content`` is true."""
        joined = (" ".join("".join(piece for at, piece in pieces if content[at]).split()) for _, pieces in self.blocks)
        return [t for t in joined if t]


def parse(html: str | None) -> Dom:
    dom = Dom()
    dom.feed(html or "")
    dom.close()
    return dom


class Forest:
    """Trees of several pages as arrays, with the features of their elements."""

    def __init__(self, doms: list[Dom]):
        shift, parents, rows, columns, values, kinds, depth = 0, [], [], [], [], [], []
        for dom in doms:
            n = len(dom.tag)
            par = dom.parent
            size, link = list(dom.own), list(dom.links)
            children = [0] * n
            for i in range(n - 1, 0, -1):
                size[par[i]] += size[i]
                link[par[i]] += link[i]
                children[par[i]] += 1
            total = max(1, size[0])
            deep = [0] * n
            for i in range(n):
                if i:
                    deep[i] = deep[par[i]] + 1
                own, all_ = dom.own[i], size[i]
                density = link[i] / max(1, all_)
                numbers = (
                    own == 0, 0 < own < 40, 40 <= own < 150, own >= 150, all_ >= 400, all_ / total > 0.4,
                    density > 0.8, 0.3 < density <= 0.8, density <= 0.3 and all_ > 0, children[i] > 5,
                )
                tag = dom.tag[i]
                feature = {TAG.get(tag, TAG["other"])} | {len(TAGS) + crc32(w.encode()) % NAMES for w in dom.names[i]}
                if i:  # and of the parent's names, apart
                    feature |= {len(TAGS) + crc32(b"^" + w.encode()) % NAMES for w in dom.names[par[i]]}
                feature |= {len(TAGS) + NAMES + k for k, on in enumerate(numbers) if on} | {FEATURES - 1}
                rows.extend([shift + i] * len(feature))
                columns.extend(feature)
                kinds.append((KINDS.get(tag, 0) if tag in BLOCK else INLINE) * 4 + OVER.get(dom.tag[par[i]] if i else "", 0))
                parents.append(par[i] + shift if i else -1)
            depth.extend(deep)
            shift += n
        self.n = shift
        self.parent, self.kind, self.depth = np.array(parents), np.array(kinds), np.array(depth)
        self.rows, self.columns = np.array(rows), np.array(columns)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))[1:]

    def unary(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weight[self.columns], self.n)


def marginals(forest: Forest, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(content) of every element, P(parent label, own label) of every element but roots), by sum-product messages.

    weight: log odds of content by feature. pair: (kinds, 2, 2), log potentials by parent's and own label.
    """
    score = np.zeros((forest.n, 2))
    score[:, 1] = forest.unary(weight)
    up = score.copy()  # log: own potential and all messages from below
    message = np.zeros((forest.n, 2))  # from an element to its parent
    for level in reversed(forest.levels):
        both = up[level][:, None, :] + pair[forest.kind[level]]
        message[level] = np.logaddexp(both[..., 0], both[..., 1])
        np.add.at(up, forest.parent[level], message[level])
    belief = up.copy()
    joint = np.zeros((forest.n, 2, 2))
    for level in forest.levels:
        above = belief[forest.parent[level]] - message[level]  # the parent without what this element told it
        both = above[:, :, None] + pair[forest.kind[level]]
        belief[level] = up[level] + np.logaddexp(both[:, 0], both[:, 1])
        joint[level] = both + up[level][:, None, :]
    p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    joint -= joint.max(axis=(1, 2), keepdims=True)
    joint = np.exp(joint)
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return p, joint


def train(forest: Forest, label: np.ndarray, rounds: int = ROUNDS, rate: float = 0.15, decay: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials of greatest likelihood, by gradient ascent (Adam)."""
    weight, pair = np.zeros(FEATURES), np.zeros((N_KINDS, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    shown = np.zeros_like(pair)
    np.add.at(shown, (forest.kind[child], label[forest.parent[child]], label[child]), 1)
    m, v = np.zeros(FEATURES + pair.size), np.zeros(FEATURES + pair.size)
    for k in range(1, rounds + 1):
        p, joint = marginals(forest, weight, pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.kind[child], joint[child])
        g = np.concatenate([np.bincount(forest.columns, (label - p)[forest.rows], FEATURES), (shown - expected).ravel()]) / forest.n
        g -= decay * np.concatenate([weight, pair.ravel()])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        weight = weight + step[:FEATURES]
        pair = pair + step[FEATURES:].reshape(pair.shape)
    return weight, pair


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages of many layouts; content elements carry the attribute data-label="1" on each element that holds main text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    some = lambda p, x: x if r.random() < p else ""

    def named(*names: str, also: float = 0.85) -> str:
        name = r.choice(names)
        name = r.choice([name, name, f"{name}-{word()}", f"{word()}-{name}", f"{name} {word()}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"' if r.random() < also else ""

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/{word()}">{words(a, b)}</a>'

    def inline(a: int, b: int, label: str = "") -> str:
        """Words with inline elements; in a dense one about half of the words are links."""
        dense, parts = r.random() < 0.12, [words(a, b)]
        for _ in range(r.choice([0, 0, 1, 2]) if not dense else r.randint(2, 12)):
            t = r.choice(["b", "i", "em", "strong", "span", "code"])
            plain = f' {r.choice(["class", "id"])}="{r.choice([word(), word(), "highlight", "ref", "external", "name", "term"])}"{label}'
            parts += [r.choice([f"<{t}>{words(1, 4)}</{t}>", link(), "<br>", f"<b>{words(2, 5)}", f"<{t}{plain}>{words(1, 6)}</{t}>", f"<a href=x{plain}>{words(1, 4)}</a>"]), words(1, 20)] if not dense else [link(1, 6), words(1, 5)]
            if label and r.random() < 0.06:
                parts.append(f"<span{named('ad', 'ads', 'advert', 'sponsored', 'promo', 'notice', 'newsletter', 'share', also=1)}>{words(1, 9)}</span>")
        return " ".join(parts) + "."

    def links() -> str:
        items = [link() for _ in range(r.randint(2, 9))]
        return r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), f"<ol>{''.join(f'<li>{x}' for x in items)}</ol>"])

    def menu() -> str:
        tag = r.choice(["nav", "nav", "div", "ul"])
        inner = links() if tag != "ul" else "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
        return f"<{tag}{named('nav', 'menu', 'navigation', 'navbar', 'breadcrumb', 'breadcrumbs', 'topbar', 'toolbar', also=0.3 if tag == 'nav' else 1)}>{inner}</{tag}>"

    def head() -> str:
        tag = r.choice(["header", "header", "div"])
        return f"<{tag}{named('header', 'masthead', 'top', 'branding', 'logo', also=0.5 if tag == 'header' else 1)}>{some(0.7, f'<h1>{words(1, 4)}</h1>')}{some(0.5, f'<p>{words(2, 9)}</p>')}{some(0.5, menu())}</{tag}>"

    def foot() -> str:
        tag = r.choice(["footer", "footer", "div"])
        body = r.choice([f"&copy; {words(2, 14)}", f"<p>&copy; {words(2, 20)}</p>", f"{words(4, 25)} &middot; {words(3, 14)}.", f"{links()}<p>{words(3, 20)}</p>"])
        return f"<{tag}{named('footer', 'copyright', 'bottom', 'colophon', 'legal', also=0.4 if tag == 'footer' else 1)}>{body}</{tag}>"

    def advert() -> str:
        tag = r.choice(["div", "div", "aside", "section", "p"])
        body = r.choice([inline(2, 25), f"<p>{inline(2, 25)}</p>", link(2, 8), f"<h4>{words(1, 3)}</h4><p>{inline(3, 20)}</p>"]) if tag != "p" else inline(2, 20)
        return f"<{tag}{named('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'sponsor', 'promo', 'promoted', 'adsense')}>{body}</{tag}>"

    def notice() -> str:
        tag = r.choice(["div", "div", "section", "p", "aside"])
        body = r.choice([inline(5, 30), f"<p>{inline(5, 30)}</p><button>{words(1, 2)}</button>", f"<p>{inline(4, 22)}</p>"]) if tag != "p" else inline(4, 25)
        return f"<{tag}{named('cookie', 'cookies', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'modal', 'overlay', 'message', 'warning', 'disclaimer', 'privacy', 'paywall', 'banner')}>{body}</{tag}>"

    def form() -> str:
        fields = "".join(f"<label>{words(1, 3)} <input name={word()}></label>" for _ in range(r.randint(1, 3)))
        return f"<form action=/{word()}{named('search', 'form', 'login', 'newsletter', 'subscribe', 'signup', 'contact', also=0.6)}>{some(0.5, f'<p>{words(3, 14)}</p>')}{fields}<button>{word()}</button></form>"

    def side() -> str:
        tag = r.choice(["aside", "aside", "div", "section"])
        inner = "".join(r.choice([f"<h3>{words(1, 4)}</h3>{links()}", f"<p>{inline(4, 40)}</p>", links(), f"<h4>{words(1, 3)}</h4><p>{inline(5, 30)}</p>", form(), advert()]) for _ in range(r.randint(1, 3)))
        return f"<{tag}{named('sidebar', 'side', 'widget', 'rail', 'secondary', 'related', 'recommended', 'more', 'trending', 'popular', 'share', 'social', 'tags', also=0.5 if tag == 'aside' else 1)}>{inner}</{tag}>"

    def comments() -> str:
        def one() -> str:
            t = r.choice(["div", "li", "article", "p", "p"])
            return f"<{t}{named('comment', 'reply', 'response', also=0.4 if t == 'p' else 0.8)}>{some(0.5, f'<b>{word()}</b> ')}{inline(4, 60) if t == 'p' or r.random() < 0.3 else ''.join(f'<p>{inline(4, 50)}</p>' for _ in range(r.randint(1, 2)))}</{t}>"

        tag = r.choice(["section", "div", "div", "ol", "ul", "aside"])
        return f"<{tag}{named('comments', 'commentlist', 'discussion', 'responses', 'replies', 'disqus', 'reviews')}>{some(0.5, f'<h3>{words(1, 3)}</h3>')}{''.join(one() for _ in range(r.randint(1, 6)))}{some(0.3, form())}</{tag}>"

    L = ' data-label="1"'

    def glossary() -> str:
        pairs = "".join(f"<dt{L}>{words(1, 3)}{r.choice(['</dt>', ''])}<dd{L}>{inline(2, 40, L)}{r.choice(['</dd>', ''])}" for _ in range(r.randint(1, 8)))
        return f"<dl{L}>{pairs}</dl>"

    def references() -> str:
        t, cite = r.choice(["ul", "ol"]), r.choice([lambda: link(1, 8), lambda: f"{words(1, 6)} {link(1, 6)} {words(1, 4)}."])
        items = "".join(f"<li{L}>{cite()}</li>" for _ in range(r.randint(1, 9)))
        return f"{some(0.5, f'<h2{L}>{words(1, 2)}</h2>')}<{t}{L}{some(0.3, named('references', 'reflist', 'citations', 'sources', 'bibliography'))}>{items}</{t}>"

    def paragraph(plain: float, most: int) -> str:
        x, a, b = r.random() * plain, r.choice([1, 1, 3, 10, 30]), r.choice([3, 12, 40, 120, 200])
        a, b = min(a, most), min(b, most)
        if x < 0.7:
            return f"<p{L}>{inline(a, max(a, b), L)}" + r.choice(["</p>", "</p>", "</p>", ""])
        if x < 0.78:
            t = r.choice(["h2", "h3", "h4"])
            return f"<{t}{L}>{words(1, 8)}</{t}>"
        if x < 0.84:
            t = r.choice(["ul", "ol"])
            return f"<{t}{L}>{''.join(f'<li{L}>{inline(2, 18, L)}</li>' for _ in range(r.randint(2, 6)))}</{t}>"
        if x < 0.89:
            return f"<blockquote{L}>{r.choice([inline(4, 40, L), f'<p{L}>{inline(4, 40, L)}</p>'])}</blockquote>"
        if x < 0.92:
            return f"<pre{L}>{words(4, 40)}</pre>"
        if x < 0.95:
            return f"<table{L}>{''.join(f'<tr{L}><td{L}>{words(1, 4)}</td><td{L}>{words(1, 6)}</td></tr>' for _ in range(r.randint(2, 5)))}</table>"
        if x < 0.96:
            return glossary()
        if x < 0.975:
            return references()
        if x < 0.985:
            return f"<p{L}>{link(1, 8)}</p>"
        if x < 0.99:
            return f"<figure{L}><img src=x><figcaption{L}>{words(3, 14)}</figcaption></figure>"
        return f"<div{L}>{inline(8, 60, L)}</div>"

    def article() -> str:
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        parts = [some(0.75, f"<h1{L}>{words(2, 12)}</h1>"), some(0.1, f"<header{L}><h1{L}>{words(2, 10)}</h1></header>")]
        plain, most = r.choice([0.7, 0.7, 1, 1]), r.choice([4, 12, 60, 200, 200])  # only paragraphs or all kinds; how long they get
        part = r.choice([lambda: paragraph(plain, most)] * 12 + [glossary, references])
        parts += [part() for _ in range(r.choice([1, 2, 3, 5, 8, 12, 25, 40]))]
        parts += [f"<span{named('newsletter', 'notice', 'promo', 'share', also=1)}>{words(1, 12)}</span>"] * (r.random() < 0.05)
        for extra, p in ((advert, 0.25), (notice, 0.08), (side, 0.15), (form, 0.1), (comments, 0.3), (menu, 0.06)):
            if r.random() < p:
                parts.insert(r.randint(1, len(parts)) if extra is not comments else len(parts), extra())
        name = named("content", "article", "post", "entry", "story", "body", "text", "main", "page", also=0.4 if tag in ("article", "main") else 0.9)
        inner = "".join(parts)
        if r.random() < 0.2:
            inner = f"<div{L}{named('content', 'body', 'entry', 'text', also=0.7)}>{inner}</div>"
        out = f"<{tag}{L}{name}>{inner}</{tag}>"
        return f"<table{L}><tr{L}>{some(0.6, f'<td>{links()}</td>')}{out}{some(0.4, f'<td>{links()}</td>')}</tr></table>" if tag == "td" else out

    pages = []
    for _ in range(n):
        core = article()
        if r.random() < 0.3:
            core = f"<div{L}{named('container', 'wrapper', 'page', 'layout', 'row', 'site', 'main')}>{some(0.3, menu())}{core}{some(0.4, side())}</div>"
        deep = r.choice([0] * 8 + [1, 3, 10, 30])
        core = f"<div{L}>" * deep + core + "</div>" * deep
        parts = [some(0.45, head()), some(0.75, menu()), some(0.2, notice()), some(0.5, advert()), some(0.15, form()), some(0.2, side()), core]
        parts += [some(0.25, side()), some(0.3, comments()), some(0.15, advert()), some(0.1, form()), some(0.12, notice()), some(0.8, foot()), some(0.08, notice())]
        if r.random() < 0.15:  # a page without furniture
            parts = [core]
        title = f"<head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        pages.append(f"<!DOCTYPE html><html lang={word()}>{title}<body{L}>{''.join(parts)}</body></html>")
    return pages


class Labelled(Dom):
    """Keeps the labels that :func:`labelled_pages` gives."""

    def __init__(self):
        super().__init__()
        self.label = [1]

    def handle_starttag(self, tag, attrs):
        before = len(self.tag)
        super().handle_starttag(tag, attrs)
        if len(self.tag) > before:
            self.label.append(int(("data-label", "1") in attrs))


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    doms = []
    for html in labelled_pages(pages, seed):
        dom = Labelled()
        dom.feed(html)
        dom.close()
        doms.append(dom)
    return train(Forest(doms), np.concatenate([d.label for d in doms]))


def main_texts(pages: list[str | None], weight: np.ndarray, pair: np.ndarray) -> list[str]:
    doms = [parse(p) for p in pages]
    forest = Forest(doms)
    p, _ = marginals(forest, weight, pair)
    out, shift = [], 0
    for dom in doms:
        out.append("\n\n".join(dom.texts(p[shift : shift + len(dom.tag)] >= 0.5)))
        shift += len(dom.tag)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text)"""
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, pair = model.value
        for html in batches:
            rows = html.tolist()
            yield pd.Series([t for i in range(0, len(rows), 64) for t in main_texts(rows[i : i + 64], weight, pair)], dtype=object)

    return pages.select(id_col, url_col, text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
