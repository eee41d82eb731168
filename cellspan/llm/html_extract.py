"""Main-text extraction by a tree-structured graphical model over DOM blocks.

Every block element is a binary variable (content or not).  Unary potentials come from its tag, the words of its
class and id, and the amount, link density and punctuation of its own text and of all text under it; pairwise
potentials, for each kind of parent and child, tie each block to its parent.  Sum-product messages go up from the
leaves and down from the root and give each block's marginal; blocks with a marginal over one half are content.  Both
are trained on labelled pages (labelled_pages() below): a logistic regression of the features, and counts of pairs.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea select option button svg math iframe object head title canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|template)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|[^<]++|<",
    re.DOTALL | re.IGNORECASE,
)
NAMES = re.compile(r"\b(class|id|role|type)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A block element: its own runs of text, in page order."""

    tag: str
    parent: int
    words: tuple[str, ...] = ()
    runs: list = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    stops: int = 0
    all_chars: int = 0
    all_linked: int = 0
    label: bool | None = None


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks (a parent before its children) and (block, text) runs in page order."""
    blocks = [Block("root", -1)]
    order: list[tuple[int, list[str]]] = []
    stack: list[tuple[str, int]] = [("root", 0)]  # open elements with their block
    links = silent = 0
    current = -1

    def close(tag: str, scope: tuple[str, ...] = ()) -> None:
        nonlocal links, silent, current
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                for t, _ in stack[k:]:
                    links -= t == "a"
                    silent -= t in SILENT
                    if t not in INLINE:
                        current = -1
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    for m in TOKEN.finditer(page):
        s = m[0]
        if s[0] != "<" or s == "<":
            if silent:
                continue
            block = stack[-1][1]
            if current != block:
                order.append((block, []))
                current = block
            text = html.unescape(s) if "&" in s else s
            order[-1][1].append(text)
            n = len(text) - text.count(" ")
            blocks[block].chars += n
            blocks[block].linked += n * (links > 0)
            blocks[block].stops += text.count(". ") + text.count(", ") + s.rstrip().endswith((".", "!", "?"))
            continue
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        end, attrs = (m[2], m[4]) if m[3] else (m[5], m[7])
        if end:
            close(tag)
            continue
        if tag in CLOSES_P:
            close("p", ("td", "th", "div", "article", "section", "li", "body", "blockquote", "main", "aside"))
        for t in SELF_CLOSING.get(tag, ()):
            close(t, SCOPE[tag])
        if tag == "br":
            if current >= 0:
                order[-1][1].append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                current = -1
            continue
        hidden = bool(attrs) and HIDDEN.search(attrs) is not None
        if tag in INLINE and not hidden:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
            continue
        words = tuple(w for _, v in NAMES.findall(attrs) for w in WORD.findall(v.lower())) if attrs else ()
        b = Block(tag, stack[-1][1], (*words, "hidden") if hidden else words)
        if attrs and "data-content" in attrs:
            b.label = "data-content=1" in attrs
        blocks.append(b)
        current = -1
        silent += tag in SILENT
        stack.append((tag, len(blocks) - 1))
    for i in range(len(blocks) - 1, -1, -1):  # children come after their parents
        b = blocks[i]
        b.all_chars += b.chars
        b.all_linked += b.linked
        if i:
            blocks[b.parent].all_chars += b.all_chars
            blocks[b.parent].all_linked += b.all_linked
    return blocks, [(b, " ".join("".join(t).split())) for b, t in order]


def _size(n: int) -> int:
    return 0 if not n else 1 if n < 25 else 2 if n < 100 else 3 if n < 400 else 4


def _links(linked: int, chars: int) -> int:
    share = linked / chars if chars else 0
    return 0 if share < 0.2 else 1 if share < 0.6 else 2


KINDS = ("top", "text", "box")
#: How much rarer pages without content are than the blocks alone would say.
RARE = 0.05
TOP, TEXT = frozenset("root html body".split()), frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table tbody thead tr td th".split())


def kind(tag: str) -> str:
    return "top" if tag in TOP else "text" if tag in TEXT else "box"


def features(b: Block) -> list[str]:
    """What the unary potential of a block reads."""
    own, under = f"{_size(b.chars)} {_links(b.linked, b.chars)}", f"{_size(b.all_chars)} {_links(b.all_linked, b.all_chars)}"
    return [
        f"tag {b.tag}", f"own {own}", f"stops {min(b.stops, 3)}", f"under {under}", f"tag {b.tag} own {own}", f"tag {b.tag} under {under}",
        *(f"name {w}" for w in set(b.words)),
    ]


@dataclass(frozen=True)
class TreeModel:
    """Potentials: log-odds of features, and by kinds of parent and child the probability of a child's state given its parent's (not content, content)."""

    unary: dict
    bias: float
    pairs: dict

    def marginals(self, blocks: list[Block]) -> list[float]:
        """P(content) of each block by sum-product, messages normalised; pages without any content count RARE times as likely as the tree says."""
        n = len(blocks)
        one = [0.0] * n
        for i, b in enumerate(blocks):
            z = self.bias + sum(self.unary.get(f, 0.0) for f in features(b))
            one[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        kinds = [kind(b.tag) for b in blocks]
        pair = [self.pairs[kinds[b.parent], k] for b, k in zip(blocks, kinds, strict=True)]
        up = [(1 - one[i], one[i]) for i in range(n)]
        # Siblings of one tag are no independent witnesses: n of them count as the square root of n.
        alike = Counter((b.parent, b.tag) for b in blocks)
        message = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            a, b = up[i]
            (p00, p01), (p10, p11) = pair[i]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            if (same := alike[blocks[i].parent, blocks[i].tag]) > 1:
                m0, m1 = m0 ** same**-0.5, m1 ** same**-0.5
            s = m0 + m1
            message[i] = m0, m1 = m0 / s, m1 / s
            x, y = up[blocks[i].parent]
            x, y = x * m0, y * m1
            up[blocks[i].parent] = (x / (x + y), y / (x + y))
        # The probability that no block is content, as a chain of conditional ones: each block's, given its parent is none.
        none = 1 - 0.1 * up[0][1] / (0.9 * up[0][0] + 0.1 * up[0][1])
        for i in range(1, n):
            (p00, p01), _ = pair[i]
            none *= p00 * up[i][0] / (p00 * up[i][0] + p01 * up[i][1])
        some = (1 - none) / (1 - none + RARE * none) / max(1 - none, 1e-12)
        out, down = [0.0] * n, [(0.9, 0.1)] * n
        for i in range(n):
            if i:
                p = blocks[i].parent
                (p00, p01), (p10, p11) = pair[i]
                a, b = up[p][0] * down[p][0] / message[i][0], up[p][1] * down[p][1] / message[i][1]
                d0, d1 = a * p00 + b * p10, a * p01 + b * p11
                down[i] = (d0 / (d0 + d1), d1 / (d0 + d1))
            a, b = up[i][0] * down[i][0], up[i][1] * down[i][1]
            out[i] = min(1.0, b / (a + b) * some)
        return out


def fit(pages: list[str], ridge: float = 1.0, rounds: int = 12) -> TreeModel:
    """Potentials from labelled pages: blocks with data-content=1 and what is in them are content, data-content=0 switches it off.

    The unary part is a logistic regression of a block's label on its features (Newton steps), less the labels' own
    log-odds, as these come from the pairs.  Pairs of a kind are counted on top of some of all pairs.
    """
    names: dict[str, int] = {}
    rows: list[list[int]] = []
    labels: list[bool] = []
    pair: Counter = Counter()
    for page in pages:
        blocks, _ = parse(page)
        for i, b in enumerate(blocks):
            if b.label is None:
                b.label = bool(i and blocks[b.parent].label)
            if i:
                above = blocks[b.parent]
                pair[kind(above.tag), kind(b.tag), above.label, b.label] += 1
                pair["", "", above.label, b.label] += 1
            rows.append([names.setdefault(f, len(names)) for f in features(b)])
            labels.append(b.label)
    x, y = np.zeros((len(rows), len(names) + 1)), np.array(labels, float)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * len(names) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
    prior = y.mean()

    def row(a: str, b: str, s: bool) -> tuple[float, float]:
        base = pair["", "", s, True] / (pair["", "", s, False] + pair["", "", s, True])
        one = (pair[a, b, s, True] + 5 * base) / (pair[a, b, s, False] + pair[a, b, s, True] + 5)
        return 1 - one, one

    pairs = {(a, b): (row(a, b, False), row(a, b, True)) for a in KINDS for b in KINDS}
    return TreeModel({f: float(w[k]) for f, k in names.items()}, float(w[-1] - math.log(prior / (1 - prior))), pairs)


# Marks that filled() puts text for: paragraphs of one to many sentences, a short sentence or two, a heading, a link's words.
_LONG, _MORE, _SHORT, _HEAD, _LINK = "@long", "@more", "@short", "@head", "@link"
_WORDS = "the of and to in a was river winter boat station they had been gone when it for hut three year later people town water old back".split()


def filled(page: str, rng: random.Random) -> str:
    """The page with text of random length for the marks; sentences are longer on some pages than on others."""
    scale = rng.choice((0.5, 1, 1, 2, 4))

    def words(low: int, high: int) -> str:
        return " ".join(rng.choices(_WORDS, k=rng.randint(low, high))).capitalize()

    def sentences(n: int) -> str:
        return " ".join(words(4, 14).replace(" ", ", ", rng.randint(0, 1)) + rng.choice("....!?") for _ in range(n))

    def text(m: re.Match) -> str:
        if m[0] in (_HEAD, _LINK):
            return words(1, 9) + rng.choice(("", "", "."))
        return sentences(rng.randint(1, 2) if m[0] == _SHORT else rng.randint(1, max(1, int(scale * (6 if m[0] == _LONG else 9)))))

    return re.sub("@(long|more|short|head|link)", text, page)


# What a page can hold beside its article.
MENUS = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li></ul></nav>',
    '<div class="menu top"><a href="/">Start</a> <a href="/x">Archive</a> <a href="/y">Sport</a></div>',
    '<header class="site header"><div class="logo">The Daily</div><ul class="nav"><li><a href="/a">Sport</a></li></ul></header>',
    '<div id="navigation" role="navigation"><ol class="breadcrumb"><li><a href="/">Home</a></li><li>Science</li></ol></div>',
    '<header><h1><a href="/">The Daily</a></h1><p>News since 1902</p></header>',
    '<ul class="tabs"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul>',
    '<div class="toolbar"><span><a href="/login">Log in</a></span> <span><a href="/join">Join</a></span></div>',
    '<table class="navbar"><tr><td><a href="/">Home</a></td><td><a href="/f">Forum</a></td></tr></table>',
    '<div><a href="/">Home</a> | <a href="/news">News</a> | <a href="/about">About us</a></div>',
]
NOISE = [
    f'<div class="ad">{_SHORT} Buy it now.</div>', f'<div class="advert banner sponsored"><p>{_LONG}</p></div>', f'<div class="promo box"><h3>Offer</h3><p>{_SHORT}</p></div>',
    '<div class="cookie notice consent"><p>We use cookies to improve this site.</p><button>Accept</button></div>', f'<div id="gdpr" class="overlay modal"><p>{_LONG}</p></div>',
    f'<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">{_SHORT}</a></li></ul><p>{_SHORT}</p></aside>', f'<aside><p>Read also: <a href="/r">{_HEAD}</a></p></aside>', f"<aside><h4>{_HEAD}</h4><p>{_LONG}</p></aside>",
    '<form class="search form"><label>Search</label><input type="text"></form>', '<form action="/s"><p>Write to us.</p><textarea></textarea></form>',
    f'<div class="popup newsletter subscribe"><p>Sign up for our letter. {_LONG}</p></div>', '<div class="share social"><a href="/s">Share</a> <a href="/t">Post</a></div>',
    f'<div role="alert" class="alert warning banner"><p>{_SHORT}</p></div>', f'<div class="related more recommended"><ul><li><a href="/1">{_HEAD}</a></li><li><a href="/2">{_SHORT}</a></li></ul></div>',
    f'<div id="rail" class="widget"><h3>Most read</h3><ol><li><a href="/1">{_HEAD}</a></li><li><a href="/2">{_LONG}</a></li></ol></div>', f'<div style="display:none"><p>{_LONG}</p></div>',
    f'<div class="teaser"><a href="/t">{_LONG}</a></div>', f'<section class="newsletter signup"><p>{_SHORT} {_SHORT}</p></section>', '<div class="tags"><a href="/x">river</a> <a href="/y">winter</a></div>',
]
COMMENTS = [
    f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{_LONG}</p></div></section>', f'<div id="comments" class="comment replies"><ul><li class="comment"><p>{_SHORT}</p></li></ul></div>',
    f'<section class="reader comments"><h2>Readers say</h2><p>{_LONG}</p><p>{_SHORT}</p></section>', f'<div class="comment-list"><article class="comment"><p>{_LONG}</p><footer>Anna</footer></article></div>',
    f'<ol class="responses discussion"><li><p>{_MORE}</p></li><li><p>{_SHORT}</p></li></ol>', f'<div id="disqus_thread"><div class="reply">{_LONG}</div></div>', f'<div class="feedback user-comments"><blockquote>{_LONG}</blockquote></div>',
]
ENDS = [
    "<footer>&copy; The Daily &middot; All rights reserved.</footer>", '<div class="footer" role="contentinfo"><p>Imprint and contact.</p></div>', '<footer class="site"><ul><li><a href="/i">Imprint</a></li></ul><p>Since 1902.</p></footer>',
    f'<div id="foot"><p>{_SHORT}</p><a href="/c">Contact</a></div>', '<div class="copyright legal">Copyright 2020 The Daily. All rights reserved.</div>', "<footer><p>All rights reserved. No part of this page may be copied.</p></footer>",
]
# What an article can hold.
PARTS = [
    f"<p>{_LONG}</p>", f"<p>{_MORE} {_LONG}</p>", f"<p>{_SHORT}</p>", f"<p><b>{_SHORT}</b><br>{_LONG}", f"<h2>{_HEAD}</h2><p>{_MORE}</p>", f"<h3>{_SHORT}</h3><p>{_LONG}</p><p>{_MORE}</p>", f"<h3>{_HEAD}</h3><p>{_MORE}</p>", f"<h4>{_HEAD}</h4><p>{_LONG}</p>", f"<div><h3>{_HEAD}</h3><p>{_LONG}</p></div>",
    f"<ul><li>{_SHORT}</li><li>{_LONG}</li></ul>", f"<ol><li>{_HEAD}</li><li>{_SHORT}</li><li>{_HEAD}</li></ol>", f"<blockquote><p>{_LONG}</p></blockquote>", f"<blockquote>{_SHORT}</blockquote><p>{_MORE}</p>", f"<pre>{_LONG}</pre>",
    f"<table><tr><th>{_HEAD}</th><td>{_SHORT}</td></tr><tr><td>12</td><td>{_HEAD}</td></tr></table>", f"<figure><img src=x><figcaption>{_SHORT}</figcaption></figure>", f"<dl><dt>{_HEAD}</dt><dd>{_LONG}</dd></dl>",
    f"<div>{_LONG}</div>", f"<div>{_MORE}<div>{_LONG}</div></div>", f"<div><p>{_LONG}</p><p>{_SHORT}</p></div>", f"{_LONG}<br><br>{_MORE}", f'<p>{_SHORT} <a href="/l">{_HEAD}</a>, {_LONG}</p>', f"<section><h2>{_HEAD}</h2><p>{_LONG}</p></section>",
    f'<h2>{_HEAD}</h2><ul><li><a href="/1">{_LINK}</a></li><li><a href="/2">{_HEAD}</a></li></ul>', f'<ul><li><a href="/1">{_LONG}</a></li><li><a href="/2">{_LINK}</a></li><li><a href="/3">{_HEAD}</a></li></ul>', f'<p><a href="/s">{_HEAD}</a></p>', f"<p>{_SHORT}</p>" * 9, f"<p>{_HEAD}</p>" * 5,
]
HEADS = ["<h1>{}</h1>", "<header><h1>{}</h1><p>By Anna Berg</p></header>", "<h2>{}</h2>", "", "<div class=title>{}</div>", "<h1>{}</h1><h2>And what it took</h2>"]
SHELLS = [
    "<article data-content=1>{}</article>", "<article data-content=1>{}</article>", '<article class="story" data-content=1>{}</article>', "<main><article data-content=1>{}</article></main>", '<main data-content=1><article class="post">{}</article></main>', '<div id="content" data-content=1><div class="article entry">{}</div></div>',
    '<main id="main" role="main" data-content=1>{}</main>', '<div class="page" data-content=1>{}</div>', "<section data-content=1><div>{}</div></section>", "<div data-content=1>{}</div>", "<div><div data-content=1>{}</div></div>",
    '<table><tr><td data-content=1>{}</td></tr></table>', '<div class="wrapper"><div class="col" data-content=1>{}</div></div>', '<div itemprop="articleBody" class="story body text" data-content=1>{}</div>', "{}", "{}", "{}",
    "<article data-content=1><div>{}</div></article>", '<article data-content=1><div class="inner"><div>{}</div></div></article>', '<section data-content=1><div class="text">{}</div></section>', "<main data-content=1><section><div>{}</div></section></main>",
    '<div class="post" data-content=1><div class="entry"><div>{}</div></div></div>',
]


def off(fragment: str, label: int = 0) -> str:
    """The fragment as no content; as content with label 1."""
    return re.sub(r"^<(\w+)", rf"<\1 data-content={label}", fragment)


def labelled_pages(n: int = 800, seed: int = 5) -> list[str]:
    """Pages with labels, put together from the lists above; label attributes are not features."""
    rng, pages = random.Random(seed), []
    for i in range(n):
        parts = [rng.choice(PARTS) for _ in range(rng.randint(2, 9))]
        for _ in range(rng.choice((0, 0, 1, 2))):
            parts.insert(rng.randint(1, len(parts)), off(rng.choice(NOISE)))
        if rng.random() < 0.2:
            parts.append(off(rng.choice(COMMENTS)))
        shell = SHELLS[i % len(SHELLS)]
        body = shell.format(rng.choice(HEADS).format(_HEAD) + "".join(parts))
        before = [off(x) for x in (*rng.sample(MENUS, rng.randint(0, 2)), *rng.sample(NOISE, rng.randint(0, 2)))]
        after = [off(x) for x in (*rng.sample(NOISE, rng.randint(0, 3)), *rng.sample(COMMENTS, rng.randint(0, 1)), *rng.sample(ENDS, rng.randint(0, 1)))]
        whole = "".join((*before, body, *after))
        if shell == "{}":
            whole = f"<body data-content=1>{whole}</body>"
        else:
            whole = f"<body>{rng.choice(('{}', '<div>{}</div>', '<div id=page class=container>{}</div>')).format(whole)}</body>"
        if i % 12 == 5:  # a bare fragment
            parts = [off(rng.choice(PARTS[:3]), 1) for _ in range(rng.randint(1, 4))]
            pages.append(filled("".join((*before[:1], *parts, *after[:1])), rng))
        pages.append(filled(f"<!DOCTYPE html><html><head><title>x</title></head>{whole}</html>", rng))
    return pages


@lru_cache(None)
def model() -> TreeModel:
    return fit(labelled_pages())


def main_text(page: str, m: TreeModel) -> str:
    """The text of the content blocks in page order, joined by empty lines."""
    blocks, runs = parse(page)
    p = m.marginals(blocks)
    return "\n\n".join(t for b, t in runs if t and p[b] > 0.5)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text; pages of any length are read whole.  Repeated rows and null ids
    or urls keep rows of their own; extra columns are ignored; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    m = model()  # some hundred numbers

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([main_text(x, m) if x else "" for x in p], dtype=object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
