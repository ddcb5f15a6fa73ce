"""Main text of web pages by a graphical model on the tree of the page.

Every element and every run of text is a variable with two states, content or not. A node has a
potential from what it is (tag, words in class and id, length, share of linked text, end of sentence);
every parent and child have a joint potential by the kind of child. Sum-product messages go from the
leaves up to the root and back down, which gives the exact marginal of every node. The potentials are
trained from labelled pages by gradient ascent on the likelihood, whose expectations are those same
marginals. Text runs whose marginal reaches one half are the main text.

Pages are parsed leniently, in time that grows with their length: missing end tags are implied, stray
ones ignored; an open head ends at the first element or text that cannot stand in it; elements nested
deeper than 512 become siblings. Scripts, styles,
templates, comments and the head hold no text. Character references are decoded, white space inside a
block becomes one space, blocks are joined by an empty line in page order.

Null and empty pages give an empty text; so does a page without content. Repeated rows give equal
texts. An empty table stays empty. Pages of any length are read whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import as_row, field, unpack

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style template head title noscript svg iframe object canvas textarea select".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = set(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
             "tfoot th thead tr ul").split())
ENDS_P = BLOCK - set("caption li dd dt td th tr tbody thead tfoot body html summary legend figcaption".split())
#: An opening tag ends an open element of these kinds, unless one of the kinds after the bar stands between.
ENDED_BY = {"li": ("li|ul ol menu"), "dt": "dt dd|dl", "dd": "dt dd|dl", "tr": "tr td th|table", "td": "td th|tr table",
            "th": "td th|tr table", "option": "option|select", "tbody": "tbody thead tr td th|table", "thead": "tbody tr td th|table"}
TAGS = ("#text a abbr address article aside b blockquote body button cite code dd div dl dt em fieldset figcaption figure "
        "footer form h1 h2 h3 h4 h5 h6 header html i img label li main nav ol p pre section small span strong sub sup "
        "table tbody td th tr u ul").split()
#: Groups of words in class, id and role.
HINTS = {
    "menu": "nav menu breadcrumb breadcrumbs topbar navbar tabs pagination pager toolbar skip",
    "header": "header masthead top banner-top branding logo site-title hero",
    "footer": "footer foot bottom copyright colophon legal imprint",
    "side": "sidebar side aside widget rail related recommended trending popular teaser more",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner doubleclick dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy message toast warning",
    "form": "form newsletter subscribe signup login search input contact register",
    "comment": "comment comments reply replies respond discussion disqus reader reviews thread commentlist",
    "share": "share sharing social follow like tweet facebook twitter tags meta byline author date",
    "content": "content article post entry story main body text page-content article-body post-content entry-content prose",
}
_HINT_OF = {word: group for group, text in HINTS.items() for word in text.split()}
LENGTHS, LINKS = (1, 20, 60, 160, 500), (0.01, 0.3, 0.7)

NAMES = ([f"tag {t}" for t in TAGS] + ["tag other"] + [f"hint {g}" for g in HINTS]
         + [f"length {i}" for i in range(len(LENGTHS) + 1)] + [f"linked {i}" for i in range(len(LINKS) + 1)]
         + ["sentence", "copyright", "bias"])
_NUMBER = {n: i for i, n in enumerate(NAMES)}
_TAG = {t: _NUMBER[f"tag {t}"] for t in TAGS}
KINDS = ("text", "inline", "block")
MAX_DEPTH = 512  # elements nested deeper stand beside each other at this depth, as in browsers; no text is lost
MARK = "\ue000"  # private character that marks content in labelled pages


class _Page(HTMLParser):
    """Builds the node table of one page: tag, parent, hints, text, block number of text runs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.hints, self.text, self.block = ["html"], [-1], [()], [""], [0]
        self.stack, self.silent, self.blocks, self.gap = [0], 0, 0, False
        self.open: dict[str, list[int]] = {}  # depths of the open elements of each tag, innermost last
        self.open_blocks: list[int] = []

    def _add(self, tag, hints=(), text=""):
        self.tag.append(tag)
        self.parent.append(self.stack[-1 if tag == "#text" else min(len(self.stack), MAX_DEPTH) - 1])
        self.hints.append(hints)
        self.text.append(text)
        self.block.append(self.blocks)
        return len(self.tag) - 1

    def _push(self, tag: str, node: int):
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append(node)

    def _pop_to(self, depth: int):
        while len(self.stack) > depth:
            tag = self.tag[self.stack.pop()]
            self.open[tag].pop()
            if tag in BLOCK:
                self.open_blocks.pop()
                self.blocks += 1
            if tag in SILENT:
                self.silent -= 1

    def _innermost(self, kinds) -> int:
        """Depth of the innermost open element of these kinds, 0 if none is open."""
        return max((self.open[k][-1] for k in kinds if self.open.get(k)), default=0)

    def _close(self, kinds, until):
        depth = self._innermost(kinds)
        if depth > self._innermost(until):
            self._pop_to(depth)

    def _end_head(self):
        if self.tag[self.stack[-1]] == "head":
            self._pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "head" == self.tag[self.stack[-1]]:
            return
        if tag not in IN_HEAD:
            self._end_head()
        if tag in VOID:
            if tag in ("br", "hr"):
                self.gap = True
                self.blocks += tag == "hr"
            return
        if tag in ENDS_P:
            self._close(("p",), ("table", "td", "th", "button", "body"))
        if tag in ENDED_BY:
            kinds, _, until = ENDED_BY[tag].partition("|")
            self._close(kinds.split(), until.split())
        if tag == "body":
            self._close(("head",), ())
        if tag in BLOCK:
            self.blocks += 1
        words = []
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value:
                low = value.lower()
                for word in low.split():
                    words += [word, *word.replace("_", "-").split("-")]
        hints = tuple(sorted({_HINT_OF[w] for w in words if w in _HINT_OF}))
        if tag in SILENT:
            self.silent += 1
        self._push(tag, self._add(tag, hints))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = self._innermost((tag,))
        inline = tag not in BLOCK and tag not in SILENT
        if depth and not (inline and self.open_blocks and self.open_blocks[-1] > depth):
            self._pop_to(depth)

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if self.silent:
            return
        if self.gap:
            data, self.gap = " " + data, False
        if data.strip():
            self._add("#text", (), data)
        elif self.tag[-1] == "#text" and self.block[-1] == self.blocks:
            self.text[-1] += " "


@dataclass
class Forest:
    """The nodes of several pages, parents before children; `features` are numbers into NAMES, `of` their nodes."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    of: np.ndarray
    pages: list[_Page]
    starts: list[int]


def parse(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def _features(page: _Page, base: int, features: list[int], of: list[int]) -> None:
    n = len(page.tag)
    size, linked = [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "#text":
            size[i] = len(page.text[i].strip())
            linked[i] = size[i] if in_link[i] else 0
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]
    other, bias = _NUMBER["tag other"], _NUMBER["bias"]
    length, link = _NUMBER["length 0"], _NUMBER["linked 0"]
    sentence, copyright_ = _NUMBER["sentence"], _NUMBER["copyright"]
    for i in range(n):
        own = [_TAG.get(page.tag[i], other), bias, length + sum(size[i] >= x for x in LENGTHS)]
        share = linked[i] / size[i] if size[i] else 0.0
        own.append(link + sum(share >= x for x in LINKS))
        own += [_NUMBER[f"hint {g}"] for g in page.hints[i]]
        if page.tag[i] == "#text":
            text = page.text[i].strip()
            if text[-1:] in ".!?…:;\"”»":
                own.append(sentence)
            if "©" in text or "(c)" in text:
                own.append(copyright_)
        features += own
        of += [base + i] * len(own)


def forest(pages: Sequence[_Page]) -> Forest:
    parent: list[int] = []
    depth: list[int] = []
    kind: list[int] = []
    features: list[int] = []
    of: list[int] = []
    starts: list[int] = []
    for page in pages:
        base = len(parent)
        starts.append(base)
        for i, p in enumerate(page.parent):
            parent.append(base + p if p >= 0 else -1)
            depth.append(depth[base + p] + 1 if p >= 0 else 0)
            kind.append(0 if page.tag[i] == "#text" else 2 if page.tag[i] in BLOCK else 1)
        _features(page, base, features, of)
    return Forest(np.array(parent), np.array(depth), np.array(kind), np.array(features), np.array(of), list(pages), starts)


@dataclass
class Potentials:
    """`node` (features,): log odds of content; `edge` (kinds, 2, 2): parent state, child state."""

    node: np.ndarray
    edge: np.ndarray


def marginals(f: Forest, p: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content of each node, and the joint one of parent and child (nodes, 2, 2; zero for roots)."""
    n = len(f.parent)
    unary = np.zeros((n, 2))
    unary[:, 1] = np.bincount(f.of, p.node[f.features], minlength=n)
    edge = p.edge[f.kind]  # (nodes, parent state, child state)
    below, up = unary.copy(), np.zeros((n, 2))
    by_depth = np.argsort(f.depth, kind="stable")
    cuts = np.searchsorted(f.depth[by_depth], np.arange(f.depth.max(initial=0) + 2))
    levels = [by_depth[a:b] for a, b in zip(cuts, cuts[1:])]
    for level in levels[:0:-1]:
        up[level] = np.logaddexp.reduce(below[level][:, None, :] + edge[level], axis=2)
        np.add.at(below, f.parent[level], up[level])
    total = below.copy()
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:
        above = total[f.parent[level]] - up[level]
        both = above[:, :, None] + edge[level]
        total[level] = below[level] + np.logaddexp.reduce(both, axis=1)
        both = both + below[level][:, None, :]
        joint[level] = np.exp(both - np.logaddexp.reduce(both.reshape(len(level), 4), axis=1)[:, None, None])
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700))), joint


def node_labels(page: _Page) -> np.ndarray:
    """Labels of a marked page: text runs by their mark, elements by most of their text, empty ones like their parent.
    Removes the marks."""
    n = len(page.tag)
    size, marked = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "#text":
            size[i] = len(page.text[i])
            marked[i] = size[i] if MARK in page.text[i] else 0
            page.text[i] = page.text[i].replace(MARK, "")
        size[page.parent[i]] += size[i]
        marked[page.parent[i]] += marked[i]
    labels = np.zeros(n, np.int64)
    for i in range(n):
        labels[i] = marked[i] * 2 > size[i] if size[i] else (labels[page.parent[i]] if i else 0)
    return labels


def train(marked_pages: Sequence[str], steps: int = 150, rate: float = 0.1, keep_small: float = 1e-3) -> Potentials:
    """Maximum likelihood with a small quadratic penalty, by Adam over all labelled pages at once."""
    pages = [parse(h) for h in marked_pages]
    y = np.concatenate([node_labels(p) for p in pages])
    f = forest(pages)
    inner = f.parent >= 0
    shape = (len(KINDS), 2, 2)
    seen = np.zeros(shape)
    np.add.at(seen, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
    have = np.bincount(f.features, y[f.of], minlength=len(NAMES))
    theta = np.zeros(len(NAMES) + seen.size)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p = Potentials(theta[:len(NAMES)], theta[len(NAMES):].reshape(shape))
        marginal, joint = marginals(f, p)
        expected = np.zeros(shape)
        np.add.at(expected, f.kind[inner], joint[inner])
        gradient = np.concatenate([have - np.bincount(f.features, marginal[f.of], minlength=len(NAMES)),
                                   (seen - expected).ravel()]) / len(pages) - keep_small * theta
        m1 += 0.1 * (gradient - m1)
        m2 += 0.01 * (gradient ** 2 - m2)
        theta = theta + rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return Potentials(theta[:len(NAMES)], theta[len(NAMES):].reshape(shape))


def _blocks(page: _Page, content: np.ndarray) -> str:
    blocks: dict[int, list[str]] = {}
    for i, tag in enumerate(page.tag):
        if tag == "#text" and content[i] >= 0.5:
            blocks.setdefault(page.block[i], []).append(page.text[i])
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(b for b in joined if b)


def extract(pages: Sequence[str], potentials: Potentials, limit: int = 100_000) -> list[str]:
    """Main text of each page; messages are passed for about `limit` nodes at a time."""
    out: list[str] = []
    held: list[_Page] = []

    def flush():
        if held:
            f = forest(held)
            content, _ = marginals(f, potentials)
            ends = f.starts[1:] + [len(f.parent)]
            out.extend(_blocks(p, content[a:b]) for p, a, b in zip(held, f.starts, ends))
            held.clear()

    nodes = 0
    for html in pages:
        held.append(parse(html))
        nodes += len(held[-1].tag)
        if nodes > limit:
            flush()
            nodes = 0
    flush()
    return out


def labelled_pages(n: int = 300, seed: int = 23) -> list[str]:
    """Labelled pages of common layouts: every text run of the article carries the mark.

    Layouts, class names, order and extras are drawn at random; words are made of syllables, so that
    nothing is learned from a vocabulary. Pass own marked pages to `train` for other kinds of site.
    """
    rng = random.Random(seed)
    syllables = "an be ca do el fi go hu in ja ke lo mi no ou pa qua re si ta un vé wo xi ye zu ör ñe st th er".split()

    def words(low, high):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def prose(low, high):
        text = ". ".join(words(3, 14).capitalize() for _ in range(rng.randint(low, high)))
        return text + rng.choice([".", ".", ".", "!", "?", ""])

    def links(low, high):
        return [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(rng.randint(low, high))]

    def menu():
        items = "".join(f"<li>{a}</li>" for a in links(3, 9))
        return rng.choice([f"<nav><ul>{items}</ul></nav>", f'<ul class="{rng.choice(["nav", "menu", "navbar", "main-menu"])}">{items}</ul>',
                           f'<div class="{rng.choice(["menu", "topbar", "breadcrumb", "navigation nav"])}">{" | ".join(links(3, 8))}</div>',
                           f"<div>{' '.join(links(4, 9))}</div>"])

    def header():
        inner = rng.choice([f"<h1>{words(1, 4)}</h1><p>{words(3, 9)}</p>", f"<span>{words(1, 3)}</span>", f"<a href='/'>{words(1, 3)}</a> {words(2, 6)}"])
        return rng.choice([f"<header>{inner}{menu() if rng.random() < .4 else ''}</header>", f'<div id="{rng.choice(["header", "masthead", "top"])}">{inner}</div>',
                           f'<div class="{rng.choice(["site-header", "branding", "logo"])}">{inner}</div>'])

    def footer():
        inner = rng.choice(["&copy; ", "© 2020 ", ""]) + words(1, 3) + rng.choice([" &middot; ", " | ", ". "]) + rng.choice([prose(1, 3), " ".join(links(2, 5)), words(3, 12)])
        return rng.choice([f"<footer>{inner}</footer>", f"<footer><p>{inner}</p></footer>", f'<div class="{rng.choice(["footer", "site-footer", "copyright", "legal"])}">{inner}</div>',
                           f'<div id="footer"><p>{inner}</p></div>'])

    def side():
        inner = f"<h3>{words(1, 3)}</h3>" + rng.choice(["<ul>" + "".join(f"<li>{a}</li>" for a in links(2, 7)) + "</ul>", f"<p>{prose(1, 3)}</p>", f"<p>{prose(2, 5)} {links(1, 1)[0]}</p>"])
        return rng.choice([f"<aside>{inner}</aside>", f'<div class="{rng.choice(["sidebar", "widget", "related", "side rail", "recommended", "trending"])}">{inner}</div>',
                           f'<div id="sidebar">{inner}{inner}</div>'])

    def advert():
        inner = rng.choice([prose(1, 3), words(2, 8), f"<p>{prose(1, 3)}</p>", f"<a href='/x'>{words(2, 6)}</a>"])
        return rng.choice(["<!-- ad -->", ""]) + f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement", "banner"])}">{inner}</div>'

    def notice():
        return f'<div class="{rng.choice(["cookie", "notice", "consent", "gdpr", "cookie-banner", "alert", "popup", "privacy-notice"])}">' \
               + rng.choice([f"<p>{prose(1, 4)}</p>", prose(1, 3)]) + rng.choice(["", f"<button>{words(1, 2)}</button>"]) + "</div>"

    def form():
        name = rng.choice(["newsletter", "subscribe", "search", "login", "contact", "signup"])
        inner = f"<label>{words(1, 4)}</label><input name='q'><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{prose(1, 3)}</p>"])
        return rng.choice([f"<form>{inner}</form>", f'<form class="{name}">{inner}</form>', f'<div class="{name}"><p>{prose(1, 2)}</p><form>{inner}</form></div>'])

    def comments():
        one = lambda: rng.choice([f'<div class="comment"><b>{words(1, 2)}</b><p>{prose(1, 6)}</p></div>', f'<li><cite>{words(1, 2)}</cite><p>{prose(1, 6)}</p></li>',
                                  f"<p>{words(1, 2)}: {prose(1, 6)}</p>", f'<article class="comment"><p>{prose(1, 6)}</p></article>'])
        inner = f"<h{rng.choice('234')}>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 6)))
        return rng.choice([f'<section class="comments">{inner}</section>', f'<div id="comments">{inner}</div>', f'<ol class="commentlist">{inner}</ol>',
                           f'<div class="{rng.choice(["comments", "discussion", "replies", "reader-comments", "reviews"])}">{inner}</div>'])

    def share():
        return f'<div class="{rng.choice(["share", "social", "tags", "byline", "meta"])}">{rng.choice([" ".join(links(2, 5)), words(2, 6)])}</div>'

    def article():
        def run(low, high):
            return MARK + prose(low, high)

        def paragraph():
            kind = rng.random()
            if kind < .55:
                return f"<p>{run(1, 7)}</p>"
            if kind < .65:
                return f"<p>{run(1, 4)} <{(t := rng.choice(['b', 'i', 'em', 'strong', 'span', 'code']))}>{run(1, 1)}</{t}> {run(1, 3)}</p>"
            if kind < .72:
                return f"<p>{run(1, 4)} <a href='/y'>{MARK}{words(1, 4)}</a> {run(1, 3)}</p>"
            if kind < .80:
                return f"<p><b>{run(1, 5)}<br>"
            if kind < .84:
                return f"<h{(n := rng.choice('23'))}>{MARK}{words(1, 7)}</h{n}>"
            if kind < .88:
                return "<ul>" + "".join(f"<li>{MARK}{words(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            if kind < .92:
                return f"<blockquote>{rng.choice(['<p>', ''])}{run(1, 4)}</blockquote>"
            if kind < .94:
                return f"<pre>{MARK}{words(3, 20)}</pre>"
            if kind < .96:
                return "<table>" + "".join(f"<tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{words(1, 4)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
            return f"<p>{MARK}{words(1, 4)}</p>" if kind < .98 else f"<div>{run(2, 6)}</div>"

        bare = rng.random() < .15  # no tag says what is a paragraph
        parts = [f"<div>{run(1, 6)}</div>" if bare and rng.random() < .8 else paragraph() for _ in range(rng.choice([1, 2, 3, 5, 8, 12]))]
        for extra, chance in ((advert, .25), (share, .15), (side, .1), (form, .1), (notice, .05)):
            if rng.random() < chance:
                parts.insert(rng.randint(0, len(parts)), extra())
        if rng.random() < .15:
            parts.append(comments())
        title = f"<h1>{MARK}{words(3, 12)}</h1>" if rng.random() < .8 else ""
        inner = title + "".join(parts)
        name = rng.choice(["content", "post", "entry-content", "article-body", "story", "post-content", "main-content"])
        kind = rng.random()
        if kind < .34:
            return f"<article>{inner}</article>"
        if kind < .42:
            return f"<main>{inner}</main>"
        if kind < .5:
            return f"<main><article>{inner}</article></main>"
        if kind < .7:
            return f'<div {rng.choice(["class", "id"])}="{name}">{inner}</div>'
        return f"<section>{inner}</section>" if kind < .76 else f"<div>{inner}</div>" if kind < .9 else inner

    def page():
        before = [b() for b, chance in ((header, .5), (menu, .8), (notice, .3), (advert, .4), (form, .2), (side, .15)) if rng.random() < chance]
        after = [b() for b, chance in ((comments, .35), (side, .4), (advert, .3), (form, .25), (share, .2), (notice, .15), (menu, .15), (footer, .85)) if rng.random() < chance]
        script = rng.choice(["", '<script>var t="</p>";</script>', "<style>p{margin:0}</style>"])
        body = "".join(before) + article() + "".join(after)
        return f"<!DOCTYPE html><html><head><title>{words(3, 9)}</title>{script}</head><body>{body}{script}</body></html>"

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def default_potentials() -> Potentials:
    """Trained once per process on the labelled pages above."""
    return train(labelled_pages())


def extract_text(pages: DataFrame, potentials: Potentials, html: str = "html") -> DataFrame:
    """All rows and columns of `pages` with text and n_chars (such columns are replaced)."""
    shared = pages.sparkSession.sparkContext.broadcast(potentials)

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(extract([h if h is not None else "" for h in batch], shared.value), dtype=object)

    found = pages.select(as_row(pages), apply(field(html)).alias("text"))
    return unpack(found, pages.columns, {"text": F.col("text"), "n_chars": F.length("text").cast("long")})
