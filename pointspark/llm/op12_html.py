"""Main text of HTML pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is the text between two boundaries of block elements. Its features are the tags and the words of
class, id and role of all its ancestors, and its text: length, share of linked characters, end, place in the page, its
neighbours, a few words of interfaces. The field has two labels, main text and rest; how likely the label changes
from a block to the next depends on whether both stand in the same element. Pages are parsed and decoded by Viterbi
where they are, in one pass without a shuffle.

The field is trained on labelled pages: a sample of at most ``train_pages`` pages, each of at most ``train_chars``
characters, chosen by a hash of the identifier. Labels come from the pages' own landmarks (``article`` and ``main`` against ``nav``,
``header``, ``footer``, ``aside``, ``form`` and adverts). As pages elsewhere name these parts in other ways, or do not name them,
each sampled page is also laid out anew, ``layouts`` times, from its own labelled blocks: containers of other tags and
class names, wrappers, adverts and comments inside of the article. The fit is on the driver, over at most
``train_pages`` (1 + ``layouts``) pages; its model is a few thousand weights.

Defined cases: null, empty and blank pages have an empty text, as have pages of which no block is main text; markup that is not
closed ends with the page; character references are decoded once; pages of one identifier are extracted each for itself; white
space is all that Unicode calls so; texts of any length are read whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import release, small_batches

#: Elements that bound blocks, that have no content, that make parts of a page, and whose content is never its text (fixed by HTML).
BLOCK = frozenset("html body article aside main nav header footer section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend blockquote pre figure figcaption address hr details summary center dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PARTS = frozenset("body article aside main nav header footer section div form ul ol dl table details dialog menu".split())
SILENT = frozenset("head script style template noscript svg math iframe object canvas audio video".split())
IN_HEAD = frozenset("title meta link base script style template noscript".split())
#: An element that begins ends open ones of these kinds, up to the nearest of the last column.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Words that name or fill parts of pages other than the main text (fixed).
CUES = frozenset("cookie cookies consent subscribe newsletter copyright reserved share login sign register comment comments reply replies advertisement sponsored menu search privacy terms related previous next home datenschutz impressum kommentar kommentare werbung anzeige mentions commentaire commentaires publicité comentario comentarios publicidad".split())


class Block(NamedTuple):
    text: str
    linked: float  # share of characters inside of links
    path: tuple[tuple[str, tuple[str, ...]], ...]  # ancestors from the top, each with its words


@functools.lru_cache(4096)
def name_words(names: str) -> tuple[str, ...]:
    """Words of a class or id: parted at signs, digits and inner capitals."""
    return tuple(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", names))


class Blocks(HTMLParser):
    """Leaf blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.silent = self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.path: tuple | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.found.append(Block(text, min(1.0, self.linked / len(text)), self.path))
        self.parts, self.linked, self.path = [], 0, None

    def pop_to(self, depth: int) -> None:
        for tag, _ in self.open[depth:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[depth:]

    def end_open(self, tags: set[str], within: set[str]) -> None:
        """Ends the topmost open element of ``tags`` that stands inside of the nearest of ``within``."""
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in within:
                return
            if self.open[depth][0] in tags:
                return self.pop_to(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and tag not in IN_HEAD and (tag == "body" or tag in BLOCK):
            self.end_open({"head"}, set())
        if tag in BLOCK:
            self.flush()
            self.end_open({"p"}, BLOCK - {"p"})
            if tag in ENDS:
                self.end_open(*ENDS[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        words = ()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words += name_words(value)
            elif name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "")):
                words += ("hidden",)
        self.open.append((tag, words))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                return self.pop_to(depth)
            if tag not in BLOCK and tag not in SILENT and self.open[depth][0] in BLOCK:
                return  # an inline element ends with its block

    def handle_data(self, data: str) -> None:
        if not self.silent:
            if self.path is None and not data.isspace():
                self.path = tuple(self.open)
            self.parts.append(data)
            self.linked += len(data) if self.links else 0


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.found


def path_features(path: tuple) -> list[str]:
    """Features of a block's ancestors."""
    blocks = [tag for tag, _ in path if tag in BLOCK] or [""]
    near, words = next((e for e in reversed(path) if e[0] in PARTS), ("", ()))
    return ["bias", "in:" + blocks[-1], "near:" + near, *{"near:" + near + ":" + w for w in words or ["-"]}, *{"under:" + tag for tag, _ in path}, *{"name:" + w for _, words in path for w in words}]


def _size(block: Block) -> int:
    return min(7, int(math.log2(block.text.count(" ") + 1)))


def _share(block: Block) -> int:
    return int(3.999 * block.linked)


def text_features(blocks: list[Block], at: int) -> list[str]:
    """Features of a block's text and its neighbours'."""
    own, n = blocks[at], len(blocks)
    before, after = blocks[at - 1] if at else None, blocks[at + 1] if at + 1 < n else None
    out = [f"size:{_size(own)}", f"linked:{_share(own)}", f"end:{own.text[-1] in '.!?…:'}", f"place:{4 * at // n}"]
    out.append(f"before:{_size(before)}:{_share(before)}" if before else "before:")
    out.append(f"after:{_size(after)}:{_share(after)}" if after else "after:")
    if len(own.text) < 200:
        out += ["word:" + w for w in {w.strip(".,:;!?()").lower() for w in own.text.split()} & CUES]
        out += ["sign"] if own.text[0] in "©|»«›‹←→·" else []
    return out


def same_place(a: Block, b: Block) -> int:
    """Whether two blocks stand in the same element, neither in a part of it that has a name of its own."""
    return int(a.path == b.path or (a.path[:-1] == b.path[:-1] and a.path[-1][1] == b.path[-1][1]))


class Model(NamedTuple):
    weights: dict[str, float]
    change: list[list[list[float]]]  # by same_place, label before, label

    def main(self, blocks: list[Block], known: dict[tuple, float] | None = None) -> list[bool]:
        """Viterbi path: which blocks are main text. ``known`` keeps scores of ancestors between calls."""
        known, get = {} if known is None else known, self.weights.get
        best, back = [0.0, 0.0], []
        for at, block in enumerate(blocks):
            if block.path not in known:
                if len(known) > 50_000:
                    known.clear()
                known[block.path] = sum(get(f, 0.0) for f in path_features(block.path))
            score = known[block.path] + sum(get(f, 0.0) for f in text_features(blocks, at))
            if at:
                c = self.change[same_place(blocks[at - 1], block)]
                rest, main = (max((best[0] + c[0][y], 0), (best[1] + c[1][y], 1)) for y in (0, 1))
                back.append((rest[1], main[1]))
                best = [rest[0], main[0] + score]
            else:
                best = [0.0, score]
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return [bool(y) for y in reversed(labels)][: len(blocks)]


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, l2: float = 0.02, rate: float = 0.25) -> Model:
    """Weights of largest penalised likelihood, by Adam on all pages at once; forward and backward sums run over all pages side by side."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Model({}, [[[0.0, 0.0], [0.0, 0.0]]] * 2)
    ids: dict[str, int] = {}
    rows, cols = [], []
    n, length = len(pages), max(len(b) for b, _ in pages)
    y, there, same = np.zeros((n, length), np.int64), np.zeros((n, length), bool), np.zeros((n, length), np.int64)
    for p, (blocks, labels) in enumerate(pages):
        for t, block in enumerate(blocks):
            feats = [ids.setdefault(f, len(ids)) for f in path_features(block.path) + text_features(blocks, t)]
            rows += [p * length + t] * len(feats)
            cols += feats
            y[p, t], there[p, t], same[p, t] = labels[t], True, same_place(blocks[t - 1], block) if t else 0
    rows, cols = np.array(rows), np.array(cols)
    k = len(ids)
    theta = np.zeros(k + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair = np.zeros(8)
    np.add.at(pair, (same * 4 + np.roll(y, 1, axis=1) * 2 + y)[:, 1:][there[:, 1:]], 1)
    total = there.sum()
    lse = lambda x, axis: np.logaddexp(*np.moveaxis(x, axis, 0))  # of the two labels
    for step in range(1, rounds + 1):
        score = np.bincount(rows, theta[cols], n * length).reshape(n, length)
        emit = np.stack((np.zeros_like(score), score), axis=2)
        change = theta[k:].reshape(2, 2, 2)
        forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, length):
            forward[:, t] = np.where(there[:, t, None], lse(forward[:, t - 1, :, None] + change[same[:, t]], 1) + emit[:, t], forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            backward[:, t] = np.where(there[:, t + 1, None], lse(change[same[:, t + 1]] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0.0)
        z = lse(forward[:, -1], 1)
        p_main = np.where(there, np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]), 0.0)
        gradient = np.bincount(cols, (y.ravel() * there.ravel() - p_main.ravel())[rows], k)
        joint = forward[:, :-1, :, None] + change[same[:, 1:]] + (emit + backward)[:, 1:, None, :] - z[:, None, None, None]
        joint = np.where(there[:, 1:, None, None], np.exp(np.minimum(joint, 0.0)), 0.0)
        expected = np.stack([joint[same[:, 1:] == s].sum(axis=0) for s in (0, 1)]).ravel()
        g = (np.concatenate((gradient, pair - expected)) - l2 * theta) / total * 100
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (1 - step / rounds / 1.02) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in ids.items()}, theta[k:].reshape(2, 2, 2).tolist())


# Landmarks and names that training pages are laid out with (fixed).
MAIN, ASIDE = {"article", "main"}, {"nav", "header", "footer", "aside", "form"}
ADVERT = {"ad", "ads", "advert", "advertisement", "sponsored", "promo"}
TEXT_NAMES = "content article post entry story text body main article-body post-content entry-content main-content story-text page-content blog-post news detail copy prose single read article__body".split()
NEUTRAL = "wrapper container page row col layout inner site grid box outer wrap block section left center x1 content main".split()
REST = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs tabs links pagination pager main-nav site-nav top-menu skip toc".split(),
    "header": "header masthead topbar logo branding site-header page-header top site-title tagline".split(),
    "footer": "footer copyright legal colophon bottom credits imprint site-footer page-footer foot".split(),
    "aside": "sidebar side widget related recommended trending popular archive rail tags categories side-bar related-posts most-read left-sidebar right-sidebar see-also".split(),
    "div": "notice cookie consent gdpr alert popup modal overlay paywall message warning disclaimer toast privacy cookie-notice cookie-banner banner notification hidden info-bar".split(),
    "section": "ad ads advert advertisement sponsor sponsored promo promotion adsense commercial teaser ad-slot advert-box ad-banner promoted outbrain partner".split(),
    "form": "form search login signup newsletter subscribe contact search-form newsletter-signup comment-form poll survey".split(),
    "ol": "comments comment discussion disqus replies reply responses feedback reviews thread comment-list user-comments reader-comments commentlist respond".split(),
    "ul": "share social sharing follow share-buttons social-links buttons tools".split(),
}


def landmark_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by a page's own landmarks, or None where it has none of the main text."""
    if not any(MAIN & {t for t, _ in b.path} for b in blocks):
        return None
    out = []
    for b in blocks:
        tags, names = {t for t, _ in b.path}, {w for _, words in b.path for w in words}
        out.append(int(bool(MAIN & tags) and not ASIDE & tags and not ADVERT & names))
    return out


def _paragraph(rng: random.Random, text: str, linked: float) -> str:
    tag = rng.choice(["p", "p", "p", "div", "li", "span", "a"])
    inner = f'<a href="#">{escape(text)}</a>' if rng.random() < linked else escape(text)
    return f"<p>{inner}</p>" if tag in ("span", "a", "p") else f"<{tag}>{inner}</{tag}>"


def lay_out(rng: random.Random, main: list[tuple[str, str]], rest: list[str]) -> tuple[str, list[int]]:
    """A page of the same blocks in another layout, and its labels. ``main``: tags and texts; ``rest``: texts to fill other parts with."""

    def named(tag: str, names: list[str]) -> tuple[str, str]:
        if not names:
            return f"<{tag}>", f"</{tag}>"
        key = rng.choice(["class", "class", "class", "id"])
        extra = rng.choice(["", "", " " + rng.choice(NEUTRAL)])
        return f'<{tag} {key}="{rng.choice(names)}{extra if key == "class" else ""}">', f"</{tag}>"

    def other(kind: str) -> list[tuple[str, int | None]]:
        if kind in ("div", "section") or rng.random() < 0.5:
            top, end = named(rng.choice(["div", "div", "section", "aside", "ul"]), REST[kind])
        else:
            top, end = named(kind, REST[kind] if kind in ("ol", "ul") else rng.choice([[], REST[kind]]))
        linked = {"nav": 0.9, "aside": 0.5, "ul": 0.7, "footer": 0.3, "header": 0.3}.get(kind, 0.1)
        if rng.random() < 0.2:  # text without an element of its own
            return [(top + escape(" ".join(rng.choice(rest).split()[: rng.choice([3, 8, 40])])) + end, 0)]
        out: list[tuple[str, int | None]] = [(top, None)]
        if kind in ("aside", "ol", "form", "header") and rng.random() < 0.5:
            tag = rng.choice(["h1", "h1", "h2"]) if kind == "header" else rng.choice(["h2", "h3", "h4"])
            out.append((f"<{tag}>{escape(' '.join(rng.choice(rest).split()[:3]))}</{tag}>", 0))
        for _ in range(rng.choice([1, 1, 2, 3]) if kind not in ("nav", "ol") else rng.randint(2, 6)):
            words = rng.choice(rest).split()
            if linked > 0.5 or rng.random() < 0.3:
                words = words[: rng.randint(1, 4)]
            inner = _paragraph(rng, " ".join(words), linked)
            if kind == "ol" and rng.random() < 0.7:
                inner = f'<div class="{rng.choice(["comment", "comment-body", "reply", "item"])}">{inner}</div>'
            out.append((inner, 0))
        return [*out, (end, None)]

    def article() -> list[tuple[str, int | None]]:
        style = rng.random()
        top, end = ("", "") if style < 0.1 else named("article", []) if style < 0.3 else named("main", []) if style < 0.4 else named(rng.choice(["article", "div", "div", "section", "main"]), TEXT_NAMES) if style < 0.85 else named("div", NEUTRAL)
        out: list[tuple[str, int | None]] = [(top, None)]
        inside = [k for k in ("section", "aside", "ul", "div", "nav", "form") if rng.random() < 0.12]
        for i, (tag, text) in enumerate(main):
            if tag.startswith("h") and i == 0 and rng.random() < 0.15:
                out.append((f"<header><{tag}>{escape(text)}</{tag}></header>", 1))
            elif tag == "p" and rng.random() < 0.08:
                out.append((rng.choice(["<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<h2>{}</h2>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", '<p><a href="#">{}</a></p>']).format(escape(text)), 1))
            else:
                out.append((f"<{tag}>{escape(text)}</{tag}>", 1))
            if inside and i and rng.random() < 0.3:
                out += other(inside.pop())
        out += [x for k in inside for x in other(k)]
        if rng.random() < 0.15:
            out += other("ol")
        return [*out, (end, None)]

    before = [k for k, p in (("div", 0.4), ("header", 0.7), ("nav", 0.8), ("section", 0.4), ("form", 0.3), ("aside", 0.3)) if rng.random() < p]
    after = [k for k, p in (("ul", 0.4), ("ol", 0.5), ("aside", 0.5), ("section", 0.4), ("form", 0.3), ("div", 0.3), ("footer", 0.8)) if rng.random() < p]
    wraps = [named("div", NEUTRAL) for _ in range(rng.choice([0, 0, 1, 2]))]
    parts = [(w, None) for w, _ in wraps] + [x for k in before for x in other(k)] + article() + [x for k in after for x in other(k)] + [(w, None) for _, w in wraps]
    return "<body>" + "".join(h for h, _ in parts) + "</body>", [y for _, y in parts if y is not None]


def training_pages(htmls: list[str], layouts: int, seed: int = 12) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages from a sample: as they are where landmarks label them, and laid out anew."""
    rng, out, parsed, pool = random.Random(seed), [], [], []
    for html in htmls:
        blocks = blocks_of(html)
        labels = landmark_labels(blocks)
        if labels:
            out.append((blocks, labels))
        labels = labels or [int(b.text.count(" ") > 8 and b.linked < 0.5) for b in blocks]
        main = [((b.path[-1][0] if b.path and b.path[-1][0] in ("h1", "h2", "h3") else "p"), b.text) for b, y in zip(blocks, labels, strict=True) if y]
        pool += [b.text for b, y in zip(blocks, labels, strict=True) if not y] + [" ".join(t.split()[: rng.randint(5, 80)]) for _, t in main[1:3]]
        if main:
            parsed.append(main[:20])
    for main in parsed if pool else []:
        for _ in range(layouts):
            html, labels = lay_out(rng, main, pool)
            blocks = blocks_of(html)
            if len(blocks) == len(labels):
                out.append((blocks, labels))
    return out


def train(pages: DataFrame, train_pages: int = 150, train_chars: int = 50_000, layouts: int = 5, page_id: str = "page_id", html: str = "html") -> Model:
    """The field, fitted on a bounded sample of ``pages``."""
    text = F.col(html).cast("string")
    named = pages.select(F.xxhash64(F.lit(12), F.col(page_id).cast("string"), text).alias("h"), text.alias("html")).filter(F.length("html").between(1, train_chars))
    chosen = [r["h"] for r in named.select("h").distinct().orderBy("h").limit(train_pages).collect()]  # hashes alone are sorted
    sample = named.filter(F.col("h").isin(chosen)).dropDuplicates(["h"]).orderBy("h").collect() if chosen else []  # ``train_pages`` rows of ``train_chars`` characters at most
    return fit(training_pages([r["html"] for r in sample], layouts))


def extract(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        for batch in batches:
            texts = []
            for value in batch.column(2):
                blocks = blocks_of(value.as_py())
                keep = shared.value.main(blocks, known) if blocks else []
                texts.append("\n\n".join(b.text for b, y in zip(blocks, keep, strict=True) if y))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])
        release()

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
