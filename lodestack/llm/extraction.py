"""HTML main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks, the runs of text between block-level tags. Each block has features of its ancestor tags (and
of what their class, id and role say) and of its text. The chain's two labels are boilerplate and main text; weights are
trained on labelled pages by gradient ascent on the conditional likelihood, and a page is decoded by Viterbi.

The labelled pages come from ``sample_pages``, a seeded generator of page layouts; ``train`` takes any others. Menus,
forms, scripts and the like can stand inside an article, and comments may read like one, so no single tag decides.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import apply_struct

# HTML's tag classes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml canvas textarea select option".split())
_TO_THE_END = frozenset("script style textarea iframe".split())  # without an end tag they hold the rest of the page
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split()
    + "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded menclose mtable mtr mtd semantics".split()
)
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>])*+)(?:>|$)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLING = frozenset("class id role itemprop aria-label hidden style".split())
#: Parts of a class that speak of a state or of what stands elsewhere: such a class hints at nothing.
_STATES = frozenset("no not non has have with without is can open opened closed enabled disabled".split())
#: Words in class, id and role, and what they hint at. Fixed values.
_HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer foot colophon copyright legal",
    "side": "sidebar aside widget related recommended complementary rail trending popular",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner-ad",
    "note": "cookie cookies consent notice alert gdpr popup modal newsletter subscribe subscription signup paywall",
    "talk": "comment comments reply replies discussion disqus respond responses thread",
    "share": "share sharing social tags meta byline author-box toolbar",
    "form": "form search login contact",
    "main": "article content post entry story main maincontent body articlebody text prose",
}
_HINT_OF = {w: kind for kind, ws in _HINTS.items() for w in ws.split()}
_TAGS = frozenset("article main nav header footer aside form section ul ol li table td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dl dd dt div button fieldset address dialog details body".split())
_PHRASES = {
    "cookie": "cookie", "rights": "all rights reserved", "copy": "©", "subscribe": "subscribe", "advert": "advertis", "comments": "comment",
    "signin": "sign in", "share": "share", "more": "read more",
}


#: Open tags that a new tag of the kind ends, and the tags beyond which it ends none. Fixed values.
_ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_BOUNDS = ("ul", "ol", "table", "dl")


@dataclass
class Block:
    """A block's text, the block-level tags and hints around it, the innermost such tag, and its linked characters."""

    text: str
    tags: frozenset
    hints: frozenset
    leaf: str
    linked: int


class _Open:
    """The open tags. What stands around a place is counted as tags open and close, so no step depends on the depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[str] = []
        self.tags: Counter = Counter()
        self.hints: Counter = Counter()

    def push(self, tag: str, hints: frozenset) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, hints))
        if tag not in _INLINE:
            self.blocks.append(tag)
            self.hints.update(hints)
            if tag in _TAGS:
                self.tags[tag] += 1

    def close(self, depth: int) -> None:
        """Close all tags from ``depth`` on."""
        while len(self.stack) > depth:
            tag, hints = self.stack.pop()
            self.at[tag].pop()
            if tag not in _INLINE:
                self.blocks.pop()
                self.hints.subtract(hints)
                if tag in _TAGS:
                    self.tags[tag] -= 1

    def last(self, *tags: str) -> int:
        """Where the innermost of ``tags`` stands, -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def leaf_blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order. White space in a block is one blank; blocks without text are none.

    The work grows with the page, not with how deep its tags nest or how many are left open.
    """
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    unclosed: set[str] = set()  # raw tags without an end in the rest of the page
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            present = lambda counts: frozenset(k for k, n in counts.items() if n)
            out.append(Block(text, present(open_.tags), present(open_.hints), open_.blocks[-1] if open_.blocks else "", linked))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if not raw:
            return
        text = html.unescape(raw)
        if open_.at.get("a"):
            linked += len("".join(text.split()))
        parts.append(text)

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW or tag in ("head", "title"):
            if not closing and not m[3].rstrip().endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
                if end is not None:
                    at = end.end()
                elif tag in _TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(tag)
            if tag not in ("option", "svg", "object", "annotation", "annotation-xml"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
        if closing:
            if (depth := open_.last(tag)) >= 0:
                open_.close(depth)
            continue
        if tag not in _INLINE and open_.at.get("p"):
            open_.close(open_.at["p"][0])  # a block-level tag ends an open paragraph
        if (depth := open_.last(*_ENDS.get(tag, ()))) > open_.last(*_BOUNDS):
            open_.close(depth)
        hints = set()
        for name, value in _ATTR.findall(m[3] if tag not in ("html", "body") else ""):  # these stand around all blocks
            name, value = name.lower(), value.strip("\"'").lower()
            if name not in _TELLING:
                continue
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                hints.add("hidden")
            for word in value.split():
                parts_of = re.split("[_-]+", word)
                if not _STATES.intersection(parts_of):
                    hints.update(_HINT_OF[x] for x in (word, *parts_of) if x in _HINT_OF)
        if not m[3].rstrip().endswith("/"):
            open_.push(tag, frozenset(hints))
    say(page[at:])
    flush()
    return out


FEATURES: dict[str, int] = {}
for _name in (
    ["bias", "first", "last", "few", "link0", "link1", "link2", "ends", "comma", "heading", "hidden"]
    + [f"tag={t}" for t in sorted(_TAGS)] + [f"leaf={t}" for t in sorted(_TAGS)] + [f"hint={h}" for h in sorted(_HINTS)]
    + [f"words{i}" for i in range(7)] + [f"says={p}" for p in sorted(_PHRASES)]
):
    FEATURES[_name] = len(FEATURES)


def features(blocks: list[Block]) -> list[list[int]]:
    out = []
    for i, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        density = b.linked / max(1, len(b.text))
        names = ["bias", f"words{min(6, n.bit_length() - 1)}", "link0" if density < 0.1 else "link1" if density < 0.6 else "link2"]
        names += [f"tag={t}" for t in b.tags] + [f"hint={h}" for h in b.hints & _HINTS.keys()]
        low = b.text.lower()
        names += [f"says={k}" for k, s in _PHRASES.items() if s in low]
        if b.leaf in _TAGS:
            names.append(f"leaf={b.leaf}")
        for name, holds in (("first", i == 0), ("last", i == len(blocks) - 1), ("few", len(blocks) < 5), ("ends", b.text[-1] in ".!?。"), ("comma", "," in b.text), ("hidden", "hidden" in b.hints), ("heading", re.fullmatch(r"h[1-6]", b.leaf))):
            if holds:
                names.append(name)
        out.append([FEATURES[x] for x in names])
    return out


@dataclass
class Crf:
    """``weights`` score main text against boilerplate; ``moves`` are the scores of a label after a label."""

    weights: np.ndarray
    moves: np.ndarray


def loss_and_gradients(w: np.ndarray, t: np.ndarray, feats: list[list[int]], labels: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of a page's labels, and its gradients, by forward and backward sums."""
    n = len(feats)
    e = np.array([[0.0, w[f].sum()] for f in feats])
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    fore[0] = e[0]
    for i in range(1, n):
        fore[i] = np.logaddexp.reduce(fore[i - 1][:, None] + t, axis=0) + e[i]
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp.reduce(t + (e[i + 1] + back[i + 1])[None], axis=1)
    z = np.logaddexp.reduce(fore[-1])
    main = np.exp(fore + back - z)[:, 1]
    dw, dt, total = np.zeros_like(w), np.zeros_like(t), -z
    for i, (f, y, p) in enumerate(zip(feats, labels, main)):
        np.add.at(dw, f, y - p)
        total += e[i, y]
    for i in range(1, n):
        total += t[labels[i - 1], labels[i]]
        dt[labels[i - 1], labels[i]] += 1
        dt -= np.exp(fore[i - 1][:, None] + t + (e[i] + back[i])[None] - z)
    return float(total), dw, dt


def train(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-3, seed: int = 5) -> Crf:
    """Stochastic gradient ascent (Adagrad) on the conditional log likelihood."""
    rng = np.random.default_rng(seed)
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(pages)):
            feats, labels = pages[k]
            if not feats:
                continue
            _, dw, dt = loss_and_gradients(w, t, feats, labels)
            dw, dt = dw - decay * w, dt - decay * t
            gw += dw * dw
            gt += dt * dt
            w += rate * dw / np.sqrt(gw)
            t += rate * dt / np.sqrt(gt)
    return Crf(w, t)


def viterbi(model: Crf, feats: list[list[int]]) -> list[int]:
    """The likeliest labels; boilerplate on ties."""
    if not feats:
        return []
    weigh, ((bb, bm), (mb, mm)) = model.weights.tolist().__getitem__, model.moves.tolist()
    b, m, steps = 0.0, sum(map(weigh, feats[0])), []
    for f in feats[1:]:
        e = sum(map(weigh, f))
        from_b, from_m = m + mb > b + bb, m + mm > b + bm
        steps.append((from_b, from_m))
        b, m = max(b + bb, m + mb), max(b + bm, m + mm) + e
    label = int(m > b)
    out = [label]
    for step in reversed(steps):
        label = int(step[label])
        out.append(label)
    return out[::-1]


_SYLLABLES = "ka lo mi ne ru sa to vi be do fi gu ha je li mo pa qui ra su te wo ya zu ter ing est and".split()


def sample_pages(n: int, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """(html, main-text blocks) of ``n`` pages of varied layout and invented words."""
    rng = np.random.default_rng(seed)
    chance = lambda p: rng.random() < p
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def words(k: int) -> str:
        return " ".join("".join(_SYLLABLES[j] for j in rng.integers(0, len(_SYLLABLES), rng.integers(1, 4))) for _ in range(k))

    def sentence() -> str:
        return words(int(rng.integers(4, 14))).capitalize() + pick(".", ".", ".", "!", "?")

    def prose(most: int = 5) -> str:
        text = " ".join(sentence() for _ in range(int(rng.integers(1, most + 1))))
        return text.replace(" ", ", ", 1) if chance(0.7) else text

    def notice() -> str:
        """A notice of one sentence to some 2,000 characters, told by its phrases only."""
        said = pick(
            ("We use cookies.", "Our partners share them with advertisers."), ("© The owner.", "All rights reserved."), ("Subscribe to our newsletter.", "Sign in if you have an account."),
            ("Advertisement.", "Read more."), ("Sign in to go on.", "Leave a comment."), ("Share this page.", "Read more."),
        )
        said = said if chance(0.7) else [pick(*said)]
        long = chance(0.6)
        parts = [x for s in said for x in (s, prose(20 if long else 2))]
        return " ".join(parts if chance(0.5) else parts[::-1])

    def paragraph() -> str:
        """Article text, now and then of over 600 characters; a few times it holds a word that notices have."""
        text = prose(30) if chance(0.25) else prose()
        return f"{text} {words(3).capitalize()} {pick('cookie', 'comment', 'share', 'subscribe', 'advertising', 'sign in')} {sentence()}" if chance(0.015) else text

    link = lambda: f'<a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a>'
    links = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    box = lambda tag, kind, inner: f'<{tag}{f" class={chr(34)}{kind}{chr(34)}" if kind else ""}>{inner}</{tag}>'

    def boiler() -> str:
        k = int(rng.integers(1, 7))
        return pick(
            lambda: box("nav", "", links(k)),
            lambda: box("div", pick("menu", "nav", "breadcrumb"), links(k) if chance(0.5) else " &gt; ".join(link() for _ in range(k))),
            lambda: box("div", pick("ad", "advert", "ads banner", "sponsored", "promo"), pick(prose, sentence)()),
            lambda: box(pick("aside", "div"), pick("sidebar", "widget related", "sidebar"), f"<h3>{words(2)}</h3>" + pick(lambda: links(k), lambda: f"<p>{prose()}</p>")()),
            lambda: box("aside", "", pick(lambda: links(k), lambda: f"<p>{prose()}</p>")()),
            lambda: box("div", pick("cookie-notice", "consent", "notice", "newsletter"), f"<p>{pick('We use cookies. ', 'Subscribe: ', '')}{prose()}</p><button>{words(1)}</button>"),
            lambda: box("form", pick("", "search", "login"), f"<label>{words(1)}</label><input name=q><button>{words(1)}</button>" + (f"<p>{sentence()}</p>" if chance(0.4) else "")),
            lambda: box("div", pick("share", "social", "tags"), " ".join(link() for _ in range(k))),
            lambda: box(pick("p", "div"), "", notice()) if chance(0.5) else box("div", "", f"<p>{notice()}</p>"),
            lambda: f"<script>var x = '<p>{words(2)}</p>';</script><style>p {{margin: 0}}</style>",
        )()

    def comments() -> str:
        one = lambda: pick("<div class=comment>{}</div>", "<li class=comment>{}</li>", "<div>{}</div>").format(f"<b>{words(1)}</b>" * chance(0.5) + f"<p>{prose()}</p>")
        inner = f"<h3>{pick('Comments', words(1))}</h3>" * chance(0.6) + "".join(one() for _ in range(int(rng.integers(1, 5))))
        return pick('<section id="comments">{}</section>', '<div class="comments">{}</div>', '<div id="comments" class="discussion">{}</div>', '<ol class="comment-list">{}</ol>').format(inner)

    for _ in range(n):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(text)
            return text

        def body_block() -> str:
            kind = rng.integers(0, 12)
            if kind == 0:
                return "<ul>" + "".join(f"<li>{keep(pick(sentence, lambda: words(3))())}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>"
            if kind == 1:
                return f"<h{(h := pick(2, 3))}>{keep(words(int(rng.integers(1, 6))).capitalize())}</h{h}>"
            if kind == 2:
                return f"<blockquote><p>{keep(prose())}</p></blockquote>" if chance(0.6) else f"<table><tr><td>{keep(words(2))}</td><td>{keep(sentence())}</td></tr></table>"
            if kind == 3:
                return f"<p>{keep(words(int(rng.integers(1, 3))).capitalize() + '.')}"
            if kind == 4:
                a, b, c = sentence(), words(2), sentence()
                keep(f"{a} {b} {c}")
                return f'<p>{a} <a href="/x">{b}</a> {c}</p>'
            return f"<p>{keep(paragraph())}" + pick("</p>", "</p>", "")

        title = lambda: f"<h1>{keep(words(int(rng.integers(2, 10))).capitalize() + pick('', '', '.'))}</h1>" if chance(0.85) else ""
        story = title() + "".join(body_block() + (boiler() if chance(0.06) else "") for _ in range(int(rng.integers(1, 14))))
        shape = pick("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="{k}">{}</div>', '<div id="content"><div class="{k}">{}</div></div>', "<div>{}</div>", "{}")
        talk = comments() if chance(0.35) else ""
        inside = chance(0.4)
        story = shape.replace("{}", story.replace("{", "(") + (talk if inside else "")).replace("{k}", pick("content", "post", "entry-content", "story", "article-body", "main"))
        head = pick(lambda: box("header", pick("", "masthead"), f"<p>{words(2)}</p>" + (links(3) if chance(0.5) else "")), lambda: box("div", "header", words(3)), lambda: "")()
        foot = pick(lambda: box("footer", "", f"&copy; {words(1)}.example &middot; {sentence()}"), lambda: box("footer", pick("", "site-footer"), f"<p>{sentence()}</p>" + (links(3) if chance(0.5) else "")), lambda: box("div", "footer", f"<p>&copy; 2020 {words(2)}</p>"), lambda: "")()
        before = "".join(boiler() for _ in range(int(rng.integers(0, 4))))
        after = ("" if inside else talk) + "".join(boiler() for _ in range(int(rng.integers(0, 3))))
        if chance(0.2):  # a short page: its article, and at most a notice
            main.clear()
            story = shape.replace("{}", (title() if chance(0.3) else "") + "".join(f"<p>{keep(prose(3))}</p>" for _ in range(int(rng.integers(1, 4))))).replace("{k}", "text")
            head = before = foot = ""
            after = f"<div><p>{notice()}</p></div>" if chance(0.4) else ""
        state = pick("", "", ' class="has-sidebar single-post"', ' class="no-comments"', ' class="comments-open page"', ' class="menu-open cookie-bar"')
        story = story.replace("<article", f'<article class="{pick("post no-comments", "hentry", "has-sidebar")}"', 1) if chance(0.2) and "<article>" in story else story
        yield f"<!DOCTYPE html><html><head><title>{words(3)}</title></head><body{state}>{head}{before}{story}{after}{foot}</body></html>", main


def labelled(page: str, main: list[str]) -> tuple[list[list[int]], list[int]]:
    """Features and labels: blocks that match the main text in order are main text."""
    blocks, labels, k = leaf_blocks(page), [], 0
    for b in blocks:
        hit = k < len(main) and b.text == " ".join(main[k].split())
        labels.append(int(hit))
        k += hit
    return features(blocks), labels


@lru_cache(2)
def default_model(pages: int = 600, seed: int = 11) -> Crf:
    """Trained on that many generated pages: a bound that doesn't grow with the table."""
    return train([labelled(*p) for p in sample_pages(pages, seed)])


def main_text(model: Crf, page: str | None) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, viterbi(model, features(blocks))) if y)


def extractor(model: Crf | None = None):
    """A vectorised UDF html -> main text (empty if none; null counts as empty)."""
    model = model or default_model()

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(model, p) for p in pages], dtype=object)

    return extract


def extract_main(pages: DataFrame, page: str = "html", keep: list[Column] | None = None, model: Crf | None = None) -> DataFrame:
    """One row per page: ``keep`` (default page_id and url), text and n_chars (code points).

    Null and empty pages, and pages without main text, have an empty text. Repeated pages get equal texts; further
    columns are ignored.
    """
    out = pages.select(*(keep or [F.col("page_id"), F.col("url")]), extractor(model)(F.col(page)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
