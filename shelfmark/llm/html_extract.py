"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text below the same block-level elements.  Features
of a block are its ancestors' tags and class words, and measures of its text; a transition
ties it to the block before.  Weights are learned in numpy by stochastic gradients on labelled
pages, and a page is decoded by Viterbi.

No labels are given for ``pages``, so the query learns from pages of known labels that are
composed of a bounded sample's texts: articles and the usual surroundings in the markup that
sites use.  ``fit`` takes any labelled pages.

Defined results: NULL, empty and textless html gives empty text; repeated rows give the same
text; over an empty table the weights come from stock phrases.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import per_text

# Elements by what they do to text.
RAW = frozenset("script style iframe textarea title head".split())
DROPPED = frozenset("svg object canvas noscript template annotation annotation-xml".split())
INLINE = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SURROUNDING_CUES = ("advert", "banner", "breadcrumb", "comment", "consent", "cookie", "copyright", "disclaim", "foot", "form", "gdpr", "hdr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "newsletter", "notice", "pager", "pagination", "popup", "promo", "recommend", "related", "repl", "share", "sidebar", "signup", "social", "sponsor", "subscri", "tags", "toolbar", "widget")
AD_WORDS = frozenset(("ad", "ads", "adv", "advert", "side", "rail", "dsq"))
CONTENT_CUES = ("article", "content", "entry", "main", "post", "story", "text", "body")
TEXT_CUES = ("©", "cookie", "subscribe", "newsletter", "sign up", "log in", "all rights reserved", "read more", "share", "advertisement", "privacy", "terms", "reply", "sponsored", "|", "·")

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?/][^>]*>", re.DOTALL)
_BLOCK = re.compile(rf"<(?:{'|'.join(sorted(CLOSES_P | {'li', 'dd', 'dt', 'tr', 'td', 'th', 'body'}))})(?=[\s/>])", re.IGNORECASE)
_NOT_DRAWN = re.compile(r"<foreignobject\b", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Settings:
    sample: int = 300  # bound of the pages whose texts the labelled pages are made of
    pages: int = 700
    epochs: int = 8
    rate: float = 0.3
    l2: float = 1e-4
    seed: int = 3


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # element names with their class words, outermost first
    links: float  # share of characters inside links
    label: int = 0


@lru_cache(maxsize=4096)
def _element(name: str, attributes: str) -> str:
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME_WORD.findall((m[2] or m[3] or m[4] or "").lower())]
    return " ".join([name, *dict.fromkeys(words)])


class _Reader:
    """Collects leaf blocks while tags go by."""

    def __init__(self) -> None:
        self.stack: list[str] = []  # names
        self.path: list[str] = []  # names with class words
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, False
        self.blocks: list[Block] = []

    def text(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            self.pieces.append(piece)
            if self.in_link:
                self.linked += len(piece.strip())

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, tuple(self.path), min(1.0, self.linked / len(text))))
            self.pieces = []
        self.linked = 0

    def open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P and "p" in self.stack:
            self._close("p", ("table", "td", "li", "blockquote", "div", "article", "section", "button"))
        if name in SIBLINGS:
            names, within = SIBLINGS[name]
            for other in names.split():
                self._close(other, within)
        self.stack.append(name)
        self.path.append(_element(name, attributes))

    def _close(self, name: str, within: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == name:
                del self.stack[k:], self.path[k:]
                return
            if self.stack[k] in within:
                return

    def close(self, name: str) -> None:
        if name in self.stack:
            k = len(self.stack) - 1 - self.stack[::-1].index(name)
            del self.stack[k:], self.path[k:]


class _Ends:
    """Where elements end whose content is passed over."""

    def __init__(self, page: str):
        self.page = page
        self.next: dict[str, tuple[int, int]] = {}  # the nearest end tag looked up; none: the page's length

    def tag(self, name: str, at: int) -> tuple[int, int]:
        """The next end tag: where it begins and ends."""
        known = self.next.get(name)
        if known is None or known[0] < at:
            m = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(self.page, at)
            known = self.next[name] = m.span() if m else (len(self.page), len(self.page))
        return known

    def dropped(self, name: str, at: int) -> int:
        """The end of a dropped element: its end tag, or the next block without one; a block ends a drawing as well."""
        start, end = self.tag(name, at)
        if start < len(self.page) and name != "svg":
            return end
        block = _BLOCK.search(self.page, at, start)
        if block is None:
            return end
        if start < len(self.page) and _NOT_DRAWN.search(self.page, at, block.start()):
            return end
        return block.start()


def read_blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order, character references decoded.

    Formulas are read as text of their block.  Drawings and what stands in for missing abilities are
    passed over without splitting it; without an end tag they reach to the next block.
    """
    page, reader, at = page or "", _Reader(), 0
    ends = _Ends(page)
    while True:
        m = _TAG.search(page, at)
        if m is None:
            reader.text(page[at:])
            break
        reader.text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], (m[3] or m[6] or "")
        if name == "br":
            reader.pieces.append(" ")
        elif name == "a":
            reader.in_link = not closing
        elif name in RAW:
            if not closing and not attributes.endswith("/"):
                start, end = ends.tag(name, at)
                if start < len(page) or name != "head":  # a head that never ends is read like the body
                    at = end
                reader.flush()
        elif name in DROPPED:
            if not closing and not attributes.endswith("/"):
                at = ends.dropped(name, at)
        elif name not in INLINE:
            reader.flush()
            if closing:
                reader.close(name)
                reader.in_link = False
            elif name not in VOID:
                reader.open(name, attributes)
    reader.flush()
    return reader.blocks


# -- features --------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def _path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found = {}
    for element in path:
        name, *words = element.split(" ")
        found[f"within {name}"] = None
        for w in words:
            found[f"class {w}"] = None
            if w in AD_WORDS:
                found["surrounding ad"] = found["surrounding"] = None
            for cue in SURROUNDING_CUES:
                if cue in w:
                    found[f"surrounding {cue}"] = found["surrounding"] = None
            for cue in CONTENT_CUES:
                if cue in w:
                    found[f"content {cue}"] = None
    last = path[-1].split(" ")[0] if path else "none"
    found[f"leaf {last}"] = None
    found[f"leaf {last} of {path[-2].split(' ')[0] if len(path) > 1 else 'none'}"] = None
    return tuple(found)


def _step(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def features(blocks: list[Block], k: int) -> list[str]:
    b = blocks[k]
    low, words = b.text.lower(), b.text.count(" ") + 1
    found = [
        *_path_features(b.path),
        f"words {_step(words, (2, 4, 8, 15, 30, 60, 120))}",
        f"links {_step(b.links, (0.01, 0.2, 0.5, 0.9))}",
        f"stops {_step((low.count('.') + low.count('!') + low.count('?')) / words, (0.01, 0.05, 0.1, 0.3))}",
        f"commas {_step(low.count(',') / words, (0.01, 0.05, 0.1))}",
        f"ends {b.text[-1] if b.text[-1] in '.!?:,|' else 'else'}",
        f"upper {b.text[0].isupper()}",
        f"place {_step(k / len(blocks), (0.05, 0.15, 0.5, 0.85, 0.95))}",
        "first" if k == 0 else "last" if k == len(blocks) - 1 else "inner",
        "always",
    ]
    found += [f"says {cue}" for cue in TEXT_CUES if cue in low]
    if k:
        found.append(f"same parent {blocks[k - 1].path[:-1] == b.path[:-1]}")
    return found


# -- the field -------------------------------------------------------------------------------


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # for main text, against surroundings
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def emissions(self, blocks: list[Block]) -> np.ndarray:
        weight = self.weights.get
        return np.array([[0.0, sum(weight(f, 0.0) for f in features(blocks, k))] for k in range(len(blocks))])


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The likeliest labels of a chain; of equals surroundings."""
    best, back = emissions[0].tolist(), []
    (t00, t01), (t10, t11) = transitions.tolist()
    for e0, e1 in emissions[1:].tolist():
        zero, one = (best[0] + t00, best[1] + t10), (best[0] + t01, best[1] + t11)
        back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
        best = [max(zero) + e0, max(one) + e1]
    labels = [int(best[1] > best[0])]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def _marginals(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels, and of label pairs summed over the chain, by forward and backward passes."""
    n = len(emissions)
    e, t = np.exp(emissions - emissions.max(axis=1, keepdims=True)), np.exp(transitions)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    forward[0] = e[0] / e[0].sum()
    for k in range(1, n):
        f = (forward[k - 1] @ t) * e[k]
        forward[k] = f / f.sum()
    pairs = np.zeros((2, 2))
    for k in range(n - 2, -1, -1):
        b = t @ (e[k + 1] * backward[k + 1])
        joint = forward[k][:, None] * t * (e[k + 1] * backward[k + 1])[None, :]
        pairs += joint / joint.sum()
        backward[k] = b / b.sum()
    p = forward * backward
    return p / p.sum(axis=1, keepdims=True), pairs


def fit(pages: list[list[Block]], settings: Settings = Settings()) -> Model:
    """Learn from pages of labelled blocks: gradients of the log likelihood, a rate for each weight (Adagrad)."""
    names: dict[str, int] = {}
    coded = []
    for blocks in pages:
        if blocks:
            rows = [[names.setdefault(f, len(names)) for f in features(blocks, k)] for k in range(len(blocks))]
            coded.append((rows, np.array([b.label for b in blocks])))
    w, seen = np.zeros(len(names)), np.full(len(names), 1.0)
    t, seen_t = np.zeros((2, 2)), np.full((2, 2), 1.0)
    rng = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for k in rng.permutation(len(coded)):
            rows, y = coded[k]
            emissions = np.array([[0.0, w[r].sum()] for r in rows])
            p, pairs = _marginals(emissions, t)
            for r, slope in zip(rows, y - p[:, 1]):
                g = slope - settings.l2 * w[r]
                seen[r] += slope * slope
                w[r] += settings.rate * g / np.sqrt(seen[r])
            observed = np.zeros((2, 2))
            np.add.at(observed, (y[:-1], y[1:]), 1)
            g = observed - pairs - settings.l2 * t
            seen_t += g * g
            t += settings.rate * g / np.sqrt(seen_t)
    return Model({f: float(w[k]) for f, k in names.items()}, t)


def extract(model: Model, page: str | None) -> str:
    blocks = read_blocks(page)
    if not blocks:
        return ""
    labels = viterbi(model.emissions(blocks), model.transitions)
    return "\n\n".join(b.text for b, label in zip(blocks, labels) if label)


# -- labelled pages --------------------------------------------------------------------------

_STOCK = ("It was a quiet morning, and nobody had expected the news. By noon the whole town knew.", "The report lists three causes, of which the second is the least understood.", "Readers may ask why this took so long.", "A short walk from the station leads to the old harbour, where boats still leave at dawn.")
_MENU = ("Home", "About", "Contact", "News", "Sports", "Archive", "Login", "Help", "Shop", "Search")
_CONTENT = (
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<main><article class='post'>", "</article></main>"),
    ('<div class="content">', "</div>"),
    ('<div id="main-content"><div class="article-body">', "</div></div>"),
    ('<section class="entry-content">', "</section>"),
    ('<div class="post"><div class="story">', "</div></div>"),
    ('<div class="container"><div class="col">', "</div></div>"),
)
_SURROUNDINGS = (
    ("<nav><ul>", "<li><a href='/{k}'>{w}</a></li>", "</ul></nav>", "words"),
    ('<div class="menu">', "<a href='/{k}'>{w}</a> ", "</div>", "words"),
    ('<ul class="nav-list">', "<li><a href='#'>{w}</a>", "</ul>", "words"),
    ("<header>", "<div>{s}</div>", "</header>", "one"),
    ('<div class="header"><h2>', "{w} ", "</h2></div>", "words"),
    ('<div class="ad">', "{s}", "</div>", "one"),
    ('<div class="advert banner"><p>', "{s}", "</p></div>", "one"),
    ('<div id="sponsored">', "<p>{s}</p>", "</div>", "some"),
    ("<aside>", "<p>{s}</p>", "</aside>", "some"),
    ('<div class="sidebar"><h3>Related</h3><ul>', "<li><a href='/{k}'>{s}</a></li>", "</ul></div>", "some"),
    ('<div class="related">', "<a href='/{k}'>{s}</a><br>", "</div>", "some"),
    ('<div class="cookie-notice"><p>', "{s}", "</p><button>OK</button></div>", "one"),
    ('<div class="notice">', "{s}", "</div>", "one"),
    ('<div id="consent" role="dialog">', "<p>We use cookies. {s}</p>", "</div>", "one"),
    ("<form action='/s'>", "<label>{w}</label><input name=q><select><option>{w}</select>", "<button>Go</button></form>", "words"),
    ('<div class="newsletter"><form>', "<p>{s}</p>", "<input type=email></form></div>", "one"),
    ("<div>", "<a href='/{k}'>{w}</a> ", "</div>", "words"),
    ("<table><tr>", "<td><a href='/{k}'>{w}</a></td>", "</tr></table>", "words"),
    ('<div id="hdr">', "<h1><a href='/'>{w}</a></h1>", "<p>{w}</p></div>".replace("{w}", "Daily"), "one"),
    ('<div class="share">', "<a href='#'>{w}</a>", "</div>", "words"),
    ('<div class="breadcrumb">', "<a href='/{k}'>{w}</a> &raquo; ", "</div>", "words"),
)
_AFTER = (
    ('<section id="comments"><h3>Comments</h3>', '<div class="comment"><p>{s}</p></div>', "</section>", "some"),
    ('<div class="comments"><ol>', "<li class='comment'><b>{w}</b><p>{s}</p><a href='#'>Reply</a></li>", "</ol></div>", "some"),
    ('<div id="disqus_thread">', "<div class='reply'>{s}</div>", "</div>", "some"),
    ('<ul class="comment-list">', "<li>{s}</li>", "</ul>", "some"),
    ("<footer>", "&copy; {w}.example.net &middot; {s}", "</footer>", "one"),
    ("<footer>", "<p>{s}</p><p>&copy; 2024 {w}</p>", "</footer>", "one"),
    ('<div class="footer">', "<a href='/{k}'>{w}</a> | ", "All rights reserved.</div>", "words"),
    ('<div id="foot">', "{s}", "</div>", "one"),
    ('<div class="legal"><small>', "{s}", "</small></div>", "one"),
)


def labelled_pages(texts: list[str], settings: Settings = Settings()) -> list[list[Block]]:
    """Pages composed of the given texts, with the label of every block.

    Marks that no text holds bracket what is main text; they are removed after reading.
    """
    r = random.Random(settings.seed)
    texts = [t for t in texts if t] or list(_STOCK)
    names = sorted({w.strip(".,|") for t in texts[:200] for w in t.split()[:30]} - {""}) or list(_MENU)
    mark = "\ue000"

    def some(words: int) -> str:
        text = r.choice(texts).split()
        at = r.randrange(max(1, len(text) - words))
        return html.escape(" ".join(text[at : at + words]), quote=False)

    def around(parts: tuple[str, str, str, str]) -> str:
        before, each, after, many = parts
        n = {"one": 1, "some": r.randrange(1, 5), "words": r.randrange(2, 8)}[many]
        fill = lambda: each.format(k=r.randrange(99), w=r.choice(names if r.random() < 0.6 else _MENU), s=some(r.choice((3, 6, 10, 20, 40))))
        return before + "".join(fill() for _ in range(n)) + after

    def article() -> str:
        parts = []
        if r.random() < 0.8:
            level = r.choice(("h1", "h1", "h2"))
            heading = f"<{level}>{mark}{some(r.randrange(2, 12))}</{level}>"
            parts.append(f"<header>{heading}</header>" if r.random() < 0.15 else heading)
        for _ in range(r.randrange(1, 12)):
            size = r.choice((1, 1, 2, 4, 8, 15, 30, 60, 120, 200))
            form = r.random()
            if form < 0.5:
                parts.append(f"<p>{mark}{some(size)}" + r.choice(("</p>", "</p>", "")))
            elif form < 0.7:
                parts.append(f"<p><b>{mark}{some(size)}<br>" + r.choice(("", "</b></p>")))
            elif form < 0.76:
                parts.append(f"<h3>{mark}{some(r.randrange(1, 8))}</h3>")
            elif form < 0.82:
                parts.append("<ul>" + "".join(f"<li>{mark}{some(r.randrange(2, 20))}</li>" for _ in range(r.randrange(2, 5))) + "</ul>")
            elif form < 0.86:
                parts.append(f"<blockquote>{mark}{some(size)}</blockquote>")
            elif form < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{mark}{some(2)}<td>{mark}{some(3)}</tr>" for _ in range(2)) + "</table>")
            elif form < 0.94:
                parts.append(f"<p>{mark}{some(size)} <a href='/x'>{some(3)}</a> {some(size)}</p>")
            elif form < 0.97:
                parts.append(f"<div>{mark}{some(size)}</div>")
            else:
                parts.append(around(r.choice(_SURROUNDINGS)))
        return "".join(parts)

    pages = []
    for _ in range(settings.pages):
        before, after = r.choice(_CONTENT)
        inside = article()
        comments = around(r.choice(_AFTER[:4])) if r.random() < 0.3 else ""
        if r.random() < 0.4:
            inside, comments = inside + comments, ""
        body = "".join(around(s) for s in r.sample(_SURROUNDINGS, r.randrange(1, 5))) + before + inside + after + comments
        body += "".join(around(s) for s in r.sample(_SURROUNDINGS, r.randrange(0, 3))) + around(r.choice(_AFTER[4:])) * (r.random() < 0.9)
        blocks = read_blocks(f"<html><head><title>{some(5)}</title></head><body>{body}" + r.choice(("</body></html>", "")))
        for b in blocks:
            b.label = int(mark in b.text)
            b.text = b.text.replace(mark, "")
        pages.append([b for b in blocks if b.text])
    return pages


# -- over pages ------------------------------------------------------------------------------


def fit_on(pages: DataFrame, settings: Settings = Settings()) -> Model:
    """Weights from pages composed of the texts of at most ``settings.sample`` pages, chosen by hash."""
    share = min(1.0, 2.0 * settings.sample / max(1, pages.count()))
    place = F.xxhash64("html")
    rows = pages.select("html").filter(F.col("html").isNotNull() & (F.pmod(place, F.lit(1 << 24)) < share * (1 << 24))).distinct()
    texts = [b.text for row in rows.orderBy(place, "html").limit(settings.sample).collect() for b in read_blocks(row["html"])]
    return fit(labelled_pages(texts, settings), settings)


def main_text(pages: DataFrame, model: Model, column: str = "html") -> Column:
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda page: extract(known, page)

    return per_text(make, pa.string(), F.col(column))


def extract_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = fit_on(pages, settings)
    rows = pages.select("page_id", "url", "html")
    return rows.select("page_id", "url", main_text(rows, model).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
