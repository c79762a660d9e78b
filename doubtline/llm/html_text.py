"""Main text of web pages: boosted trees over the nodes of a page, decoded so that no node contradicts its ancestors."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtline.llm.common import frame_batch, least_by_hash, map_batches

#: Pages that are learned from at most (the bound of the training sample).
TRAIN_PAGES, MOST_CHARS = 400, 200_000

# --- pages to nodes

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z!?/][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
#: Elements by their part in a page (fixed values of HTML): read over up to their end, or to the page's; read over if they
#: end within their container; inside a line; without an end tag.
RAW = frozenset("script style textarea title".split())
WIDGETS = frozenset("noscript template iframe svg select button object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q s samp small span strike strong sub sup time tt u var wbr".split())
MATHML = frozenset("mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle mspace semantics annotation".split())
#: A widget that reaches beyond the end of one of these isn't closed.
CONTAINER_END = re.compile(r"</(?:article|main|section|body|html|div|p|ul|ol|table|form)\b")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element ends an open one of these kinds, up to a container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}


@dataclass
class Page:
    """Nodes in page order: elements that make blocks, and the runs of text in them."""

    parent: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    inputs: list[int] = field(default_factory=list)


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    found = ["<" + tag]
    if "=" in attributes:
        for _, a, b, c in ATTRIBUTE.findall(attributes):
            found += TOKEN.findall((a or b or c).lower())
    return tuple(dict.fromkeys(found))


def _leaves(lower: str, start: int, end: int) -> bool:
    """If a piece of a page ends a container that it doesn't begin."""
    piece = lower[start:end]
    return any(piece.count("</" + name) > piece.count("<" + name) for name in {m[0][2:] for m in CONTAINER_END.finditer(piece)})


def parse(source: str) -> Page:
    """The nodes of a page; broken markup is read as browsers do in the usual cases (open paragraphs, items, ends without a start)."""
    page, lower = Page(), None
    stack: list[tuple[str, int]] = []
    line: list[str] = []
    linked, in_link = 0, False

    def node(tokens: tuple[str, ...], text: str | None, link_chars: int) -> int:
        page.parent.append(stack[-1][1] if stack else -1)
        page.tokens.append(tokens)
        page.text.append(text)
        page.linked.append(link_chars)
        page.inputs.append(0)
        return len(page.parent) - 1

    def flush() -> None:
        nonlocal linked
        if line:
            joined = "".join(line)
            text = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            line.clear()
            if text:
                node(("#text",), text, min(linked, len(text)))
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        line.append(text)
        if in_link:
            linked += len(text.strip())

    stack.append(("#root", node(("#root",), None, 0)))
    at = 0
    while found := TAG.search(source, at):
        if found.start() > at:
            put(source[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, end, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if tag in INLINE or tag in MATHML:
            if tag == "a":
                in_link = not end
            continue
        if tag == "br":
            line.append(" ")
            continue
        if tag in WIDGETS and end:
            continue
        if (tag in RAW or tag in WIDGETS) and not end:
            flush()
            if lower is None:
                lower = source.lower()
                if len(lower) != len(source):  # a few letters change their length
                    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), source)
            close = lower.find("</" + tag, at)
            if tag in WIDGETS:
                # one that isn't closed where it stands is a mere sign, and what follows is read
                if close >= 0 and not attributes.endswith("/") and lower.find("<" + tag, at, close) < 0 and not _leaves(lower, at, close):
                    at = close
            elif not attributes.endswith("/"):
                at = len(source) if close < 0 else close
            continue
        flush()
        if end:
            in_link = False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            if tag == "input":
                page.inputs[stack[-1][1]] += 1
            continue
        if stack[-1][0] == "p":
            stack.pop()
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in HOLDS[tag]:
                    break
        made = node(_tokens(tag, attributes), None, 0)
        if not attributes.endswith("/"):
            stack.append((tag, made))
    if at < len(source):
        put(source[at:])
    flush()
    return page


# --- nodes to features

FEATURES = (
    "depth", "children", "place", "place_from_end", "siblings", "texts", "log_chars", "log_own", "link_share", "tag_density", "words_per_text", "marks_per_word",
    "page_share", "parent_share", "log_before", "log_after", "digit_share", "sign_share", "inputs", "parent_link_share", "token_min", "token_max", "path_min", "path_max",
    "log_parent", "sibling_link_share", "letters_per_word", "is_text",
)


class Batch:
    """The nodes of several pages as arrays, page after page."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        first = np.cumsum([0, *sizes])
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.root = first[:-1][self.page]
        parent = np.concatenate([np.array(p.parent, np.int64) for p in pages])
        self.parent = np.where(parent < 0, -1, parent + self.root)
        self.tokens = [t for p in pages for t in p.tokens]
        self.text = [t for p in pages for t in p.text]
        self.linked = np.array([x for p in pages for x in p.linked], np.float64)
        self.inputs = np.array([x for p in pages for x in p.inputs], np.float64)
        n = len(self.parent)
        self.depth = np.zeros(n, np.int64)
        self.levels: list[np.ndarray] = [np.flatnonzero(self.parent < 0)]
        below = np.flatnonzero(self.parent >= 0)
        while len(below):
            inside = np.isin(self.parent[below], self.levels[-1])
            level, below = below[inside], below[~inside]
            self.depth[level] = len(self.levels)
            self.levels.append(level)

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = values.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(total, self.parent[level], total[level])
        return total

    def down(self, values: np.ndarray, fold) -> np.ndarray:
        """``fold`` of the values of a node and all above it."""
        out = values.astype(np.float64)
        for level in self.levels[1:]:
            out[level] = fold(out[level], out[self.parent[level]])
        return out


MARKS, SIGNS = re.compile(r"[.,;:!?…]"), re.compile(r"[©®™|»›•·→]")
DIGITS = re.compile(r"\d")


def features(batch: Batch, odds: dict[str, float]) -> np.ndarray:
    """What the trees see of each node: sums over its subtree, its place among its siblings, and the learned odds of its tag and attribute tokens."""
    n = len(batch.parent)
    parent = np.maximum(batch.parent, 0)
    texts = batch.text
    own = np.array([len(t) if t else 0 for t in texts], np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.float64)
    marks = np.array([len(MARKS.findall(t)) if t else 0 for t in texts], np.float64)
    signs = np.array([len(SIGNS.findall(t)) if t else 0 for t in texts], np.float64)
    digits = np.array([len(DIGITS.findall(t)) if t else 0 for t in texts], np.float64)
    is_text = (own > 0).astype(np.float64)
    chars, link, word, mark, sign, digit, count, tags, inputs = (batch.up(x) for x in (own, batch.linked, words, marks, signs, digits, is_text, np.ones(n), batch.inputs))
    children = np.bincount(batch.parent[batch.parent >= 0], minlength=n).astype(np.float64)
    # places among siblings: nodes in page order, grouped by parent
    order = np.argsort(batch.parent, kind="stable")
    start = np.concatenate([[True], batch.parent[order][1:] != batch.parent[order][:-1]])
    place = np.zeros(n)
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))
    siblings = children[parent]
    before, after = np.zeros(n), np.zeros(n)
    same = ~start[1:]
    before[order[1:][same]] = chars[order[:-1][same]]
    after[order[:-1][same]] = chars[order[1:][same]]
    value = lambda tokens, pick: pick((odds.get(t, 0.0) for t in tokens), default=0.0)
    low = np.array([value(t, min) for t in batch.tokens])
    high = np.array([value(t, max) for t in batch.tokens])
    # the odds of nodes above: the least and greatest from the page down, the root's own left out
    path_low, path_high = batch.down(low, np.minimum), batch.down(high, np.maximum)
    ratio = lambda a, b: a / np.maximum(b, 1)
    total = chars[batch.root]
    return np.stack([
        batch.depth, children, place, siblings - 1 - place, siblings, count, np.log1p(chars), np.log1p(own), ratio(link, chars), ratio(tags, chars), ratio(word, count), ratio(mark, word),
        ratio(chars, total), ratio(chars, chars[parent]), np.log1p(before), np.log1p(after), ratio(digit, chars), ratio(sign, chars), inputs, ratio(link[parent], chars[parent]), low, high, path_low, path_high,
        np.log1p(chars[parent]), ratio(link[parent] - link, chars[parent] - chars), ratio(chars, word), is_text,
    ], 1).astype(np.float32)


# --- boosted trees


@dataclass
class Trees:
    """Trees of one depth: for each inner node a feature and a bound, for each leaf a value."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows, depth = np.arange(len(x)), int(math.log2(self.leaf.shape[1]))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains over histograms of quantile bins."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = math.log(share / (1 - share))
    margin, inner = np.full(n, bias), 2**depth - 1
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, bound, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        cut = np.full(inner, bins + 1, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-3)
            local = at - first
            for j in range(m):
                if not len(cuts[j]):
                    continue
                size = len(cuts[j]) + 1
                cell = local * size + binned[:, j]
                gs = np.bincount(cell, g, width * size).reshape(width, size).cumsum(1)
                hs = np.bincount(cell, h, width * size).reshape(width, size).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1e-2) | (ht - hl < 1e-2)] = 0
                pick = gain.argmax(1)
                value = gain[np.arange(width), pick]
                better = value > best
                best[better] = value[better]
                where = first + np.flatnonzero(better)
                feature[where], cut[where], bound[where] = j, pick[better], cuts[j][pick[better]]
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
        leaf = -rate * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + ridge)
        margin += leaf[at - inner]
        trees.append((feature, bound.astype(np.float32), leaf))
    return Trees(*(np.stack(t) for t in zip(*trees, strict=True)), bias)


# --- pages to learn from

#: Words of tags and attributes that mark the article, and those that mark what isn't part of it.
MAIN = frozenset("<article <main articlebody".split())
ASIDE = frozenset("<nav <footer <aside <form <header ad ads advert sponsored nav navbar menu breadcrumb breadcrumbs footer sidebar widget related comment comments respond cookie consent notice banner popup newsletter subscribe share social pagination login search copyright promo".split())
#: Containers and surroundings put in place of or around the article of a page, so that the model sees more than one kind of page.
CONTAINERS = ("article", 'div class="content"', 'div id="main-content"', 'div class="post-body entry"', "main", 'section class="story"', "div")
AROUND = (
    '<header class="site-header"><div class="logo">{a}</div></header>', '<div class="menu"><a href="/a">{a}</a> <a href="/b">{b}</a> <a href="/c">{a}</a></div>', '<div class="breadcrumb"><a href="/">{a}</a> &rsaquo; <a href="/x">{b}</a></div>',
    '<aside class="sidebar"><h3>{a}</h3><ul><li><a href="/r">{b}</a></li><li><a href="/s">{c}</a></li></ul></aside>', '<div class="sidebar"><p>{c}</p><p>{d}</p></div>', '<aside><h4>{a}</h4><p>{d}</p></aside>',
    '<div class="cookie-notice"><p>{c}</p><button>{a}</button></div>', '<div id="notice" role="alert">{d}</div>', '<div class="ad">{c}</div>', '<div class="ads sponsored"><a href="/p">{c}</a></div>', '<section class="advert"><p>{d}</p></section>',
    '<section id="comments"><h2>{a}</h2><div class="comment"><p class="author">{a}</p><p>{d}</p></div><div class="comment"><p>{c}</p></div></section>', '<div class="comments"><ul><li><b>{a}</b>: {c}</li><li><b>{b}</b>: {d}</li></ul></div>',
    '<form action="/s"><label>{a}</label><input name="q"><p>{b}</p></form>', '<div class="newsletter"><form><p>{c}</p><input name="m"></form></div>', '<div class="related"><h3>{a}</h3><a href="/1">{c}</a><a href="/2">{b}</a></div>', '<div class="share"><a href="/f">{a}</a><a href="/t">{a}</a></div>',
    '<footer><p>&copy; {a} {b}</p></footer>', '<div class="footer"><p>&copy; {c}</p><a href="/i">{a}</a></div>', '<div id="copyright">&copy; {b}</div>',
)
ARTICLE = re.compile(r"<article\b[^>]*>(.*?)(</article>|\Z)", re.S | re.I)
SHELL = re.compile(r"<!DOCTYPE[^>]*>|</?(?:html|body)\b[^>]*>|<head\b.*?</head>", re.S | re.I)
MARK = "data-component=mainpart"
VARIANTS = 3


def variants(source: str, other: str, rng: np.random.Generator) -> list[str]:
    """A page with its article marked, once as it is and some times under another container with other surroundings.

    A page whose article isn't marked says nothing about what is one, and has no variants.
    """
    found = ARTICLE.search(source)
    if not found:
        return [source] if any(not MAIN.isdisjoint(t) for t in parse(source).tokens) else []
    made = [source[: found.start()] + f"<article {MARK}>" + source[found.start(1) :]]
    words = re.sub(r"<[^>]*>|&\w+;?", " ", other).split() or ["-"]

    def some(n: int) -> str:
        start = int(rng.integers(0, len(words)))
        return " ".join(words[start : start + n]) or "-"

    def piece() -> str:
        return AROUND[int(rng.integers(0, len(AROUND)))].format(a=some(2), b=some(4), c=some(int(rng.integers(5, 16))), d=some(int(rng.integers(15, 60))))

    for _ in range(VARIANTS):
        container = CONTAINERS[int(rng.integers(0, len(CONTAINERS)))]
        inside = found[1]
        if rng.random() < 0.4:  # something that isn't the article inside its container
            cut = inside.rfind("</p>")
            if cut >= 0:
                inside = inside[: cut + 4] + piece() + inside[cut + 4 :]
        if rng.random() < 0.4:  # headings of other levels, lists and quotes are parts of articles, too
            inside = re.sub(r"<(/?)h1\b", rf"<\1h{int(rng.integers(2, 4))}", inside)
        if rng.random() < 0.4:
            kind = ("<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<ol><li>{}</li></ol>", "<h3>{}</h3>")[int(rng.integers(0, 4))]
            inside = re.sub(r"<p>([^<]{1,300})</p>", lambda m: kind.format(m[1]), inside, count=2)
        body = f"<{container} {MARK}>{inside}</{container.split()[0]}>"
        before, after = ("".join(piece() for _ in range(int(rng.integers(0, 4)))) for _ in range(2))
        whole = source[: found.start()] + before + body + after + source[found.end() :]
        if rng.random() < 0.5:  # the usual elements by other names
            for tag, name in (("nav", "div"), ("footer", "div")):
                whole = re.sub(rf"<(/?){tag}\b", rf"<\1{name}", whole)
        if rng.random() < 0.4:  # a part of a page
            whole = SHELL.sub("", whole)
        made.append(whole)
    return made


def node_labels(batch: Batch) -> np.ndarray:
    """1 for nodes with article text in their subtree: text inside a marked container, and not in anything inside that by name isn't part of it."""
    inside = np.array([1.0 if "mainpart" in t or not MAIN.isdisjoint(t) else 0.0 for t in batch.tokens])
    aside = np.array([0.0 if "mainpart" in t or ASIDE.isdisjoint(t) else 1.0 for t in batch.tokens])
    main = (batch.down(inside, np.maximum) > 0) & (batch.down(aside, np.maximum) == 0)
    own = np.array([bool(t) for t in batch.text])
    return (batch.up(main & own) > 0).astype(np.float64)


@dataclass
class PageModel:
    odds: dict[str, float]
    trees: Trees


def fit(sources: list[str], seed: int = 5) -> PageModel:
    """Token odds and trees from pages with a marked article; others teach nothing."""
    rng = np.random.default_rng(seed)
    pages = [parse(v) for i, s in enumerate(sources) for v in variants(s, sources[i - 1], rng)]
    batch = Batch(pages or [parse("")])
    y = node_labels(batch)
    counts: dict[str, list[float]] = {}
    for tokens, label in zip(batch.tokens, y.tolist(), strict=True):
        for t in tokens:
            if t != "mainpart":
                c = counts.setdefault(t, [0.0, 0.0])
                c[int(label)] += 1
    odds = {t: math.log((c[1] + 1) / (c[0] + 1)) for t, c in counts.items() if sum(c) >= 5}
    return PageModel(odds, boost(features(batch, odds), y))


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> PageModel:
    """The model from at most ``most`` pages of at most ``MOST_CHARS`` characters, chosen by hash; only these reach the driver."""
    known = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).filter(F.length("html").between(1, MOST_CHARS))
    chosen = least_by_hash(known, most, F.col("page_id"), F.col("url"), F.col("html"), seed="pages")
    return fit(sorted(r.html for r in chosen.select("html").collect()))


# --- decoding


def decode(batch: Batch, log_odds: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes in which nothing is kept below a node that isn't: from the leaves up, then from the roots down."""
    keep = -np.logaddexp(0, -log_odds)  # log p
    drop = -np.logaddexp(0, log_odds)
    none, best = batch.up(drop), keep.copy()  # best: of a kept node, with the better choice for each child
    for level in batch.levels[:0:-1]:
        np.add.at(best, batch.parent[level], np.maximum(best[level], none[level]))
    kept = best >= none
    for level in batch.levels[1:]:
        kept[level] &= kept[batch.parent[level]]
    return kept


def extract_pages(sources: list[str | None], model: PageModel) -> list[str]:
    """The main text of each page: its kept blocks in page order, joined by one space."""
    pages = [parse(s or "") for s in sources]
    batch = Batch(pages)
    kept = decode(batch, model.trees.log_odds(features(batch, model.odds)))
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(kept).tolist():
        if batch.text[i]:
            out[batch.page[i]].append(batch.text[i])
    return [" ".join(x) for x in out]


def extract(pages: DataFrame, model: PageModel) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``, from its whole html; no shuffle.

    A null or empty page, and one without any article, has an empty text. Null ids and urls stay null; repeated rows are all
    returned; further columns are ignored. White space is what Python's ``str.split`` splits at.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract_pages(batch.column("html").to_pylist(), model)
        return frame_batch(schema, page_id=batch.column("page_id"), url=batch.column("url"), text=texts, n_chars=[len(t) for t in texts])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(slim, run, "page_id long, url string, text string, n_chars long")
