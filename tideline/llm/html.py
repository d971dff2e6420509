"""Main text of HTML pages by a tree-structured graphical model.

The page's elements form a tree. Each has a binary state: its subtree holds content or it doesn't. A
logistic model of the element (tag, words of its class, id and role, text and link measures) gives its
own potential, and the states of parent and child have a potential of their own. Messages are summed
from the leaves to the root and back, which gives every element's exact marginal; text belongs to the
page's content where its element's marginal is a half or more. Both potentials are estimated from
labelled pages.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import slices, table
from tideline.llm.html_pages import labelled_pages

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: One attribute with its value, so that what stands in another's value is never taken for one.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMING = frozenset("class id role".split())
_LABEL = "data-y"
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown as text, whatever the model thinks of what is around it.
_UNSEEN = frozenset("script style noscript template iframe object svg math canvas head title textarea select option datalist audio video".split())
_RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "iframe", "title", "textarea", "svg", "math", "xmp", "noembed", "noframes")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag of an inline element reaches no further than these.
_SCOPE = ("td", "th", "table", "body")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br button".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul search".split())
#: A start tag closes an open element of the same row, up to the elements named last.
_SAME = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_GROUPS = [frozenset(g.split()) for g in ("article main", "section", "p blockquote pre figure figcaption", "h1 h2 h3 h4 h5 h6", "div", "nav menu", "header", "footer", "aside dialog", "form fieldset button label input legend", "ul ol dl", "li dt dd", "table tbody tr td th thead tfoot", "body html")]
_LEXICON = [
    frozenset(g.split())
    for g in (
        "nav navbar navigation menu topbar toolbar breadcrumb breadcrumbs pagination pager",
        "header masthead",
        "footer bottom copyright legal disclaimer",
        "sidebar side aside widget related recommended popular trending tags share social",
        "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion slot",
        "cookie cookies notice consent gdpr alert popup modal newsletter subscribe signup message overlay",
        "comment comments reply replies responses discussion respond disqus",
        "login search form contact",
        "article content main post entry story body text page wrapper container",
    )
]
N_FEATURES = len(_GROUPS) + len(_LEXICON) + 6


@dataclass
class Page:
    """Elements in document order, 0 the root, and text runs with the block each belongs to."""

    parent: list[int]
    tag: list[str]
    words: list[list[str]]
    label: list[int | None]
    runs: list[tuple[int, int, str]]  # (block, element, text)
    chars: list[int]
    link_chars: list[int]


class _Open:
    """The open elements. Elements are numbered in document order, so those of a name are in ascending
    order, and every question is answered from the ends of lists, however deep the page is nested."""

    def __init__(self, tag: list[str]):
        self.tag = tag
        self.stack = [0]
        self.gone: set[int] = set()
        self.by_name: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]

    @property
    def top(self) -> int:
        return self.stack[-1]

    def last(self, *names: str) -> int:
        """The innermost open element of these names, 0 if there is none but the root."""
        return max((held[-1] for name in names if (held := self.by_name.get(name))), default=0)

    def push(self, k: int) -> None:
        name = self.tag[k]
        self.stack.append(k)
        self.by_name.setdefault(name, []).append(k)
        if name not in _INLINE:
            self.blocks.append(k)

    def close_from(self, k: int) -> int:
        """Closes k and what is open within it; the number of blocks among them."""
        n = len(self.blocks)
        while self.stack[-1] >= k:
            e = self.stack.pop()
            if e in self.gone:
                self.gone.discard(e)
                continue
            self.by_name[self.tag[e]].pop()
            if self.tag[e] not in _INLINE:
                self.blocks.pop()
        self._clean()
        return n - len(self.blocks)

    def take_out(self, k: int) -> None:
        """Closes the innermost inline element of its name alone; what was opened after it stays open."""
        self.by_name[self.tag[k]].pop()
        self.gone.add(k)
        self._clean()

    def _clean(self) -> None:
        while self.stack[-1] in self.gone:
            self.gone.discard(self.stack.pop())


def _named(raw: str, labelled: bool) -> tuple[list[str], int | None]:
    """The words of an element's naming attributes, and its label on pages made for training."""
    words, label = [], None
    for a in _ATTR.finditer(raw):
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name in _NAMING:
            words += [w for w in _SPLIT.split(value.lower()) if w]
        elif labelled and name == _LABEL:
            label = int(value)
    return words, label


def parse(source: str, labelled: bool = False) -> Page:
    """Labels are only read from pages that are said to be labelled; elsewhere the attribute means nothing."""
    page = Page([-1], ["html"], [[]], [None], [], [0], [0])
    open_ = _Open(page.tag)
    block, no_head_end = 0, False

    def text(raw: str) -> None:
        if not raw:
            return
        got = html.unescape(raw)
        at = open_.top
        if got.strip():
            n = len(got) - got.count(" ")
            page.chars[at] += n
            if open_.by_name.get("a"):
                page.link_chars[at] += n
        page.runs.append((block, at, got))

    at, unseen = 0, len(source)
    while at < unseen:
        cut = source.find("<", at)
        if cut < 0:
            text(source[at:])
            break
        m = _TOKEN.match(source, cut)
        if m is None:  # a sign that opens no tag
            text(source[at : cut + 1])
            at = cut + 1
            continue
        text(source[at:cut])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            k = open_.last(name)
            if not k or name in _INLINE and open_.last(*_SCOPE) > k:
                continue
            if name in _INLINE and open_.blocks[-1] > k:
                open_.take_out(k)
            else:
                block += open_.close_from(k)
            continue
        if name == "br":
            text(" ")
            continue
        if name in _VOID:
            block += name == "hr"
            continue
        if name in _RAW and name in _UNSEEN:
            end = _RAW[name].search(source, at)
            at = end.end() if end else len(source)
            continue
        words, label = _named(m[3] or m[6] or "", labelled)
        if name in ("html", "body") and open_.by_name.get(name):
            page.label[0] = page.label[0] if label is None else label
            continue
        if name == "head":
            end = None if no_head_end else _HEAD_END.search(source, at)
            no_head_end = end is None
            at = end.start() if end else at
            continue
        if name in _ENDS_P and page.tag[open_.blocks[-1]] == "p":
            block += open_.close_from(open_.blocks[-1])
        if name in _SAME:
            same, until = _SAME[name]
            low = open_.last(*until)
            inside = [held[k] for s in same if (held := open_.by_name.get(s)) and (k := bisect.bisect_right(held, low)) < len(held)]
            if inside:
                block += open_.close_from(min(inside))
        if name in _HEADINGS and page.tag[open_.top] in _HEADINGS:
            block += open_.close_from(open_.top)
        page.parent.append(open_.top)
        page.tag.append(name)
        page.words.append(words)
        page.label.append(label)
        page.chars.append(0)
        page.link_chars.append(0)
        if (m[3] or m[6] or "").rstrip().endswith("/") and name in _UNSEEN:
            continue
        open_.push(len(page.tag) - 1)
        block += name not in _INLINE
    return page


def _plain(page: Page, k: int) -> bool:
    """Inline elements without words of their own are part of their block."""
    return page.tag[k] in _INLINE and not page.words[k]


@lru_cache(1 << 14)
def _fixed(tag: str, words: tuple[str, ...]) -> tuple[int, ...]:
    found = [k for k, g in enumerate(_GROUPS) if tag in g]
    return (*found, *(len(_GROUPS) + k for k, g in enumerate(_LEXICON) if not g.isdisjoint(words)))


def features(page: Page) -> tuple[list[int], list[int], np.ndarray]:
    """Elements of the model, the place of each one's parent among them, and their features."""
    n = len(page.tag)
    total, linked, count = list(page.chars), list(page.link_chars), [1] * n
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        total[p] += total[k]
        linked[p] += linked[k]
        count[p] += count[k]
    place: list[int] = [0] * n
    nodes: list[int] = []
    parents: list[int] = []
    for k in range(n):
        if k and _plain(page, k):
            place[k] = place[page.parent[k]]
        else:
            place[k] = len(nodes)
            parents.append(place[page.parent[k]] if k else -1)
            nodes.append(k)
    x = np.zeros((len(nodes), N_FEATURES))
    base = len(_GROUPS) + len(_LEXICON)
    whole = max(total[0], 1)
    for r, k in enumerate(nodes):
        for f in _fixed(page.tag[k], tuple(page.words[k])):
            x[r, f] = 1
        share = linked[k] / total[k] if total[k] else 0.0
        x[r, base:] = (1, math.log1p(total[k]), share, total[k] / whole, math.log1p(total[k] / count[k]), share * math.log1p(total[k]))
    page.place = place  # type: ignore[attr-defined]
    return nodes, parents, x


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    pair: tuple[tuple[float, float], tuple[float, float]]  # log potential by state of parent and child
    prior: tuple[float, float]

    def marginals(self, x: np.ndarray, parents: list[int]) -> list[float]:
        """The probability of content of every element."""
        logit = ((x - self.mean) / self.scale @ self.weights).tolist()
        n = len(parents)
        own = [(0.0, v) for v in logit]
        up = [[0.0, 0.0] for _ in range(n)]  # product of the messages from the children
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        (p00, p01), (p10, p11) = self.pair
        for k in range(n - 1, 0, -1):
            a, b = own[k][0] + up[k][0], own[k][1] + up[k][1]
            m0, m1 = _add(p00 + a, p01 + b), _add(p10 + a, p11 + b)
            z = max(m0, m1)
            sent[k] = (m0 - z, m1 - z)
            u = up[parents[k]]
            u[0] += m0 - z
            u[1] += m1 - z
        down = [(0.0, 0.0)] * n
        out = [0.0] * n
        for k in range(n):
            if k:
                p = parents[k]
                a = own[p][0] + up[p][0] - sent[k][0] + down[p][0]
                b = own[p][1] + up[p][1] - sent[k][1] + down[p][1]
                m0, m1 = _add(p00 + a, p10 + b), _add(p01 + a, p11 + b)
                z = max(m0, m1)
                down[k] = (m0 - z, m1 - z)
            d = own[k][1] + up[k][1] + down[k][1] - own[k][0] - up[k][0] - down[k][0]
            out[k] = 1 / (1 + math.exp(-max(-700.0, min(700.0, d))))
        return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def train(pages: list[str], ridge: float = 1.0, steps: int = 40) -> Model:
    """From pages whose elements carry their label in ``data-y``; elements without one have their parent's."""
    xs, ys = [], []
    pair = np.ones((2, 2)) * 0.05
    for source in pages:
        page = parse(source, labelled=True)
        nodes, parents, x = features(page)
        y: list[int] = []
        for r, k in enumerate(nodes):
            y.append(page.label[k] if page.label[k] is not None else y[parents[r]] if r else 1)
            if r:
                pair[y[parents[r]], y[r]] += 1
        xs.append(x)
        ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    flat = scale == 0
    mean[flat], scale[flat] = 0, 1
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    child = pair.sum(axis=0) / pair.sum()
    log = np.log(pair / pair.sum(axis=1, keepdims=True)) - np.log(child)
    return Model(w, mean, scale, tuple(map(tuple, log.tolist())), tuple(child.tolist()))


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(source: str | None, model: Model | None = None) -> str:
    """Blocks of content in page order, one a line, white space within a block as single spaces."""
    if not source:
        return ""
    page = parse(source)
    _, parents, x = features(page)
    content = (model or default_model()).marginals(x, parents)
    place = page.place  # type: ignore[attr-defined]
    blocks: list[list] = []
    for block, element, text in page.runs:
        if content[place[element]] >= 0.5:
            if blocks and blocks[-1][0] == block:
                blocks[-1][1].append(text)
            else:
                blocks.append([block, [text]])
    lines = (" ".join("".join(parts).split()) for _, parts in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """``pages`` without their HTML but with ``text`` and ``n_chars`` (its code points) added (or replaced).

    A null or empty page, and one without content, has an empty text. Broken markup is read as it
    comes: a page that ends within a tag loses that tag. Repeated rows give equal texts, pages of any
    size are read whole, an empty table gives no rows and other columns pass through. Without a model
    the one from the labelled pages of this package is used.
    """
    model = model or default_model()
    own = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    schema = T.StructType([*(pages.schema[c] for c in own), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, (len(own),), 1 << 20):
            at = batch.schema.get_field_index
            texts = [main_text(h, model) for h in batch.column(at(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in schema])

    return pages.select(*(F.col(f"`{c}`") for c in [*own, html_col])).mapInArrow(run, schema)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: For the pages of these tables: what stands between the tags of the article, cut at paragraphs and
#: headings; they hold no other references than these.
OP6_SQL = r"""
WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS b FROM pages),
blocks AS (SELECT page_id, url, string_split_regex(replace(b, '<br>', ' '), '</?(p|h[1-6])>') AS parts FROM body),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"', 'g'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS parts FROM blocks),
texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
