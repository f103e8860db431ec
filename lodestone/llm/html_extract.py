"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, text_chunks

#: Pages from which the classifier learns (smallest id hashes).
SAMPLE_PAGES = 400
#: Weight of the edges between neighbouring blocks and between blocks of one parent.
NEAR, SIBLING = 0.8, 0.6

# Element names by their role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "optgroup", "legend", "summary"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "menu", "dl", "table", "article", "main", "section", "aside", "nav", "footer", "header", "form", "div", "body", "html", "blockquote", "td", "th", "figure"}
PLAIN = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "legend", "label"}
MAIN = {"article", "main"}
# Words of class, id and role attributes that tell boilerplate or content.
BOILER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "adsbygoogle", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toc", "toolbar", "widget"}
MAIN_WORDS = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}

TOKEN = r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"""
ATTRIBUTE = r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
#: Features of a block, and the weights for boilerplate (negative) or content (positive) from which learning starts.
FEATURES = ("bias", "in_main", "in_boiler", "log_chars", "link_share", "sentence_ends", "paragraph", "heading", "list_item")
PRIOR = (-0.5, 3.0, -6.0, 0.25, -2.5, 0.2, 0.6, 0.3, -0.6)


def _hint(tag: str, attributes: str, inside: int) -> int:
    """1 in content, -1 in boilerplate, else what the parent says."""
    if tag in MAIN:
        mark = 1
    elif tag in PLAIN or tag == "header" and inside != 1:
        return -1
    else:
        mark = inside
    if "=" in attributes:
        words = {w for m in re.findall(ATTRIBUTE, attributes, re.I) for w in re.split(r"[^a-z]+", m.lower()) if w}
        if words & BOILER_WORDS:
            return -1
        if words & MAIN_WORDS and mark >= 0:
            return 1
    return mark


def blocks(page: str) -> list[tuple]:
    """The text blocks of a page in order: text, tag, hint, share of its characters that are in links, place of its
    parent (a number for each element), and depth."""
    out: list[tuple] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, hint, number, in a link
    held: list[str] = []
    linked = number = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                own = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCK), 0)
                out.append((text, stack[own][0], stack[-1][1] if own else stack[0][1], min(1.0, linked / len(text)), stack[max(0, own - 1)][2], own))
        linked = 0

    def keep(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text)
            held.append(text)
            if stack[-1][3]:
                linked += len(text)

    at = 0
    for m in iter_tokens(page):
        start, end, closing, tag, attributes = m
        keep(page[at:start])
        at = end
        if not tag:
            continue
        block = tag in BLOCK
        if block:
            flush()
        elif tag == "br" or tag == "img":
            held.append(" ")
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID or tag in RAW:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        elif tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SAME[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
        number += 1
        stack.append((tag, _hint(tag, attributes, stack[-1][1]), number, stack[-1][3] or tag == "a"))
    keep(page[at:])
    flush()
    return out


def iter_tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of each tag; elements without text of their own are one."""
    find = re.compile(TOKEN, re.S).search
    at = 0
    while m := find(page, at):
        tag = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        end = m.end()
        attributes = m[3] or m[6] or ""
        if tag in RAW and not closing and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, end)
            end = close.end() if close else len(page)
        yield m.start(), end, closing, tag, attributes
        at = end


def features(found: list[tuple]) -> np.ndarray:
    out = np.empty((len(found), len(FEATURES)))
    for i, (text, tag, hint, links, _, _) in enumerate(found):
        ends = text.count(". ") + text.count("! ") + text.count("? ") + text.endswith((".", "!", "?"))
        out[i] = 1, hint == 1, hint == -1, math.log1p(len(text)), links, min(4, ends), tag == "p", tag[:1] == "h" and tag[1:].isdigit(), tag == "li"
    return out


def labelled(page: str) -> np.ndarray:
    """Features of the page's blocks whose elements tell their role."""
    x = features(blocks(page))
    return x[(x[:, 1] + x[:, 2]) > 0]


def fit(pages: list[str]) -> np.ndarray:
    return fit_features([labelled(p) for p in pages])


def fit_features(rows: list[np.ndarray], rounds: int = 300, rate: float = 0.1, pull: float = 0.02) -> np.ndarray:
    """Logistic regression for content, from the blocks whose elements tell their role. Their hints are hidden in every
    second block, so that the text's own features are learned too; weights are pulled to PRIOR, and with no such
    blocks they are PRIOR."""
    weights = prior = np.array(PRIOR)
    x = np.concatenate([np.empty((0, len(FEATURES))), *rows])
    if not len(x):
        return weights
    y = x[:, 1].copy()
    x[::2, 1:3] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ weights))
        weights = weights - rate * (x.T @ (p - y) / len(y) + pull * (weights - prior))
    return weights


def min_cut(content: np.ndarray, boiler: np.ndarray, edges: dict[tuple[int, int], float]) -> list[bool]:
    """For each node, whether it is on the content side of a minimum cut. content[i] is the cost of calling i
    boilerplate, boiler[i] that of calling it content; edges hold the cost of parting two nodes.

    A node whose own costs differ by more than all its edges is on that side in any minimum cut; it is fixed and its
    edges become costs of its neighbours. What is left goes through a maximum flow (Dinic)."""
    n = len(content)
    own = [float(a - b) for a, b in zip(content, boiler)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(own[i]) > sum(near[i].values()):
            side[i] = own[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                own[j] += w if side[i] else -w
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, kept in zip(rest, _flow([own[i] for i in rest], {(k, m): near[i][j] for k, i in enumerate(rest) for m, j in enumerate(rest) if i < j and j in near[i]} if len(rest) < 64 else _indexed(rest, near))):
            side[i] = kept
    return [bool(s) for s in side]


def _indexed(rest: list[int], near: list[dict[int, float]]) -> dict[tuple[int, int], float]:
    place = {i: k for k, i in enumerate(rest)}
    return {(place[i], place[j]): w for i in rest for j, w in near[i].items() if i < j}


def _flow(own: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    n = len(own)
    s, t = n, n + 1
    links: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            links[x].append(len(to))
            to.append(y)
            left.append(c)

    for i, c in enumerate(own):
        join(s, i, c, 0) if c > 0 else join(i, t, -c, 0)
    for (a, b), w in edges.items():
        join(a, b, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in links[a]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                c = min(left[e] for e in path)
                for e in path:
                    left[e] -= c
                    left[e ^ 1] += c
                k = next(k for k, e in enumerate(path) if left[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
            elif place[a] < len(links[a]):
                e = links[a][place[a]]
                if left[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    place[a] += 1
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                place[a] += 1
            else:
                break


def main_text(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    score = features(found) @ weights
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (_, _, _, _, parent, depth) in enumerate(found):
        if i:
            edges[i - 1, i] = NEAR / (1 + abs(depth - found[i - 1][5]) + (parent != found[i - 1][4]))
        if parent in last:
            edges[last[parent], i] = edges.get((last[parent], i), 0) + SIBLING
        last[parent] = i
    kept = min_cut(np.logaddexp(0, score), np.logaddexp(0, -score), edges)
    return "\n".join(b[0] for b, k in zip(found, kept) if k)


def fit_sample(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights from a bounded sample of SAMPLE_PAGES whole pages; only their blocks' features go to the driver."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    sample = hash_sample(pages, SAMPLE_PAGES, df.count(), "page_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [labelled(page).ravel() for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["x"])

    rows = sorted(r["x"] for r in map_arrow(sample.select("html"), read, "x array<double>").collect())
    return fit_features([np.array(x).reshape(-1, len(FEATURES)) for x in rows])


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars: the main text of each page, its blocks in page order joined by a line feed.

    Each page is split into text blocks, scored by a logistic regression on format and place (fit on a bounded sample
    unless given); the scores are terminal capacities, neighbouring blocks and blocks of one parent are joined by
    edges, and the blocks on the content side of the minimum cut are kept. Pages are read whole, where they lie: no
    shuffle. A null or empty page has the empty text; a null id stays null; repeated rows give repeated rows; other columns are ignored."""
    learned = fit_sample(df, id_col, html_col) if weights is None else weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_chunks(whole, "html")):
            texts = [main_text(page, learned) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(pages, extract, "page_id long, url string, text string, n_chars long")
