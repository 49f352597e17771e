"""Main text of web pages by minimum cut.

A page becomes a list of text blocks.  A trained classifier gives capacities: a block's log-odds of being content, by its
text and links alone, are its terminal capacity; what a mark is worth (article or main; nav, footer, aside, form; telling
class names) is learned with them, one weight for marks by element and one for marks by name.  Smoothness edges join
neighbours in page order, neighbours under one DOM parent, and each block with the node of the nearest element that marks its
surroundings; that edge, and the node's own capacity, are the mark's weight.  The minimum cut labels every block, against its
own odds where its surroundings weigh more, and against its mark where its text, or the texts of all that the mark covers,
weigh more.  Without learned weights nothing is content.  Nodes whose own odds outweigh all their edges are settled first
(which never changes the cut); Dinic's algorithm solves what is left.

The classifier is a logistic model of SHAPES text shapes and two marks, trained on a bounded sample of the pages themselves
(SAMPLE pages of lowest hash, BLOCKS blocks of each): blocks under article or main are its positives, blocks under
boilerplate elements its negatives.  The text's weights are fitted with all marks held out, so they stand alone; the marks'
weights are fitted on blocks that come twice, with their mark and without it, so they stay of the text's order.  Without both
kinds it falls back to the fixed WEIGHTS.

Defined cases: null or empty html gives an empty text and 0; markup without a content block gives an empty text;
unclosed, stray or nested tags are repaired as they come, in time linear in the page; repeated pages give repeated
rows; extra columns are kept (one named __text is replaced)."""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is never text of the page.
SKIP = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "textarea", "select", "button", "iframe", "object", "canvas", "audio", "video", "map", "datalist"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
SELF_CLOSING = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption"}
GOOD_TAGS = {"article", "main"}
BAD_WORDS = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promotion reader recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
GOOD_WORDS = set("article body content entry main post story text".split())
_ENDS = re.compile(r"[.!?…:;\"”»)]\s*$")

SAMPLE, BLOCKS, SHAPES = 1000, 64, 6
#: Used where a sample has no blocks of both kinds: bias, length, links, sentence end, commas, capitals; a mark by element, by name.
WEIGHTS = (-2.0, 4.0, -4.0, 1.0, 1.0, -0.5, 5.0, 4.0)
#: Names whose marks weigh like elements'.
FIRM_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "advertising", "comment", "comments", "cookie", "cookies", "disqus", "replies", "sponsored"}
#: A block's odds are held within MOST; edges: next block, next under the same parent, between surroundings that differ.  A
#: marking node's own capacity is its mark's weight, and SHARE of it (FIRM_SHARE by element) for each block.
MOST, NEXT, NEAR, APART, SHARE, FIRM_SHARE = 6.0, 0.5, 0.3, 0.1, 0.3, 0.75


class Block:
    __slots__ = ("text", "links", "parent", "good", "bad", "anchor")

    def __init__(self, text, links, parent, good, bad, anchor):
        self.text, self.links, self.parent, self.good, self.bad, self.anchor = text, links, parent, good, bad, anchor


def _mark(tag: str, attrs: str) -> tuple[int, int, bool]:
    """(content mark, boilerplate mark, hidden) of an element: 2 by its tag, 1 by its names, 0 none."""
    good, bad, hidden = 2 * (tag in GOOD_TAGS), 2 * (tag in BAD_TAGS), False
    if attrs and tag not in ("body", "html"):
        words: set[str] = set()
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
            elif name in ("class", "id", "role", "itemprop"):
                words.update(w.lower() for w in _WORD.findall(value))
                if value.lower() in ("complementary", "contentinfo", "alert"):
                    bad = max(bad, 1)
                if value == "articleBody":
                    good = 2
        if words:
            b, g = bool(words & BAD_WORDS), bool(words & GOOD_WORDS)
            if b and (not g or words & FIRM_WORDS):
                bad = max(bad, 2 if words & FIRM_WORDS else 1)
            elif g and not b:
                good = max(good, 1)
    return good, bad, hidden


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    # An entry: tag, element number, content mark, boilerplate mark, skipped, elements that gave the two marks.
    stack: list[tuple[str, int, int, int, bool, int, int]] = [("", 0, 0, 0, False, 0, 0)]
    firm = [0]  # where the stack's elements that are not inline stand
    opened: Counter[str] = Counter()
    links = number = pos = in_link = 0

    def drop(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
        while firm[-1] >= k:
            firm.pop()

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                k, top = firm[-1], stack[-1]
                up = stack[k - 1][1] if k and stack[k][0] in LEAVES else stack[k][1]
                out.append(Block(text, min(links, len(text)), up, top[2], top[3], top[6] if top[3] else top[5]))
            parts.clear()
        links = 0

    size, last = len(page), page.rfind(">")
    while pos < size:
        # A tag ends at some ">": beyond the last there is none (comments end with the page).
        m = _TOKEN.search(page, pos) if pos <= last else _COMMENT.search(page, pos)
        upto = m.start() if m else size
        if upto > pos and not stack[-1][4]:
            piece = page[pos:upto]
            parts.append(piece)
            if in_link:
                links += len(piece.strip())
        if not m:
            break
        pos = m.end()
        tag = m[2] if m.re is _TOKEN else None
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                close()
            if not opened[tag]:
                continue
            k = len(stack) - 1
            floor = firm[-1] if tag in INLINE else 0
            while k > floor and stack[k][0] != tag:
                k -= 1
            if stack[k][0] != tag:
                continue  # the end of an inline element that a block has closed already
            if tag not in INLINE:
                close()
            if tag == "a":
                in_link = 0
            drop(k)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                close()
            continue
        if tag not in INLINE:
            close()
            k = firm[-1]
            if stack[k][0] == "p" or stack[k][0] in SELF_CLOSING.get(tag, "").split():
                k -= 1
                in_link = 0
            drop(k + 1)
        number += 1
        up = stack[-1]
        good, bad, hidden = _mark(tag, m[3])
        if tag == "header" and up[2] == 2 and not up[3]:
            bad = 0  # an article's own heading
        if good == 2 and not bad:
            bad_now = up[3] if up[3] == 2 else 0  # named wrappers around an article do not count, elements do
        else:
            bad_now = max(up[3], bad)
        skip = up[4] or hidden or tag in SKIP
        if tag == "a":
            in_link = 1
        if not m[3].rstrip().endswith("/") or tag in INLINE:
            if tag not in INLINE:
                firm.append(len(stack))
            opened[tag] += 1
            stack.append((tag, number, max(up[2], good), bad_now, skip, number if good > up[2] else up[5], number if bad_now > up[3] else up[6]))
        if tag in RAW:
            end = _RAW_END[tag].search(page, pos)
            pos = end.start() if end else size
    close()
    return out


def shape(b: Block) -> list[float]:
    """What the classifier sees: nothing of the markup but links."""
    n = len(b.text)
    words = b.text.split(" ")
    return [
        1.0,
        min(1.0, math.log1p(n) / 6.0),
        b.links / n,
        1.0 if _ENDS.search(b.text) else 0.0,
        min(1.0, 20 * sum(map(b.text.count, ",;.!?")) / n),
        sum(w[:1].isupper() for w in words) / len(words),
    ]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[float, ...]:
    """Weights of a logistic model, classes weighed alike, by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (q - y)) + 1e-3 * w
        w = w - np.linalg.solve((x * (each * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
    return tuple(float(v) for v in w)


def odds(b: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """Log-odds that a block is content, by its text alone."""
    return max(-MOST, min(MOST, sum(v * w for v, w in zip(shape(b), weights[:SHAPES], strict=True))))


def graph(found: list[Block], weights: tuple[float, ...] = WEIGHTS) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Terminal capacities (blocks first, then marking elements) and smoothness edges."""
    z = [odds(b, weights) for b in found]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    any_good = any(b.good == 2 and not b.bad for b in found)
    nodes: dict[tuple[bool, int], int] = {}
    for i, b in enumerate(found):
        if i:
            same = found[i - 1].anchor == b.anchor and found[i - 1].bad == b.bad
            edges[(i - 1, i)] = (NEXT if found[i - 1].parent == b.parent else NEXT / 2) if same else APART
        j = last.get(b.parent)
        if j is not None and found[j].anchor == b.anchor and found[j].bad == b.bad:
            edges[(j, i)] = edges.get((j, i), 0.0) + NEAR
        last[b.parent] = i
        # What an article's page holds outside of it is marked by the page itself.
        if b.bad or b.good or any_good:
            content = not b.bad and (b.good == 2 or (b.good == 1 and not any_good))
            key = (content, b.anchor if b.bad or content else 0)
            if key not in nodes:
                nodes[key] = len(z)
                z.append(0.0)
            firm = max(b.good, b.bad) == 2
            mark = (weights[SHAPES] if firm else weights[SHAPES + 1]) * (1 if content else -1)
            z[nodes[key]] += mark * ((FIRM_SHARE if firm else SHARE) + (not z[nodes[key]]))
            edges[(i, nodes[key])] = abs(mark)
    return z, edges


def cut(z: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The minimum cut's source side for terminal capacities max(z, 0) and max(-z, 0)."""
    n = len(z)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    z, label = list(z), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                z[j] += c if label[i] else -c
                if label[j] is None:
                    todo.append(j)
            near[i].clear()
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, _max_flow(left, z, near), strict=True):
            label[i] = side
    return label


def _max_flow(nodes: list[int], z: list[float], near: list[dict[int, float]]) -> list[bool]:
    at = {v: k for k, v in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    head, cap, out = [], [], [[] for _ in range(t + 1)]

    def add(u: int, v: int, c: float, back: float) -> None:
        for a, b, w in ((u, v, c), (v, u, back)):
            out[a].append(len(head))
            head.append(b)
            cap.append(w)

    for v in nodes:
        add(s, at[v], z[v], 0.0) if z[v] > 0 else add(at[v], t, -z[v], 0.0)
        for w, c in near[v].items():
            if w in at and v < w:
                add(at[v], at[w], c, c)
    tiny = 1e-12
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        turn = [0] * (t + 1)
        while True:  # one augmenting path a turn, by an explicit stack
            path, u = [], s
            while u != t:
                while turn[u] < len(out[u]):
                    e = out[u][turn[u]]
                    if cap[e] > tiny and level[head[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] == len(out[u]):
                    if not path:
                        break
                    u = head[path.pop() ^ 1]
                    turn[u] += 1
                else:
                    path.append(out[u][turn[u]])
                    u = head[path[-1]]
            if u != t:
                break
            f = min(cap[e] for e in path)
            for e in path:
                cap[e] -= f
                cap[e ^ 1] += f


def main_text(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return " ".join(b.text for b, k in zip(found, cut(*graph(found, weights)), strict=False) if k)


def inputs(b: Block) -> list[float]:
    """A block's shapes, and its mark by element and by name (1 content, -1 boilerplate, 0 none)."""
    side = -1.0 if b.bad else 1.0 if b.good else 0.0
    firm = max(b.good, b.bad) == 2
    return [*shape(b), side * firm, side * (not firm)]


def marked(page: str | None) -> tuple[list[list[float]], list[float]]:
    """Inputs and labels of up to BLOCKS blocks whose surroundings are marked."""
    sure = [b for b in (blocks(page) if page else []) if b.bad or b.good == 2]
    if len(sure) > BLOCKS:
        sure = [sure[i * len(sure) // BLOCKS] for i in range(BLOCKS)]
    return [inputs(b) for b in sure], [0.0 if b.bad else 1.0 for b in sure]


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> tuple[float, ...]:
    """The classifier's weights from `sample` pages of lowest hash."""

    @F.pandas_udf("array<double>")
    def measured(found: pd.Series) -> pd.Series:
        return found.map(lambda page: [v for x, y in zip(*marked(page), strict=True) for v in (*x, y)])

    keyed = pages.where(F.length(html) > 0).select(F.xxhash64(html).alias("__h"), F.col(html).alias("__page"))
    chosen = keyed.select("__h").distinct().orderBy("__h").limit(sample)
    picked = keyed.join(F.broadcast(chosen), "__h").groupBy("__h").agg(F.min("__page").alias("__page"))  # at most `sample` longs
    rows = sorted((r["__h"], r["x"]) for r in picked.select("__h", measured("__page").alias("x")).collect())
    data = np.array([v for _, x in rows for v in x], float).reshape(-1, SHAPES + 3)
    if len(data) == 0 or len(np.unique(data[:, -1])) < 2:
        return WEIGHTS
    held = data.copy()
    held[:, SHAPES : SHAPES + 2] = 0.0
    both = np.concatenate([data, held])
    w = (*fit(data[:, :SHAPES], data[:, -1]), *fit(both[:, :-1], both[:, -1])[SHAPES:])
    seen = np.abs(data[:, SHAPES : SHAPES + 2]).any(axis=0)  # a mark that no sampled block bears keeps its fixed weight
    return (*w[:SHAPES], *(v if s else f for v, s, f in zip(w[SHAPES:], seen, WEIGHTS[SHAPES:], strict=True)))


def extract(pages: DataFrame, html: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """pages with `__text`."""
    learned = train(pages, html) if weights is None else weights

    @F.pandas_udf("string")
    def main(found: pd.Series) -> pd.Series:
        return found.map(lambda page: main_text(page, learned))

    return pages.withColumn("__text", main(F.coalesce(F.col(html), F.lit(""))))


def digest(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html")).withColumn("text", F.col("__text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
