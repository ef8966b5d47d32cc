"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks: runs of text between block-level tags, in page order, each with the
place in the element tree where it begins.  A classifier gives each block the cost of calling it
content and the cost of calling it boilerplate; the costs are the capacities of its edges to the two
terminals.  Blocks that follow each other, the nearer in the tree the stronger, and blocks that follow
each other within one parent, whatever stands between them, are tied by edges that cost their
capacity when their labels differ.  The minimum cut, found by max-flow, is the cheapest labelling of
the page; the content side, joined in page order, is its main text.

The classifier is a logistic regression over landmarks (menus, asides, comments, adverts, articles
by tag, role, class or id), link density, length, punctuation and kind of element.  It is fitted around
prior weights on blocks of at most ``SAMPLE_PAGES`` pages and ``SAMPLE_BLOCKS`` blocks, the first by
hash, labelled by their landmarks; each block counts a second time without its landmarks, so that pages
without any can be labelled too.  Everything else covers whole pages.

Null and empty html, and pages without text, give the empty text.  Unclosed comments, scripts and
tags run to the end of the page, as in browsers; elements nested beyond ``DEPTH`` become siblings.
Character references are decoded once.  Repeated rows are extracted each by itself, also rows
without an id; an empty table gives no rows and leaves the prior weights.  All columns pass through
``extract``; input columns named ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sample_ids, text_slices

SAMPLE_PAGES = 1_000
SAMPLE_BLOCKS = 20_000
SAMPLE_WEIGHT = 60.0  # what all sampled blocks weigh together against the prior
HIDDEN_SHARE = 0.3  # weight of a block's second copy, without landmarks
SLICE_CHARS = 2_000_000
DEPTH = 512
UNIT = 1_000  # capacities are whole numbers
NEXT, SIBLING = 0.8, 0.5  # capacity between neighbours, and between blocks that follow each other in one parent

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
SKIPPED = frozenset("head template svg canvas object audio video map select button datalist option optgroup".split())
IN_HEAD = frozenset("meta link base template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math output q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input picture".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote".split())
ITEMS = frozenset("li td th dt dd".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "tbody": {"table"}}

#: Landmarks: tags, roles, and words of a class or id.
OUT_TAGS = frozenset("nav footer aside header form menu dialog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer foot topbar sidebar aside rail ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe signup "
    "subscription login share sharing social related recommended recommendations widget toolbar copyright legal disclaimer outbrain taboola search skip".split()
)
HEAD_WORDS = frozenset(["header", "masthead"])
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
IN_TAGS = frozenset(["article", "main"])
IN_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())
OUT, COMMENTS, WEAK, HEADER = 1, 2, 4, 8  # what an element is by itself

FEATURES = ("bias", "out", "inside", "comments", "links", "length", "punctuation", "heading", "prose", "item", "edge", "mark", "outside")
PRIOR = np.array([1.0, -7.0, 5.0, -9.0, -5.0, 2.0, 1.0, 0.5, 1.0, -0.5, -0.5, -3.0, -4.0])
LANDMARKS = [1, 2, 3, 12]

_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_INSIDE = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+>")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_WITHOUT = re.compile(r"\b(?:with|has|no|without)[-_ ]?[a-zA-Z]+")


@dataclass
class Block:
    text: str
    node: int
    links: int  # characters within links
    apart: int  # steps in the tree from the block before


@dataclass
class Page:
    """Elements in page order (parents first) and the blocks of text in them."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    kinds: list[int] = field(default_factory=lambda: [0])
    inside: list[int] = field(default_factory=lambda: [0])  # 1: by a word of class or id, 2: main, 3: article
    blocks: list[Block] = field(default_factory=list)


def landmark(tag: str, attributes: str) -> tuple[int, int]:
    """What an element is by its tag, role, class and id: (kind, level of a content landmark)."""
    out, inside, words, role = tag in OUT_TAGS, 3 if tag == "article" else 2 if tag == "main" else 0, set(), ""
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.strip().lower()
            else:
                words.update(w.lower() for w in _WORD.findall(_WITHOUT.sub("", value)))
    if words & COMMENT_WORDS:
        return COMMENTS, 0
    if tag == "header":
        return OUT | HEADER, 0
    if out or role in OUT_ROLES:
        return OUT, 0
    if role in ("main", "article"):
        inside = inside or 2
    if not inside and words & OUT_WORDS:
        return OUT | WEAK, 0
    if not inside and words & HEAD_WORDS:
        return OUT | WEAK | HEADER, 0
    return 0, inside or int(bool(words & IN_WORDS))


def parse(source: str) -> Page:
    """Read a page into its elements and blocks."""
    page = Page()
    tags, parents, kinds, inside = page.tags, page.parents, page.kinds, page.inside
    stack, open_tags = [0], Counter()
    parts: list[str] = []
    state = {"node": 0, "links": 0, "low": 1, "depth": 1, "was": 1, "skip": 0}

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            here = state["depth"]
            apart = here + state["was"] - 2 * min(state["low"], here, state["was"]) if page.blocks else 0
            page.blocks.append(Block(text, state["node"], min(state["links"], len(text)), apart))
            state["was"], state["low"] = here, here
        parts.clear()
        state["links"] = 0

    def add(text: str):
        if tags[stack[-1]] == "head" and text.strip():
            close("head")  # as browsers do
        if state["skip"] or not text:
            return
        text = entities.unescape(text)
        if not parts:
            text = text.lstrip()
            if not text:
                return
            at = len(stack) - 1
            while at and tags[stack[at]] in INLINE:
                at -= 1
            state["node"], state["depth"] = stack[at], at + 1
        parts.append(text)
        if open_tags["a"]:
            state["links"] += len("".join(text.split()))

    def pop_to(at: int):
        for node in stack[at:]:
            open_tags[tags[node]] -= 1
            if tags[node] in SKIPPED:
                state["skip"] -= 1
        del stack[at:]
        state["low"] = min(state["low"], len(stack))

    def close(tag: str):
        if not open_tags[tag]:
            return
        at = len(stack) - 1
        while tags[stack[at]] != tag:
            at -= 1
        if tag in INLINE:
            open_tags[tag] -= 1
            if kinds[stack[at]]:
                flush()
            del stack[at]
        else:
            flush()
            pop_to(at)

    def implied(tag: str):
        """End what a start tag ends by itself."""
        at = len(stack) - 1
        if open_tags["p"] and tag not in INLINE:
            while at and tags[stack[at]] in INLINE:
                at -= 1
            if tags[stack[at]] == "p":
                pop_to(at)
        if tag in CLOSES:
            ends, holds, last, at = CLOSES[tag], HOLDS[tag], 0, len(stack) - 1
            while at and tags[stack[at]] not in holds:
                if tags[stack[at]] in ends:
                    last = at
                at -= 1
            if last:
                pop_to(last)

    def start(tag: str, attributes: str):
        if tag == "br" or tag == "wbr":
            if tag == "br" and parts:
                parts.append(" ")
            return
        kind, level = landmark(tag, attributes)
        if open_tags["head"] and tag not in IN_HEAD:
            close("head")
        if tag not in INLINE or kind:
            flush()
            implied(tag)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math", "path"):
            return
        if tag in ("article", "main") and not kind:  # around the content: no boilerplate by a mere word
            for node in stack:
                if kinds[node] & WEAK or tags[node] == "form":
                    kinds[node] = 0
        if len(stack) >= DEPTH:
            return
        stack.append(len(tags))
        tags.append(tag), parents.append(stack[-2]), kinds.append(kind), inside.append(level)
        open_tags[tag] += 1
        if tag in SKIPPED:
            state["skip"] += 1

    at, last = 0, source.rfind(">")
    n, raw_ends = len(source), {}
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        after = source[lt + 1 : lt + 2]
        if source.startswith("<!--", lt):
            add(source[at:lt])
            end = source.find("-->", lt + 2)  # <!--> is a comment too
            if end < 0:
                break
            at = end + 3
        elif after.isascii() and after.isalpha():
            add(source[at:lt])
            name = _OPEN.match(source, lt + 1)
            inner = _INSIDE.match(source, name.end()) if last > lt else None
            if inner is None:
                break  # a tag that never ends
            tag, at = name[0].lower(), inner.end()
            attributes = source[name.end() : at - 1]
            if tag in RAW:
                if tag not in raw_ends:
                    raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
                end = raw_ends[tag].search(source, at)
                if tag not in ("noscript",):
                    flush()
                if end is None:
                    break
                at = end.end()
            else:
                start(tag, attributes)
        elif after in ("/", "!", "?"):
            name = _OPEN.match(source, lt + 2) if after == "/" else None
            add(source[at:lt])
            end = source.find(">", lt + 1)
            if end < 0:
                break
            at = end + 1
            if name:
                tag = name[0].lower()
                if tag == "p" and not open_tags["p"] or tag == "br":
                    start("br", "")
                close(tag)
        else:
            add(source[at : lt + 1])  # a bare <
            at = lt + 1
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """One row a block: its inputs for the classifier."""
    n = len(page.blocks)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    # inherited: parents come first.  Content within boilerplate is none; boilerplate within content is boilerplate.
    kinds, levels = list(page.kinds), list(page.inside)
    for i in range(1, len(kinds)):
        up = page.parents[i]
        own = kinds[i]
        if own & HEADER and levels[up] >= 2:
            own = 0  # an article's own header
        kinds[i] = (own | kinds[up]) & (OUT | COMMENTS)
        levels[i] = 0 if kinds[i] else max(levels[i], levels[up])
    node = np.array([b.node for b in page.blocks])
    kind, level = np.array(kinds)[node], np.array(levels)[node]
    size = np.array([len(b.text) for b in page.blocks])
    tags = [page.tags[i] for i in node]
    best = 0
    for k in (3, 2, 1):  # the closest kind of landmark that holds a good part of what may be content
        if size[(kind == 0) & (level >= k)].sum() >= 0.4 * max(1, size[(kind == 0) & (level >= max(1, k - 1))].sum()) and (level >= k).any():
            best = k
            break
    place = (size.cumsum() - size / 2) / size.sum()
    out[:, 0] = 1
    out[:, 1] = (kind & OUT) > 0
    out[:, 2] = (level >= best) & (level > 0) & (kind == 0)
    out[:, 3] = (kind & COMMENTS) > 0
    out[:, 4] = [min(1.0, b.links / max(1, len(b.text.replace(" ", "")))) for b in page.blocks]
    out[:, 5] = np.log1p(size) / 5 - 0.5
    out[:, 6] = [min(1.0, 10 * sum(map(b.text.count, ".,;:!?")) / len(b.text)) for b in page.blocks]
    out[:, 7] = [t in HEADINGS for t in tags]
    out[:, 8] = [t in PROSE for t in tags]
    out[:, 9] = [t in ITEMS for t in tags]
    out[:, 10] = np.abs(2 * place - 1) > 0.9
    out[:, 11] = ["©" in b.text for b in page.blocks]
    out[:, 12] = (level < best) & (kind == 0)
    return out


def max_flow(n: int, tails: list[int], heads: list[int], there: list[int], back: list[int], source: int, sink: int) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut (those reachable once the flow is maximal).

    Flow is sent along shortest paths, level by level; edges carry ``there`` forward and ``back`` backward.
    """
    edges = [[] for _ in range(n)]
    room, ends = [], []
    for u, v, c, d in zip(tails, heads, there, back):
        edges[u].append(len(room))
        edges[v].append(len(room) + 1)
        room += [c, d]
        ends += [v, u]
    while True:
        level, queue = [-1] * n, deque([source])
        level[source] = 0
        while queue:
            u = queue.popleft()
            for e in edges[u]:
                if room[e] and level[ends[e]] < 0:
                    level[ends[e]] = level[u] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        tried, path, u = [0] * n, [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not room[e])
                u = ends[path[k] ^ 1]
                del path[k:]
                continue
            for i in range(tried[u], len(edges[u])):
                e = edges[u][i]
                if room[e] and level[ends[e]] == level[u] + 1:
                    tried[u] = i
                    path.append(e)
                    u = ends[e]
                    break
            else:
                tried[u] = len(edges[u])
                if not path:
                    break
                u = ends[path.pop() ^ 1]
                tried[u] += 1


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
    """The cheapest labelling: block i pays -gain if content (gain < 0), gain if not (gain > 0); an edge (i, j, c) pays c if they differ.

    A block whose own cost outweighs all edges it still has takes its label at once, and its
    edges become costs of its neighbours; what is left falls into pieces, each cut by max-flow.
    """
    n = len(gain)
    cost = gain.astype(np.int64).tolist()
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    ties = [0] * n
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
        ties[i] += c
        ties[j] += c
    label = [-1] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] < 0 and abs(cost[i]) > ties[i]:  # strictly: all cheapest labellings agree
            label[i] = int(cost[i] > 0)
            for j, c in near[i]:
                if label[j] < 0:
                    cost[j] += c if label[i] else -c
                    ties[j] -= c
                    queue.append(j)
    for first in range(n):
        if label[first] >= 0:
            continue
        piece, place = [first], {first: 0}
        for i in piece:  # grows as it is read
            for j, _ in near[i]:
                if label[j] < 0 and j not in place:
                    place[j] = len(piece)
                    piece.append(j)
        m = len(piece)
        source, sink = m, m + 1
        tails, heads, there, back = [], [], [], []
        for i in piece:
            k = place[i]
            u, v = (source, k) if cost[i] > 0 else (k, sink)
            tails.append(u), heads.append(v), there.append(abs(cost[i])), back.append(0)
            for j, c in near[i]:
                if label[j] < 0 and place[j] > k:
                    tails.append(k), heads.append(place[j]), there.append(c), back.append(c)
        side = max_flow(m + 2, tails, heads, there, back, source, sink)
        for i in piece:
            label[i] = int(side[place[i]])
    return np.array(label, bool)


def smoothness(page: Page, rows: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges between blocks: neighbours, by their distance in the tree, and successors within one parent."""
    edges, last = [], {}
    region = rows[:, LANDMARKS].astype(bool)
    for j, b in enumerate(page.blocks):
        parent = page.parents[b.node]
        i = last.get(parent, -1)
        if j:
            same = (region[j] == region[j - 1]).all()
            edges.append((j - 1, j, int(UNIT * NEXT * (1.0 if same else 0.2) * 0.75 ** max(0, b.apart - 2))))
        if 0 <= i < j - 1:
            edges.append((i, j, int(UNIT * SIBLING)))
        last[parent] = j
    return [(i, j, c) for i, j, c in edges if c]


def label(page: Page, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(content or not, the classifier's log-odds) of each block."""
    rows = features(page)
    odds = rows @ weights
    gain = np.rint(UNIT * np.clip(odds, -12, 12)).astype(np.int64)
    return minimum_cut(gain, smoothness(page, rows)), odds


def main_text(source: str, weights: np.ndarray = PRIOR) -> str:
    page = parse(source)
    if not page.blocks:
        return ""
    return " ".join(b.text for b, keep in zip(page.blocks, label(page, weights)[0]) if keep)


def labelled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks as labels: (which blocks have one, whether it is content)."""
    out = (rows[:, 1] + rows[:, 3] + rows[:, 12]) > 0
    return out | (rows[:, 2] > 0), ~out


def fit_weights(rows: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Weights around the prior (unit variance), from blocks with and without their landmarks."""
    if not len(rows):
        return PRIOR.copy()
    hidden = rows.copy()
    hidden[:, LANDMARKS] = 0
    x, y = np.concatenate([rows, hidden]), np.concatenate([content, content]).astype(float)
    of_kind = np.where(content, max(1, content.sum()), max(1, (~content).sum()))  # both kinds weigh alike
    share = 1 / of_kind / 2
    share = SAMPLE_WEIGHT * np.concatenate([share * (1 - HIDDEN_SHARE), share * HIDDEN_SHARE])
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + (w - PRIOR)
        w = w - np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), slope)
    return np.round(w, 6)  # the order of the rows must not matter


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights of the classifier, from a bounded sample of the pages' own landmarks."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
    chosen = sample_ids(rows, "_id", SAMPLE_PAGES)
    texts = rows.join(F.broadcast(chosen), "_id").select(F.hash("_id").alias("_h"), "_html")
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches):
        for batch in batches:
            for start, some in text_slices(batch.column(1), SLICE_CHARS):
                keys = batch.column(0).slice(start, len(some)).to_numpy(zero_copy_only=False)
                for key, source in zip(keys, some):
                    x = features(parse(source))
                    known, content = labelled(x)
                    at = np.flatnonzero(known)
                    order = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(key) & 0xFFFFFFFF)) & np.uint64(0x7FFFFFFF)
                    columns = [pa.array(order.astype(np.int64)), pa.array(content[at]), *(pa.array(c) for c in x[at].T)]
                    yield pa.RecordBatch.from_arrays(columns, ["_order", "_content", *names])

    made = texts.mapInArrow(run, "_order long, _content boolean, " + ", ".join(f"{c} double" for c in names))
    some = made.orderBy("_order", *names).limit(SAMPLE_BLOCKS).toPandas()
    return fit_weights(some[names].to_numpy(np.float64).reshape(-1, len(names)), some["_content"].to_numpy(bool))


def blocks(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a block: page_id, place, tag, text, odds, content."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, source in zip(frame["page_id"], frame["html"]):
                page = parse(source or "")
                if page.blocks:
                    keep, odds = label(page, weights)
                    tags, texts = [page.tags[b.node] for b in page.blocks], [b.text for b in page.blocks]
                    yield pd.DataFrame({"page_id": [key] * len(texts), "place": range(len(texts)), "tag": tags, "text": texts, "odds": odds, "content": keep})

    return rows.mapInPandas(run, f"page_id {kind}, place int, tag string, text string, odds double, content boolean")


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """The pages with ``text`` (empty if there is none) and ``n_chars``; only the html goes to Python."""

    @F.arrow_udf("string")
    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([main_text(t, weights) for _, some in text_slices(column, SLICE_CHARS) for t in some], pa.string())

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    made = pages.select(F.struct(*kept).alias("_row"), texts(F.col(html_col)).alias("text"))
    return made.select("_row.*", "text", F.length("text").cast("long").alias("n_chars"))
