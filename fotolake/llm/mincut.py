"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text. A classifier gives each block the cost of calling it
boilerplate or content; these are the capacities to the two terminals. Neighbouring blocks,
and blocks under one container, are tied by edges that cost if their labels differ; a
container is a node of its own, so their number grows with the page, not with its square.
The minimum cut, found by maximum flow, is the cheapest labelling.

The classifier is a logistic regression on what a block looks like (length, links, marks,
place), fitted on blocks of a bounded sample of pages whose markup names them: inside an
article or main element, or inside navigation, footers, notices and the like. Where a block
has such a name itself, that adds to its costs; looks and neighbours can outvote it. Names
are whole class tokens, ids and roles. A form that holds most of a page's text is its
wrapper and says nothing, and an article or main element below a form or a named wrapper
starts afresh.

Defined results: null and empty html, and pages without content blocks, give an empty text;
markup that is cut off or never closed is read as far as it goes, a tag without an end up to
the next one; repeated rows are read each; nothing is shortened, and a page is read in time in
proportion to its length, whatever its markup; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages whose blocks the fit takes, by hash order, and blocks it takes at most: its bound.
FIT_PAGES = 2_000
FIT_BLOCKS = 100_000

# Below what looks alone can reach, above what all edges of a block sum to.
NAMED_COST = 4.0
LOOKS_COST = 6.0
NEIGHBOUR_COST = 0.6
CONTAINER_COST = 0.4

# Attributes: quotes count after an equals sign only; a tag that is not closed ends before the
# next "<". No part gives back what it took, so that reading a page takes time in proportion.
_ATTRIBUTES = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|select|button|iframe|title|object|math)\b"
    rf"{_ATTRIBUTES}(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z))"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)({_ATTRIBUTES})>?"
    r"|<[!?][^<>]*+>?",
    re.S | re.I,
)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_COUNTED = re.compile(r"[-_]*\d+\Z")

_CONTAINERS = frozenset(
    "html body main article section div nav header footer aside form ul ol dl table tbody thead "
    "tr figure fieldset details dialog blockquote menu".split()
)
_BLOCKS = _CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd td th pre hr address figcaption caption legend summary option "
    "head center".split()
)
# What elements and names say about the text below them.
_BOILER_TAGS = frozenset("nav footer aside menu dialog fieldset head".split())
_CONTENT_TAGS = frozenset("article main".split())
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent notice notices alert popup modal overlay dialog subscribe newsletter "
    "signup login form search share sharing social related recommended comment comments reply "
    "replies disqus respond complementary contentinfo pagination pager toolbar skip "
    "nav-bar main-nav site-nav site-navigation main-navigation site-header page-header site-footer "
    "page-footer side-bar cookie-banner cookie-notice comment-list comments-area related-posts "
    "share-buttons social-links".split()
)
# Articles below these are other texts: comments and teasers.
_OTHERS_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation "
    "footer sidebar side-bar aside widget related recommended comment comments reply replies disqus "
    "respond complementary comment-list comments-area related-posts".split()
)
_CONTENT_NAMES = frozenset(
    "article content post entry story main body text article-body article-content entry-content "
    "main-content post-body post-content story-body".split()
)


class _Block:
    __slots__ = ("text", "parent", "named", "links", "tag", "form")

    def __init__(self, text, parent, named, links, tag, form):
        self.text, self.parent, self.named, self.links, self.tag = text, parent, named, links, tag
        self.form = form


def _named(tag: str, attributes: str, inherited: int, in_article: bool, others: bool) -> tuple[int, bool]:
    """1 for content, -1 for boilerplate, else what the element around says; whether articles
    below are other texts."""
    if tag in _BOILER_TAGS:
        return -1, True
    if tag == "header":
        # The head of an article is part of it.
        return (inherited, others) if in_article else (-1, True)
    if tag in _CONTENT_TAGS:
        # Comments are often articles within a list of comments.
        return (-1, others) if inherited < 0 and (others or in_article) else (1, False)
    if attributes:
        tokens = {
            _COUNTED.sub("", token)
            for match in _NAME.finditer(attributes)
            for token in (match[1] or match[2] or match[3] or "").lower().split()
        }
        if in_article:
            tokens -= {"header"}
        if tokens & _BOILER_NAMES and tag not in ("html", "body"):
            return -1, others or bool(tokens & _OTHERS_NAMES)
        if tokens & _CONTENT_NAMES and inherited >= 0 and tag not in ("html", "body"):
            return 1, others
    return inherited, others


def read_blocks(page: str) -> tuple[list[_Block], list[int]]:
    """Blocks in page order, and for each container the number of the one around it."""
    blocks: list[_Block] = []
    around = [-1]
    # Name of the element, its container, what names say, whether inside an article, whether
    # articles are other texts, number of the form around.
    stack = [("", 0, 0, False, False, -1)]
    # How often each element is open, so that end tags of none are told without a search.
    n_open: Counter[str] = Counter()
    n_forms = 0
    pieces: list[str] = []
    linked: list[int] = [0]
    in_link, tag_now, at = 0, "", 0

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                _, container, named, _, _, form = stack[-1]
                blocks.append(_Block(text, container, named, min(linked[0], len(text)), tag_now, form))
            pieces.clear()
        linked[0] = 0

    def text(part: str) -> None:
        if part:
            pieces.append(part)
            if in_link:
                linked[0] += len(part)

    for match in _TOKEN.finditer(page):
        text(page[at : match.start()])
        at = match.end()
        tag = (match[3] or "").lower()
        if not tag:
            if match[1] and match[1].lower() in ("button", "select", "textarea", "iframe", "object"):
                text(" ")
            continue
        closing = bool(match[2])
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            text(" ")
        if tag not in _BLOCKS:
            continue
        close()
        in_link = 0
        tag_now = "" if closing else tag
        if tag in _CONTAINERS or tag == "head":
            if closing:
                # An inner end tag does not close elements beyond its own.
                ended = "" if n_open[tag] else tag
                while ended != tag:
                    ended = stack.pop()[0]
                    n_open[ended] -= 1
            elif not match[4].endswith("/"):
                _, container, inherited, in_article, others, form = stack[-1]
                around.append(container)
                own, others = _named(tag, match[4], inherited, in_article, others)
                inside = in_article or tag in _CONTENT_TAGS
                if tag == "form" and form < 0:
                    form, n_forms = n_forms, n_forms + 1
                elif tag in _CONTENT_TAGS and own > 0:
                    form = -1
                stack.append((tag, len(around) - 1, own, inside, others, form))
                n_open[tag] += 1
        elif match[4] and not closing:
            own, _ = _named(tag, match[4], *stack[-1][2:5])
            if own != stack[-1][2]:
                # A named paragraph is a container of itself, up to the next block.
                tag_now = f"{tag}:{own}"
    text(page[at:])
    close()
    for block in blocks:
        if ":" in block.tag:
            block.tag, own = block.tag.split(":")
            block.named = int(own)
    total, inside = 0, [0] * n_forms
    for block in blocks:
        total += len(block.text)
        if block.form >= 0:
            inside[block.form] += len(block.text)
    for block in blocks:
        # A form that holds most of the text is a wrapper of the page.
        if block.form >= 0 and 2 * inside[block.form] <= total:
            block.named = -1
    return blocks, around


FEATURES = 7


def block_features(blocks: list[_Block]) -> np.ndarray:
    """What the classifier sees of each block: its looks, not its name."""
    n = len(blocks)
    x = np.zeros((n, FEATURES))
    for i, block in enumerate(blocks):
        size = len(block.text)
        n_words = block.text.count(" ") + 1
        x[i] = (
            1.0,
            np.log1p(size),
            min(n_words, 100) / 25,
            block.links / size,
            min(sum(block.text.count(c) for c in ".!?,;"), 20) / 10,
            block.tag in ("li", "td", "th", "option", "dt", "dd"),
            abs(2 * (i + 0.5) / n - 1),
        )
    return x


def fit_classifier(x: np.ndarray, content: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps with a small ridge."""
    weights = np.zeros(FEATURES)
    for _ in range(rounds if 0 < content.sum() < len(content) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (content - p) - 0.5 * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(FEATURES)
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


class _Flow:
    """Maximum flow by shortest augmenting levels, on arrays of edges and their reverses."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def tie(self, a: int, b: int, there: float, back: float) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if level[b] < 0 and self.room[e] > 1e-9:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def run(self, source: int, sink: int) -> list[int]:
        """Levels after the last round: nodes with a level are on the source's side."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return level
            following = [0] * len(self.out)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    most = min(self.room[e] for e in path)
                    cut = 0
                    for i, e in enumerate(path):
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges, i = self.out[a], following[a]
                while i < len(edges):
                    e = edges[i]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    i += 1
                following[a] = i
                if i < len(edges):
                    path.append(edges[i])
                    a = self.to[edges[i]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    following[a] += 1
                else:
                    break


def label_blocks(blocks: list[_Block], around: list[int], weights: np.ndarray) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    if not blocks:
        return []
    # Bounded, so that neither looks nor names decide alone.
    score = np.clip(block_features(blocks) @ weights, -LOOKS_COST, LOOKS_COST)
    as_boiler = np.log1p(np.exp(score))
    as_content = np.log1p(np.exp(-score))
    named = np.array([block.named for block in blocks])
    # Paid for the label "boilerplate" is the capacity from the source, and the reverse.
    spare = as_boiler - as_content + NAMED_COST * named
    used = sorted({block.parent for block in blocks})
    known = set(used)
    for container in used:
        while (container := around[container]) >= 0 and container not in known:
            known.add(container)
    number = {container: len(blocks) + i for i, container in enumerate(sorted(known))}
    source, sink = len(blocks) + len(number), len(blocks) + len(number) + 1
    flow = _Flow(sink + 1)
    # What a block pays under both labels flows straight through; only the difference counts.
    for i, value in enumerate(spare.tolist()):
        if value > 0:
            flow.tie(source, i, value, 0.0)
        elif value < 0:
            flow.tie(i, sink, -value, 0.0)
    for i, block in enumerate(blocks):
        flow.tie(i, number[block.parent], CONTAINER_COST, CONTAINER_COST)
        if i:
            near = 1.0 if blocks[i - 1].parent == block.parent else 0.25
            flow.tie(i - 1, i, NEIGHBOUR_COST * near, NEIGHBOUR_COST * near)
    for container in known:
        if around[container] >= 0:
            flow.tie(number[container], number[around[container]], CONTAINER_COST / 4, CONTAINER_COST / 4)
    level = flow.run(source, sink)
    return [level[i] >= 0 for i in range(len(blocks))]


def extract(page: str, weights: np.ndarray) -> str:
    blocks, around = read_blocks(page)
    labels = label_blocks(blocks, around, weights)
    return "\n".join(block.text for block, content in zip(blocks, labels, strict=True) if content)


def learn_costs(pages: DataFrame, fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights from the blocks of at most ``fit_pages`` pages whose markup names them.

    Equal rows are one page; at most ``FIT_BLOCKS`` blocks reach the driver.
    """
    keyed = pages.where("html is not null").select(
        F.xxhash64("page_id", "html").alias("_order"), "html"
    )
    # Only keys are ordered; there are at most ``fit_pages`` of them to broadcast.
    keys = keyed.select("_order").orderBy("_order").limit(fit_pages).distinct()
    chosen = keyed.join(F.broadcast(keys), "_order").groupBy("_order").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blocks, _ = read_blocks(page.as_py())
                rows = zip(block_features(blocks), blocks, strict=True)
                named = [(x, b.named > 0) for x, b in rows if b.named]
                named = named[:: max(1, -(-len(named) * fit_pages // FIT_BLOCKS))]
                if named:
                    yield pa.record_batch(
                        [
                            pa.array([order] * len(named), pa.int64()),
                            pa.array([x.tolist() for x, _ in named], pa.list_(pa.float64())),
                            pa.array([float(c) for _, c in named], pa.float64()),
                        ],
                        names=["page", "x", "content"],
                    )

    rows = chosen.mapInArrow(run, "page long, x array<double>, content double").toPandas()
    if rows.empty:
        return np.zeros(FEATURES)
    rows = rows.sort_values("page", kind="stable")
    return fit_classifier(np.array(rows["x"].tolist()), rows["content"].to_numpy())


def main_texts(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text for every row of ``page_id, url, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", weights) for page in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return own.mapInArrow(run, "page_id long, url string, text string")
