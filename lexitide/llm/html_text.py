"""Main text of web pages by minimum cut.

A page becomes its text blocks. A logistic classifier turns what is known of each block (elements and names around it,
tag, length, links) into the cost of calling it boilerplate or content: the capacities of its terminal edges. It is
fitted on a bounded sample of pages that mark their main text by an element of their own (``article``, ``main``): that
mark is the label and is hidden from the classifier while it learns. ``PRIOR`` is where its weights begin and what it
falls back to for what the sample doesn't show; names of classes, ids, roles and tags are learned from the sample.
Neighbouring blocks, and blocks that follow each other under one parent, are joined by smoothness edges that weigh more
the closer the two lie in the tree. A maximum flow finds the cheapest cut; blocks on the source's side are the text.
Each page is worked on by itself, so no row waits for another and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title|object|canvas|video|audio|select)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)"
    r"|([^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_NEXT = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BAD_TAGS = frozenset("nav footer aside form dialog menu button fieldset head".split())
_GOOD_TAGS = frozenset("article main".split())
#: Tags that are labels, stand around anything, or are features of their own.
_UNLEARNED = _GOOD_TAGS | frozenset("html body div section center table tbody tr td ul ol dl p blockquote pre li h1 h2 h3 h4 h5 h6".split())
_BAD_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog discussion disqus "
    "foot footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promotion rail recommended "
    "related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar tracking widget complementary contentinfo navigation".split()
)
_GOOD_NAMES = frozenset("article body content entry main post story text".split())
_BOILER_TEXT = re.compile(r"^\W*(?:©|\(c\)|copyright\b|advertisement\b|sponsored\b|all rights reserved|cookie|subscribe\b|sign up\b|log ?in\b|share this|read more|skip to)", re.I)

#: Prior means of the weights: the cost of calling a block boilerplate, less that of calling it content.
PRIOR = {"bad": -9.0, "good": 4.0, "paragraph": 1.0, "heading": 0.5, "item": -0.5, "words": 1.5, "links": -4.0, "boiler": -3.0, "bias": -0.5}
#: The sample: this many pages at most, none above so many bytes; the most frequent names that are learned; precision of the prior.
SAMPLE_PAGES, SAMPLE_BYTES, LEARNED_NAMES, PRECISION = 300, 65_536, 500, 10.0
#: Smoothness of neighbours under one parent, of other neighbours, and of blocks that follow each other under one parent.
SAME_PARENT, NEIGHBOUR, SIBLING = 1.0, 0.25, 0.5


class Block(NamedTuple):
    text: str
    features: dict[str, float]  # "good" by names alone
    marked: bool  # an article or main element is around it
    named: float  # weights of the names around it
    number: int  # of its element and of the one around that
    parent: int


@dataclass(frozen=True)
class Model:
    """Weights of a block's own features and of the names and tags around it."""

    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    names: dict[str, float] = field(default_factory=dict)

    def score(self, block: Block) -> float:
        unseen = self.weights["good"] if block.marked and not block.features["good"] else 0.0
        return block.named + unseen + sum([self.weights[k] * x for k, x in block.features.items() if x])


def _names(tag: str, attributes: str) -> tuple[set[str], bool]:
    """Words in an element's class, id and role, and whether the element is hidden."""
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return names, True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return names, True
        elif key != "aria-label":
            names.update(x.lower() for x in _NAME.findall(value))
    return names, False


def _nature(tag: str, names: set[str], hidden: bool, good: bool) -> int:
    """-1 if an element marks boilerplate, 1 if its names mark content, else 0."""
    if tag in ("body", "html"):
        return 0
    if hidden or tag in _BAD_TAGS or tag == "header" and not good:
        return -1
    if names & _BAD_NAMES and not (names & _BAD_NAMES == {"header"} and (good or names & _GOOD_NAMES)):
        return -1
    return 1 if names & _GOOD_NAMES else 0


def blocks(html: str, learned: dict[str, float] | None = None, around: list[tuple[int, set[str]]] | None = None) -> list[Block]:
    """The text blocks of a page in page order. ``around`` receives every element's parent and names."""
    out: list[Block] = []
    stack: list[tuple] = [("", 0, 0, 0, 0, 0.0, ())]  # tag, number; bad, good, marked ones around; weight of all names; own names
    opened: Counter[str] = Counter()
    known: Counter[str] = Counter()  # names around, each of which weighs once however often it is there
    parts: list[str] = []
    made = links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                tag, number, bad, good, marked, named, _ = stack[-1]
                words = text.count(" ") + 1
                features = {
                    "bad": float(bad > 0),
                    "good": float(good > 0),
                    "paragraph": float(tag in ("p", "blockquote", "pre")),
                    "heading": float(tag[:1] == "h" and tag[1:].isdigit()),
                    "item": float(tag == "li"),
                    "words": min(2.0, words / 10),
                    "links": min(1.0, linked / max(1, len(text))),
                    "boiler": float(bool(words < 20 and _BOILER_TEXT.match(text))),
                    "bias": 1.0,
                }
                out.append(Block(text, features, marked > 0, named, number, stack[-2][1] if len(stack) > 1 else -1))
            parts.clear()
        linked = 0

    def close(tags: list[str], stop: str = "") -> None:
        if not any(opened[x] for x in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                opened.subtract(x[0] for x in stack[k:])
                known.subtract(name for x in stack[k:] for name in x[6])
                del stack[k:]
                return
            if stop and stack[k][0] in stop.split():
                return

    if around is not None:
        around.append((-1, set()))
    for m in _TOKEN.finditer(html):
        if m[5] is not None:
            parts.append(m[5])
            if links:
                linked += len(m[5])
        elif m[3] is not None:
            tag = m[3].lower()
            if tag in _INLINE:
                if tag == "a":
                    links = 0 if m[2] else 1
                elif tag in ("br", "img", "input"):
                    parts.append(" ")
                continue
            flush()
            links = 0
            if m[2]:
                close([tag])
            else:
                if tag in _ENDS_P:
                    close(["p"], "div section article td th li blockquote body table button")
                if tag in _CLOSED_BY_NEXT and tag != "p":
                    close(_CLOSED_BY_NEXT[tag].split(), "ul ol dl table select")
                if tag not in _VOID and not m[4].endswith("/"):
                    _, number, bad, good, marked, named, _ = stack[-1]
                    made += 1
                    names, hidden = _names(tag, m[4])
                    nature = _nature(tag, names, hidden, good + marked > 0)
                    if tag not in _UNLEARNED:
                        names.add(f"<{tag}>")
                    if around is not None:
                        around.append((number, names))
                    own = [x for x in names if x in learned] if learned and names else ()
                    named += sum(learned[x] for x in own if known[x] <= 0)
                    known.update(own)
                    stack.append((tag, made, bad + (nature < 0), good + (nature > 0), marked + (tag in _GOOD_TAGS), named, own))
                    opened[tag] += 1
        elif m[1] is not None and m[1].lower() not in ("script", "style", "noscript", "template"):
            parts.append(" ")
    flush()
    return out


def sample(pages: DataFrame, html_col: str = "html") -> list[str]:
    """At most ``SAMPLE_PAGES`` different pages of at most ``SAMPLE_BYTES`` bytes that mark their main text.

    They are those of the smallest hashes, the same under any partitioning. Only hashes are ordered; the pages of those
    that were chosen are read in a second scan, so that tasks send the driver no page in vain.
    """
    html = F.col(html_col).cast("string")
    marked = pages.select(html.alias("html")).where((F.octet_length("html") <= SAMPLE_BYTES) & F.col("html").rlike(r"(?i)<(article|main)\b")).withColumn("h", F.xxhash64("html"))
    chosen = [r.h for r in marked.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    if not chosen:
        return []
    rows = pages.select(html.alias("html")).withColumn("h", F.xxhash64("html")).where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).collect()
    return [r.html for r in sorted(rows, key=lambda r: r.h)]


def fit(pages: list[str]) -> Model:
    """Maximum a posteriori weights: blocks in an article or main element that nothing marks as boilerplate are content.

    Without pages the weights are the prior's.
    """
    rows: list[tuple[list[float], set[str], float]] = []
    for html in pages:
        around: list[tuple[int, set[str]]] = []
        for b in blocks(html, around=around):
            names: set[str] = set()
            at = b.number
            while at > 0:
                at, own = around[at]
                names |= own
            rows.append(([b.features[k] for k in PRIOR], names, float(b.marked and not b.features["bad"])))
            if b.features["bad"]:  # it would be boilerplate in an article too, as a paragraph and however long
                rows.append(([{**b.features, "good": 1.0, "paragraph": 1.0, "words": 2.0, "links": 0.0}[k] for k in PRIOR], names, 0.0))
    if not rows:
        return Model()
    seen = Counter(x for _, names, _ in rows for x in names)
    known = [x for x, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEARNED_NAMES]]
    place = {x: len(PRIOR) + i for i, x in enumerate(known)}
    data, label = np.zeros((len(rows), len(PRIOR) + len(known))), np.array([y for *_, y in rows])
    for i, (own, names, _) in enumerate(rows):
        data[i, : len(PRIOR)] = own
        data[i, [place[x] for x in names if x in place]] = 1.0
    prior = np.array([*PRIOR.values(), *[0.0] * len(known)])
    w = prior.copy()
    for _ in range(50):  # Newton steps on a strictly convex loss
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        slope = data.T @ (p - label) + PRECISION * (w - prior)
        step = np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + PRECISION * np.eye(len(w)), slope)
        w -= step / max(1.0, float(np.abs(step).max()))  # no weight moves by more than one at a time
        if np.abs(step).max() < 1e-6:
            break
    return Model(dict(zip(PRIOR, w.tolist())), dict(zip(known, w[len(PRIOR) :].tolist())))


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of the cheapest cut. A positive score is a source edge, else a sink edge."""
    n = len(scores)
    if not any((scores[a] > 0) != (scores[b] > 0) for a, b, _ in edges):
        return [s > 0 for s in scores]
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        for u, v, c in ((a, b, there), (b, a, back)):
            out[u].append(len(to))
            to.append(v)
            room.append(c)

    for i, s in enumerate(scores):
        join(source, i, s, 0) if s > 0 else join(i, sink, -s, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at, path, u = [0] * (n + 2), [], source
        while True:  # a blocking flow: walk forward along levels, step back at dead ends
            if u == sink:
                c = min(room[e] for e in path)
                for e in path:
                    room[e] -= c
                    room[e ^ 1] += c
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                at[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1


def labelled(html: str, model: Model) -> list[tuple[Block, float, bool]]:
    """Blocks, their scores, and whether the cut calls them content."""
    found = blocks(html, model.names)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, SAME_PARENT if found[i - 1].parent == b.parent else NEIGHBOUR))
        if last.get(b.parent, i - 1) < i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    scores = [model.score(b) for b in found]
    return list(zip(found, scores, minimum_cut(scores, edges)))


def main_text(html: str | None, model: Model | None = None) -> str:
    """Blocks of the main text, joined by two line ends."""
    return "\n\n".join(b.text for b, _, kept in labelled(html or "", model or Model()) if kept)


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """All columns but ``html_col``, and ``text``: the main text of each page.

    The classifier is ``model``, or one fitted on a ``sample`` of the pages. A null or empty page, or one without a block
    that is called content, has the empty text. Rows stay as they are otherwise, repeated ones too. A column named ``text``
    is replaced. An empty table gives an empty result.
    """
    others = [f for f in pages.schema.fields if f.name not in (html_col, "text")]
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*others, *StructType().add("text", StringType()).fields])
    fitted = model or fit(sample(pages, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), fitted) for h in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*[F.col(f"`{f.name}`") for f in others], F.col(html_col).cast("string")).mapInArrow(run, schema)
