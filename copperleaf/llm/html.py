"""Operator 7, HTML extraction: content and boilerplate blocks parted by a minimum cut.

A page becomes blocks of text, each with the elements it lies in. A linear classifier over statistics of the text and
over words in the names (class, id, role) of its elements gives each block a score; elements whose tag says their role
add evidence. As a terminal capacity, the score is what it costs to label the block against it. Smoothness edges join
each block to the next one and to the next one of the same parent, the stronger the closer they are in the DOM. A maximum
flow from the content terminal to the boilerplate terminal separates the two with the least total cost: a block that
alone looks like boilerplate stays with the paragraphs around it, one name or tag decides nothing by itself. Names of
notices (adverts, newsletters, consent, sharing, related pages, comments) are terminal costs of everything in their element, inside
an article too, unless the element holds most of the page's text.

The classifier (least squares, drawn to the weights PRIOR where the data say nothing) is trained here on the blocks of
TRAIN_PAGES pages of the smallest hash, a bound that does not depend on the input; blocks inside elements whose tag says
their role are the labelled samples. Only sums of products leave the tasks. Every page is labelled alone: no shuffle.

Defined results: a null or empty page, or one without text or content, gives the empty string; repeated rows are
extracted row by row; an empty table gives no rows; a page of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, smallest, table

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9]*)(?P<rest>(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[/!?]?[a-z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
# HTML elements that are passed over whole, if they end.
WHOLE_TAGS = frozenset("noscript template svg iframe object select".split())
# HTML elements that begin a block, those whose tag says boilerplate or content.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
AWAY_TAGS = frozenset("nav footer header aside form menu dialog button fieldset".split())
HERE_TAGS = frozenset("article main".split())
#: Their names say what a page or text is, not that it is none.
UNNAMED = HERE_TAGS | {"html", "body"}
# Words in names that speak for boilerplate, for content, or say nothing beside others.
AWAY_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Those among them that name a notice, whatever content they stand beside (related-posts, article-comments).
NOTICE_WORDS = AWAY_WORDS - frozenset("banner header masthead menu".split())
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
HERE_WORDS = frozenset("article articlebody body content entry main post story text".split())
PLAIN_WORDS = frozenset("area bar block bottom box container global group inner item items left link links list outer page right row section site slot top unit user wrap wrapper".split())
#: A word after one of these is not said of the element itself.
NOT_OWN = frozenset("has no with without hide is".split())
NAME = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
TRAIN_PAGES = 1000
#: What the tag of an element says of the blocks in it, beside scores of about -2 to 2.
AWAY, HERE = -4.0, 2.0
#: What a notice's name says of all blocks in it, in place of HERE. A notice holds less than SHARE of the page's text; a
#: name around more of it says nothing.
NOTICE, SHARE = -5.0, 0.5
NEXT, SIBLING = 0.5, 0.7
#: Weights before any data: constant, length, share of links, punctuation, paragraph, heading, depth; names that say
#: boilerplate, that say it among other words, that say content.
PRIOR = [-1.0, 2.5, -2.0, 0.5, 0.5, 0.5, 0.0, -2.0, -0.4, 0.3]
#: Rows of data that the prior weighs.
PRIOR_ROWS = 20.0
FEATURES = len(PRIOR)


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    tag: str
    role: int  # of the tags around it: -1 boilerplate, 1 content, 0 neither
    names: tuple[int, int, int]  # elements around it whose names say boilerplate, say it among other words, say content
    parent: int
    depth: int
    notices: tuple[int, ...]  # elements around it that are named as notices, negative for comments


class Open(NamedTuple):
    tag: str
    role: int
    names: tuple[int, int, int]
    serial: int
    notices: tuple[int, ...]


def name_says(rest: str) -> tuple[int, int, int]:
    """Whether an element's names say boilerplate, say it among other words, or say content (see Block)."""
    away = part = here = 0
    for m in NAME.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in WORD.findall(name)]
            if NOT_OWN.intersection(words):
                continue
            bad, good = AWAY_WORDS.intersection(words), HERE_WORDS.intersection(words)
            if bad and not good - {"body", "content", "text"}:
                if all(w in AWAY_WORDS or w in PLAIN_WORDS or w in HERE_WORDS or w.isdigit() for w in words):
                    away = 1
                else:
                    part = 1
            elif good and not bad:
                here = 1
    return (1, 0, 0) if away else (0, part, here)


def notice(rest: str) -> str:
    """Whether a name of an element is that of a notice: words of notices beside none but plain ones and words of content.
    Empty if not, else "comment" or "notice"."""
    for m in NAME.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in WORD.findall(name)}
            if words & NOTICE_WORDS and not words & NOT_OWN and all(w in NOTICE_WORDS or {w, w.removesuffix("s")} & (PLAIN_WORDS | HERE_WORDS) or w.isdigit() for w in words):
                return "comment" if words & COMMENT_WORDS else "notice"
    return ""


def entered(tag: str, rest: str, above: Open, serial: int) -> Open:
    """An element that begins inside another one."""
    names = name_says(rest) if rest and tag not in UNNAMED else (0, 0, 0)
    role = above.role
    own_kind = tag in HERE_TAGS and rest and name_says(rest)[0]  # an article named comment stays what it lies in
    if tag in AWAY_TAGS and not (tag == "header" and role > 0):
        role = -1
    elif tag in HERE_TAGS and not own_kind:
        if above.role < 0:  # a page wrapped in a form has its content all the same
            above = above._replace(names=(0, 0, 0))
        role = 1
    kind = notice(rest) if rest and tag not in UNNAMED else ""
    noticed = (-serial if kind == "comment" else serial,) if kind else ()
    return Open(tag, role, tuple(min(1, a + b) for a, b in zip(above.names, names, strict=True)), serial, above.notices + noticed)


def parsed(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [Open("", 0, (0, 0, 0), 0, ())]
    open_tags: Counter[str] = Counter()
    endless: set[str] = set()  # elements to be passed over that don't end in what is left
    text: list[str] = []
    link = serial = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                top = stack[-1]
                out.append(Block(words, linked, top.tag, top.role, top.names, stack[-2].serial if top.tag in ("p", "li") and len(stack) > 1 else top.serial, len(stack), top.notices))
            text.clear()
        linked = 0

    while m := MARK.search(page, at):
        if m.start() > at:
            text.append(piece := page[at : m.start()])
            if link:
                linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            text.append(" " if m["raw"] else "")
            continue
        tag = tag.lower()
        if tag in WHOLE_TAGS and not m["end"] and tag not in endless:
            if end := re.compile(rf"</{tag}\s*>", re.I).search(page, at):
                text.append(" ")
                at = end.end()
                continue
            endless.add(tag)
        if tag == "a":
            link = 0 if m["end"] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK_TAGS or tag in AWAY_TAGS:
            flush()
            if m["end"]:
                while open_tags[tag]:
                    open_tags[last := stack.pop().tag] -= 1
                    if last == tag:
                        break
                link = 0
            else:
                if stack[-1].tag == "p" or tag == stack[-1].tag == "li":
                    open_tags[stack.pop().tag] -= 1
                if tag != "hr":
                    serial += 1
                    open_tags[tag] += 1
                    stack.append(entered(tag, m["rest"], stack[-1], serial))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def in_notices(found: list[Block]) -> list[bool]:
    """Whether each block lies in a notice: an element of such a name that holds less than SHARE of the text beside
    boilerplate, or one of comments, however long."""
    held: Counter[int] = Counter()
    total = 0
    for x in found:
        if x.role >= 0:
            total += len(x.text)
            held.update(dict.fromkeys(x.notices, len(x.text)))
    return [any(k < 0 or held[k] < SHARE * total for k in x.notices) for x in found]


def settled(found: list[Block]) -> list[tuple[Block, bool]]:
    """Each block with whether it lies in a notice. Names of elements that are none, for all they hold, are taken back."""
    return [(x if away or not x.notices else x._replace(names=(0, *x.names[1:])), away) for x, away in zip(found, in_notices(found), strict=True)]


def features(x: Block) -> list[float]:
    n = x.text.count(" ") + 1
    return [1.0, math.log1p(n) / 4, min(1.0, x.linked / len(x.text)), min(1.0, sum(map(x.text.count, ".,;:!?")) / n), float(x.tag == "p"), float(x.tag[:1] == "h" and len(x.tag) == 2), min(x.depth, 12) / 12, *map(float, x.names)]


def fit(pages: DataFrame, rows: int = TRAIN_PAGES) -> list[float]:
    """Weights of the features, from blocks whose tags say their role. Without any of one kind, PRIOR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FEATURES + 2, FEATURES))
        for b in batches:
            for page in b.column(0).to_pylist():
                for x, away in settled(parsed(page or "")):
                    if role := -1 if away else x.role:
                        f = np.array(features(x))
                        sums[:FEATURES] += np.outer(f, f)
                        sums[FEATURES] += role * f
                        sums[FEATURES + 1, int(role > 0)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(sums.size)), pa.array(sums.ravel())], ["i", "v"])

    own = smallest(pages.select("page_id", "html"), rows, "page_id", "html").select("html")
    total = own.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row a sum
    sums = np.zeros((FEATURES + 2) * FEATURES)
    for i, v in total:
        sums[i] = v
    sums = sums.reshape(FEATURES + 2, FEATURES)
    if not sums[FEATURES + 1, :2].all():
        return PRIOR
    weights = np.linalg.solve(sums[:FEATURES] + PRIOR_ROWS * np.eye(FEATURES), sums[FEATURES] + PRIOR_ROWS * np.array(PRIOR))
    return np.round(weights, 6).tolist()  # sums come in any order


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the content side of a minimum cut. Terminal capacities: positive scores from the content
    terminal, negative ones to the other; edges hold in both directions. Flow is pushed along shortest paths, level by level."""
    n = len(scores)
    source, sink = n, n + 1
    near: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        near[a].append(len(to))
        to.append(b)
        left.append(forth)
        near[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, s in enumerate(scores):
        join(source, i, s, 0.0) if s > 0 else join(i, sink, -s, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for x in queue:
            for e in near[x]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                least = min(left[e] for e in path)
                for e in path:
                    left[e] -= least
                    left[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if left[e] <= 1e-9)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[x] < len(near[x]):
                e = near[x][tried[x]]
                if left[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                tried[x] += 1
            if tried[x] < len(near[x]):
                path.append(near[x][tried[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                tried[x] += 1
            else:
                break


def scored(found: list[Block], weights: list[float]) -> list[float]:
    """Each block's score alone: positive for content."""
    said = lambda x, away: NOTICE if away and x.role >= 0 else (0.0, HERE, AWAY)[x.role]
    return [2 * sum(w * f for w, f in zip(weights, features(x), strict=True)) + said(x, away) for x, away in settled(found)]


def labelled(found: list[Block], weights: list[float]) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    edges, last = [], {}
    for i, x in enumerate(found):
        if i:
            gap = abs(x.depth - found[i - 1].depth) + 2 * sum(a != b for a, b in zip((x.role, x.names, x.notices), (found[i - 1].role, found[i - 1].names, found[i - 1].notices), strict=True))
            edges.append((i - 1, i, NEXT / (1 + gap)))
        if (k := last.get(x.parent)) is not None:
            edges.append((k, i, SIBLING / (1 + 2 * (x.notices != found[k].notices))))
        last[x.parent] = i
    return content_side(scored(found, weights), edges)


def main_text(page: str | None, weights: list[float]) -> str:
    found = parsed(page or "")
    return "\n\n".join(x.text for x, keep in zip(found, labelled(found, weights), strict=True) if keep) if found else ""


def extract(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """page_id, url, text of each row."""
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x, weights) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
