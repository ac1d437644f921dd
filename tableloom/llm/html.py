"""Main text of web pages by consensus of host paths.

Every page scores its containers by the running text inside them. A container's path – its tags with their classes,
digits generalised – is voted on per host in Spark: pages of one host share a template, so the path that wins most of
the score over all pages is the template's article, also where a single page would mislead. The pages are then read
again along the winning path of their host; a page that has no such container falls back to its own best one. What is
chosen is then widened to the containers around it while these add little text besides, such as a heading or a lead.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import free_name
from tableloom.llm.common import Cache, named
from tableloom.session import materialise

BROADCAST_BYTES = 32 * 1024 * 1024
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select|object)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that never hold article text.
LEFT_OUT = frozenset("nav header footer aside form button head dialog menu".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Words of a class or id that mark furniture around the article.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion nav navbar navigation menu breadcrumb"
    " breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices banner popup modal"
    " newsletter subscribe subscription share sharing social related recommended comment comments disqus reply replies"
    " respond widget login signup pagination pager toolbar skip".split()
)
#: A furniture word after one of these names what the content lies beside: ``content-with-sidebar``, ``has-ads``.
BESIDE = frozenset("with without has have no non hide w".split())
#: Words that page builders and templates also put on content: these are furniture unless a content word stands next to
#: them – before a header (``entry-header`` holds the title), after the others (``widget-text``).
WEAK = frozenset("header widget notice notices banner toolbar skip".split())
CONTENT = frozenset("article body content entry main post story text section title".split())
#: What ``related`` lists; ``related-work`` is a section like any other.
LISTED = frozenset("post posts article articles story stories link links content items news topics pages list box reading videos".split())
#: Furniture also among inline elements and headings, and on an article that stands for a comment or an advert.
SMALL = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion share sharing social related recommended"
    " newsletter subscribe cookie cookies comment comments reply replies breadcrumb breadcrumbs".split()
)
INLINE = frozenset("span a ins small strong em b i label h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div article main section center td".split())
#: Elements that end a run of text.
BLOCKS = CONTAINERS | LEFT_OUT | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption figure figcaption hr"
    " address details summary fieldset hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STACKED = CONTAINERS | LEFT_OUT | frozenset(
    "ul ol li dl dt dd table thead tbody tfoot tr th blockquote figure figcaption pre p details fieldset address".split()
)
#: An opening tag ends an open element of the first kind, up to the nearest of the second.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
DIGITS = re.compile(r"\d+")
#: Not widened to: the whole page.
WHOLE = frozenset(("", "body", "html"))
KINDS = {"": 0.5, "article": 1.3, "main": 1.15, "body": 0.8, "html": 0.6}


def marks(name: str) -> set[str]:
    """The furniture words that one class or id is named after."""
    parts = [p for p in re.split(r"[-_:.]+", DIGITS.sub("", name)) if p]
    found = set()
    for i, part in enumerate(parts):
        if part not in FURNITURE or (i and parts[i - 1] in BESIDE):
            continue
        if part == "related" and i + 1 < len(parts) and parts[i + 1] not in LISTED | FURNITURE:
            continue
        near = parts[:i] if part == "header" else parts[i + 1 :]
        if part in WEAK and CONTENT.intersection(near):
            continue
        found.add(part)
    return found


MARKS = Cache(marks, 20_000)


def attributes(text: str) -> tuple[tuple[str, ...], set[str]]:
    """Generalised classes, and the furniture words and roles of class, id and role."""
    classes: tuple[str, ...] = ()
    furniture: set[str] = set()
    for name, *values in ATTRIBUTE.findall(text):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            furniture |= LEFT_OUT_ROLES & {value.strip()}
            continue
        if name.lower() == "class":
            classes = tuple(sorted({DIGITS.sub("#", c) for c in value.split()}))
        for one in value.split():
            furniture |= MARKS[one]
    return classes, furniture


class Node:
    __slots__ = ("tag", "path", "skip", "order", "depth", "up", "chars", "linked")

    def __init__(self, tag: str, path: str, skip: bool, order: int, depth: int, up: int = -1):
        self.tag, self.path, self.skip, self.order, self.depth, self.up = tag, path, skip, order, depth, up
        self.chars = self.linked = 0


def read(page: str) -> tuple[list[Node], list[tuple[str, tuple[int, ...], bool]]]:
    """The page's containers and its blocks: text with the numbers of the containers around it, and whether it is an
    item of a list of links; furniture left out."""
    root = Node("", "", False, 0, 0)
    containers, blocks, stack = [root], [], [root]
    run: list[str] = []
    links = linked = 0
    muted, nested = "", 0  # an inline element or heading that is furniture; it ends with its tag or the next block

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text and not stack[-1].skip:
            around = tuple(n.order for n in stack if n.order >= 0)
            blocks.append((text, around, 2 * linked >= len(text) and any(n.tag == "li" for n in stack)))
            for order in around:
                containers[order].chars += len(text)
                containers[order].linked += min(linked, len(text))
        linked = 0

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at and not stack[-1].skip and not muted:
            piece = page[at : m.start()]
            run.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
        elif tag == "a":
            links = 0 if m["close"] else 1
        if muted:
            nested += (-1 if m["close"] else 1) if tag == muted else 0
            if nested <= 0 or (tag in BLOCKS and tag != muted):
                muted = ""
        elif tag in INLINE and m["rest"] and not m["close"] and not any(n.tag == "pre" for n in stack):
            if attributes(m["rest"])[1] & SMALL:
                muted, nested = tag, 1
        if tag not in BLOCKS:
            continue
        close()
        if tag in VOID or tag not in STACKED:
            continue
        links = 0
        if m["close"]:
            if any(n.tag == tag for n in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag in CLOSES:
            own, limit = CLOSES[tag]
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in own | limit), 0)
            if depth and stack[depth].tag in own:
                del stack[depth:]
        while stack[-1].tag == "p":  # any block ends a paragraph
            stack.pop()
        classes, furniture = attributes(m["rest"]) if m["rest"] else ((), set())
        top = stack[-1]
        if tag == "article" and not any(n.tag == "article" for n in stack):
            furniture = furniture & SMALL  # the outermost article is content unless it is a comment or an advert
        skip = top.skip or tag in LEFT_OUT or (bool(furniture) and tag not in ("html", "body", "main"))
        if tag in CONTAINERS and not skip:
            path = f"{top.path}/{'.'.join((tag, *classes))}"
            up = next(n.order for n in reversed(stack) if n.order >= 0)
            node = Node(tag, path, False, len(containers), top.depth + 1, up)
            containers.append(node)
        else:
            node = Node(tag, top.path, skip, -1, top.depth)
        stack.append(node)
    if at < len(page) and not stack[-1].skip and not muted:
        run.append(page[at:])
    close()
    return containers, blocks


def scores(containers: list[Node]) -> list[float]:
    """Running text inside, links counting against it; deeper containers win over those that only wrap them."""
    return [max(0, n.chars - 2 * n.linked) * KINDS.get(n.tag, 1.0) * (1 + 0.01 * n.depth) for n in containers]


def votes(page: str | None) -> dict[str, float]:
    """Share of the page's best score for each container path."""
    containers, _ = read(page or "")
    own = scores(containers)
    best, found = max(own), {}
    if best > 0:
        for node, score in zip(containers, own):
            if score >= best / 2:
                found[node.path] = max(found.get(node.path, 0.0), score / best)
    return found


def extract(page: str | None, path: str | None) -> str:
    """Text of the containers at ``path``, or of the page's own best one where they hold less than half of its score or
    lie inside it; and of the containers around while these add at most half as much, lists of links apart."""
    containers, blocks = read(page or "")
    own = scores(containers)
    best = max(range(len(own)), key=lambda i: (own[i], -i))
    wanted = {n.order for n in containers if path is not None and n.path == path}
    if not wanted or sum(own[i] for i in wanted) < own[best] / 2 or all(inside(containers, i, best) for i in wanted):
        wanted = {best}
    taken = {k for k, (_, around, _) in enumerate(blocks) if not wanted.isdisjoint(around)}
    at = containers[min(wanted)].up
    while at >= 0 and containers[at].tag not in WHOLE and all(inside(containers, i, at) for i in wanted):
        size = sum(len(blocks[k][0]) for k in taken)
        if containers[at].chars > size:
            more = {k for k, (_, around, listed) in enumerate(blocks) if at in around and not listed} - taken
            if 2 * sum(len(blocks[k][0]) for k in more) > size:
                break
            taken |= more
        at = containers[at].up
    return "\n".join(blocks[k][0] for k in sorted(taken))


def inside(containers: list[Node], one: int, other: int) -> bool:
    """Whether container ``one`` is ``other`` or lies in it."""
    while one > other:  # containers are numbered from the outside in
        one = containers[one].up
    return one == other


def host_of(url: Column) -> Column:
    """Between ``://`` and the next ``/``, ``?`` or ``#``, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path): the container path with the largest sum of votes over all pages of a host; ties to the smaller path.

    Votes are summed per task before they move, so a host with a third of all pages is a few rows per task.
    """
    chosen = pages.select(host_of(named(url)).alias("host"), named(page).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, shares = [], [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, share in votes(text).items():
                    hosts.append(host)
                    paths.append(path)
                    shares.append(round(share * 1_000_000))  # whole numbers: sums do not depend on order
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())],
                names=["host", "path", "share"],
            )

    sums = chosen.mapInArrow(run, "host string, path string, share bigint").groupBy("host", "path").agg(F.sum("share").alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def main_text(pages: DataFrame, url: str = "url", page: str = "html", to: str = "text") -> DataFrame:
    """Adds ``to``, the page's main text: blocks in page order joined by line feeds, white space within one made single.

    Null or empty pages, and pages without text, give the empty text. Pages without a host vote together. Text outside
    any element counts as the page's. Repeated rows are read each; other columns stay, one named like ``to`` is replaced.
    """
    paths = materialise(winning_paths(pages, url, page))
    host, path = free_name(pages, "host"), free_name(pages, "path")
    size = paths.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 32), F.lit(0))).first()[0]
    table = paths.select(F.col("host").alias(host), F.col("path").alias(path))
    table = F.broadcast(table) if 4 * size <= BROADCAST_BYTES else table

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, wanted in batches:
            yield pd.Series([extract(t, w if isinstance(w, str) else None) for t, w in zip(texts, wanted)], dtype=object)

    joined = pages.join(table, host_of(named(url)) == named(host), "left")
    return joined.withColumn(to, extracted(named(page).cast("string"), named(path))).drop(host, path)
