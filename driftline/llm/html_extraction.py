"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is an element by its path of tags and classes,
and keeps how often each presentation (the order of its children) and each content (a block's text)
occurs on the host's distinct pages. A node's importance is the entropy of its presentations and,
where it holds text, one less the mean entropy of its contents; composed from the leaves up. Branches
all of whose nodes are of low importance are removed from each page, and with them what HTML itself
declares to be no content: page headers, menus, forms, adverts and the like.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import checkpointed, release

#: Importance under which a branch is noise; distinct pages of a host that must hold a node before it is judged; weight base of a node against its children.
LEAST, PAGES, DECAY = 0.2, 8, 0.9
#: Hosts and branches to remove, some tens of bytes each, up to which they are broadcast to the pages.
MOST_BROADCAST = 200_000
#: Elements nested deeper count as their ancestor at this depth.
DEEPEST = 48

# Names that HTML and common usage give to parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("head nav aside footer form script style title textarea iframe noembed noframes noscript template object applet svg canvas math audio video picture map button select datalist option fieldset input menu menuitem dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status tablist".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promoted promotion banner sidebar sidebars rail cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation breadcrumb breadcrumbs footer footers "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager masthead skiplink".split()
)
HEADER_NAMES = frozenset("header topbar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element that opens ends an open one of these, unless one of the fences is between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "body": ({"head"}, set()),
}

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    """A run of text of one element, and what stands above it."""

    node: int
    text: str
    noise: bool
    article: int  # 0 outside an article, else its number
    main: bool
    joins: bool  # goes on with the block before, after an element of no content within it


@dataclass
class Open:
    """An element that is open while a page is read."""

    tag: str
    node: int
    depth: int
    noise: bool
    article: int
    main: bool
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    blocks: list[Block]
    #: node -> its parent, its depth
    parents: dict[int, tuple[int, int]]
    #: (node, presentation) of every element
    styles: list[tuple[int, int]]


def hashed(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) - 2**63


def names_of(attributes: dict[str, str]) -> set[str]:
    """Words of an element's classes and id, in lower case."""
    both = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return {w.lower() for w in NAME.findall(both)} | set(re.findall("[a-z]+", both.lower()))


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if "=" in text or text.strip(" /"):
        for name, a, b, c in ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def step_of(tag: str, attributes: dict[str, str]) -> str:
    """What tells an element of a path: its tag, role and classes, without digits, which number things."""
    return f"{tag}.{'.'.join(sorted(set(re.sub(r'[0-9]+', '', attributes.get('class', '')).split())))}:{attributes.get('role', '')}"


def is_noise(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """True for elements that HTML or their names declare to be no content; a header `inside` an article is its heading."""
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return True
    names = names_of(attributes)
    return bool(names & NOISE_NAMES) or (not inside and bool(names & HEADER_NAMES))


def read(text: str) -> Page:
    """A page's blocks and elements, in one pass; unclosed elements end where HTML lets them end."""
    page = Page([], {}, [])
    root = Open("", 0, 0, False, 0, False)
    stack = [root]
    open_tags: dict[str, int] = {}
    words: list[str] = []
    articles = 0
    joins = False

    def flush() -> None:
        nonlocal words, joins
        if words and (joined := " ".join("".join(words).split())):
            top = stack[-1]
            page.blocks.append(Block(top.node, joined, top.noise, top.article, top.main, joins))
            top.children.append(1)
            joins = False
        words = []

    def close(upto: int) -> None:
        nonlocal joins
        flush()
        while len(stack) > upto:
            done = stack.pop()
            joins = done.tag in INLINE
            open_tags[done.tag] -= 1
            style: list[object] = []
            for child in done.children:  # runs of like children are one step with the logarithm of their number
                if style and style[-2] == child:
                    style[-1] += 1  # type: ignore[operator]
                else:
                    style += [child, 1]
            page.styles.append((done.node, hashed(*[x if i % 2 == 0 else int(x).bit_length() for i, x in enumerate(style)])))

    def close_open(tags: set[str] | frozenset[str], fences: set[str] | frozenset[str]) -> None:
        if not any(open_tags.get(t) for t in tags):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in fences:
                return
            if stack[at].tag in tags:
                close(at)
                if tags == {"p"} or not any(open_tags.get(t) for t in tags):
                    return

    at = 0
    while True:
        found = TOKEN.search(text, at)
        start = found.start() if found else len(text)
        if start > at:
            words.append(html.unescape(text[at:start]) if "&" in text[at:start] else text[at:start])
        if not found:
            break
        at = found.end()
        ended, opened, rest = found[1], found[2] or found[4], found[3] if found[2] else found[5]
        if ended:
            tag = ended.lower()
            if tag in INLINE:
                if tag in open_tags and open_tags[tag] > 0 and stack[-1].tag == tag:
                    close(len(stack) - 1)
            elif open_tags.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag in ("p", "br"):
                flush() if tag == "p" else words.append(" ")
            continue
        if not opened:
            continue
        tag = opened.lower()
        attributes = attributes_of(rest or "")
        top = stack[-1]
        noise = top.noise or is_noise(tag, attributes, bool(top.article or top.main))
        if tag in INLINE and not (noise and not top.noise):  # markup within a block, unless it is noise of its own
            if tag == "br":
                words.append("\n")
            continue
        if tag in CLOSES_P:
            close_open({"p"}, {"table", "td", "th", "button", "object"})
        if tag in ENDS:
            close_open(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag == "tr" and not noise:  # cells of a row are one block
            words.append(" ")
            continue
        flush()
        top = stack[-1]
        depth = min(top.depth + 1, DEEPEST)
        node = top.node if top.depth == DEEPEST else hashed(top.node, step_of(tag, attributes))
        page.parents[node] = page.parents.get(node, (top.node, depth))
        top.children.append(node)
        if tag not in INLINE:
            joins = False
        if tag in VOID:
            continue
        if tag == "article" and not noise and not top.article:
            articles += 1
        stack.append(Open(tag, node, depth, noise, top.article or (articles if tag == "article" and not noise else 0), top.main or tag == "main" or attributes.get("role", "").lower() == "main"))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(text, at)
            at = end.start() if end else len(text)
    flush()
    close(1)
    return page


def host_of(url: Column) -> Column:
    """A URL's host in lower case, without port and user; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


OCCURRENCES = "host string, node long, parent long, depth int, kind int, value long, page long"
#: Kinds of occurrences: a page that holds a node, a presentation, a content.
HELD, STYLE, CONTENT = 0, 1, 2


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page adds to its host's tree: (host, html) to rows of OCCURRENCES; `page` tells equal pages."""
    for batch in batches:
        out: list[tuple] = []
        for host, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = body or ""
            same = hashed(body)
            page = read(body)
            rows = {(node, HELD, 0) for node in page.parents}
            rows |= {(node, STYLE, style) for node, style in page.styles}
            rows |= {(block.node, CONTENT, hashed(block.text)) for block in page.blocks if block.node}
            out += [(host, node, *page.parents[node], kind, value, same) for node, kind, value in rows]
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "node", "parent", "depth", "kind", "value", "page"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, parent, depth, pages, own of each node of each host's tree that PAGES distinct pages hold; pages: (host, html).

    `own` is a node's importance: the entropy of its presentations over its pages, to the base of
    their number, or, where it holds text, the larger of that and one less the mean entropy of its contents.
    """
    once = pages.mapInArrow(occurrences, OCCURRENCES).groupBy("host", "node", "kind", "value", "page").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    counted = once.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("k"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    nodes = counted.groupBy("host", "node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max(F.when(F.col("kind") == HELD, F.col("k"))).alias("pages"),
        of(STYLE, F.col("k") * F.log("k")).alias("style_logs"), of(STYLE, F.col("k")).alias("styles"), of(CONTENT, F.log("k")).alias("content_logs"), of(CONTENT, F.lit(1.0)).alias("contents"),
    )
    nodes = nodes.where(F.col("pages") >= PAGES)
    log_m = F.log("pages")
    presentation = F.coalesce((F.log("styles") - F.col("style_logs") / F.col("styles")) / log_m, F.lit(0.0))
    content = F.coalesce(1 - F.col("content_logs") / F.col("contents") / log_m, F.lit(0.0))
    return nodes.select("host", "node", "parent", "depth", "pages", F.least(F.lit(1.0), F.greatest(presentation, content)).alias("own"))


def noise_branches(tree: DataFrame) -> DataFrame:
    """host, nodes: of each host the branches to remove, from the leaves up, level by level.

    A node's composite importance is its own and its children's mean, weighted by their pages; a
    node is noise if it and all below it are under LEAST. There are at most DEEPEST levels.
    """
    tree = checkpointed(tree)
    deepest = tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    below, marked = None, []
    for depth in range(deepest, 0, -1):
        level = tree.where(F.col("depth") == depth)
        if below is None:
            judged = level.select("host", "node", "parent", "pages", F.col("own").alias("composite"), F.col("own").alias("best"))
        else:
            children = below.groupBy("host", F.col("parent").alias("node")).agg((F.sum(F.col("composite") * F.col("pages")) / F.sum("pages")).alias("mean"), F.count(F.lit(1)).alias("n"), F.max("best").alias("most"))
            share = F.pow(F.lit(DECAY), F.col("n"))
            composite = F.when(F.col("n").isNull(), F.col("own")).otherwise((1 - share) * F.col("own") + share * F.col("mean"))
            joined = level.join(children, ["host", "node"], "left").withColumn("composite", composite)
            judged = joined.select("host", "node", "parent", "pages", "composite", F.greatest("composite", F.coalesce("most", F.lit(0.0))).alias("best"))
        below = checkpointed(judged) if depth > 1 else judged
        marked.append(below.where(F.col("best") < LEAST).select("host", "node"))
    found = tree.select("host", "node").limit(0)
    for m in marked:
        found = found.unionByName(m)
    return found.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("nodes"))


def main_text(page: Page, removed: set[int]) -> str:
    """A page's blocks without declared noise and removed branches; those of its articles, else of its main part, if it has one with text."""

    def gone(node: int) -> bool:
        while node:
            if node in removed:
                return True
            node = page.parents[node][0] if page.parents[node][0] != node else 0
        return False

    fine = [b for b in page.blocks if not b.noise]
    left = [b for b in fine if not gone(b.node)] if removed else fine
    kept = next((k for k in ([b for b in left if b.article], [b for b in left if b.main], left) if k), [])
    texts: list[str] = []
    last = 0
    for b in kept:
        if b.joins and b.node == last:
            texts[-1] += f" {b.text}"
        else:
            texts.append(b.text)
        last = b.node
    return "\n\n".join(texts)


def extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ident, url, body, nodes = batch.columns
        texts = [main_text(read(b or ""), set(gone or ())) for b, gone in zip(body.to_pylist(), nodes.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ident, url, pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html and pages without text give the empty text; pages of a null URL, or one
    without a host, make up a host of their own. Equal pages of a host count once in its tree, and
    a node is judged only where PAGES distinct pages hold it, so small hosts lose nothing to the
    tree. Rows that repeat each get their text; null ids are kept; other columns play no part; an
    empty table gives no rows. Whole pages are read, in time linear in their length. A host's
    branches to remove are one row; all of them are broadcast if they are MOST_BROADCAST at most, else
    pages meet them in a join by host, whose skewed hosts adaptive execution splits.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("body"), host_of(F.col(url_col)).alias("host"))
    removed = checkpointed(noise_branches(style_tree(rows.select("host", "body"))))
    release(pages.sparkSession)
    hosts, nodes = removed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("nodes")), F.lit(0))).first()
    if hosts + nodes <= MOST_BROADCAST:
        removed = F.broadcast(removed)
    met = rows.join(removed, "host", "left").select("id", "url", "body", "nodes")
    out = met.mapInArrow(extract_rows, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
