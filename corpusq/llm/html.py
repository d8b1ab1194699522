"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A tag with quoted values; where one begins, and its rest without regard to quotes.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BEGIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "head", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "summary", "figcaption"}
#: Start tag -> the open elements that it ends, and those beyond which it looks for none.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
SCOPE = frozenset("article aside blockquote body caption dd div dl fieldset figure footer form header html li main nav ol section table td th ul button".split())
#: What is not the article by its kind.
NOISE_TAGS = frozenset("head script style noscript template iframe object svg canvas button select datalist textarea form nav footer aside dialog menu title xmp".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense banner banners sponsor sponsored sponsors promo promos promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay "
    "subscribe subscription newsletter share sharing social related recommended recommendations widget widgets comment comments disqus respond replies toolbar pagination pager login signin signup search skip".split()
)
MODIFIERS = frozenset("no has with without is not hide show".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
MIN_PAGES, LOW, GAMMA = 5, 0.3, 0.9
#: A single text outside articles is cut only if this share of the pages that have its node have it.
TEXT_SHARE = 0.9
#: Hosts whose elements a task holds at once.
HELD = 64


@dataclass(slots=True)
class Node:
    """An element, its path told by a hash of tags and classes."""

    tag: str
    number: int  #: its place among the page's elements, in the order in which they begin
    path: int
    hard: bool  #: no article by its tag, role or state
    soft: bool  #: no article by its names; an article or main element inside is one all the same
    article: bool
    block: Node | None  #: the block that it is, or stands in
    outer: bool = False  #: whether its block is no article
    children: dict = field(default_factory=dict)


@dataclass
class Page:
    """The elements of a page: parents come before their children. Element 0 is the page itself."""

    parent: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    style: list[int] = field(default_factory=list)  #: a hash of which children each has
    blocks: list[tuple[str, int, bool]] = field(default_factory=list)  #: text, element, no article by its kind


#: Elements, child sequences and names come again on most pages of a host.
@lru_cache(1 << 16)
def path_of(parent: int, element: str) -> int:
    return signed(f"{parent}/{element}")


@lru_cache(1 << 16)
def style_of(*children: str) -> int:
    return signed(",".join(children))


def signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(1 << 16)
def named_noise(token: str, inside: bool) -> bool:
    """Whether a class or id names what is no article. Inside an article it must begin or end with the name, and its
    header stays. Names after "no", "has" and the like say what is elsewhere."""
    parts = re.split(r"[^a-z]+", re.sub(r"([a-z])(?=[A-Z])", r"\1-", token).lower().strip("-_"))
    if parts[0] in MODIFIERS:
        return False
    if not inside:
        return not NOISE_NAMES.isdisjoint(parts) or not HEADER_NAMES.isdisjoint(parts)
    return parts[0] in NOISE_NAMES or parts[-1] in NOISE_NAMES and parts[-1] not in ("widget", "widgets")


def element(tag: str, attributes: str, parent: Node, number: int) -> Node:
    names, hard, soft = "", tag in NOISE_TAGS, False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names += f".{value.lower()}" if name == "class" else ""
            soft |= any(named_noise(token, parent.article) for token in value.split())
        value = value.lower()
        hard |= name == "role" and value in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    main = tag in ("article", "main")
    if tag == "header":
        hard |= not (parent.article or main)
    plain = tag in ("html", "body") or main
    hard, soft = parent.hard or hard and not plain, not main and (parent.soft or soft and not plain)
    node = Node(tag, number, path_of(parent.path, tag + names), hard, soft, parent.article or main, parent.block)
    if tag in BLOCK:
        node.block, node.outer = node, hard or soft
    else:
        node.outer = parent.outer
    return node


def tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether it is an end tag, name, attributes) of each tag, and at the end the text left with no name.
    Comments and declarations are left out.

    The page is read once: where a tag's quotes do not end, quotes do not count from there on, and behind the last ">"
    there are no tags.
    """
    at, held, last, match = 0, 0, page.rfind(">"), TAG.match
    while 0 <= (at := page.find("<", at)) <= last:
        m = match(page, at)
        if not m and BEGIN.match(page, at):
            match = PLAIN.match
            m = match(page, at)
        if m:
            begin, at = at, m.end()
            ends, tag, attributes = m.groups()
            tag = tag.lower()
            yield page[held:begin], bool(ends), tag, attributes
            if tag in RAW and not ends:
                end = closing(tag).search(page, at)
                at = end.end() if end else len(page)
        elif page.startswith("<!--", at):
            yield page[held:at], False, "!", ""
            at = page.find("-->", at + 4) + 3
            at = at if at > 2 else len(page)
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            yield page[held:at], False, "!", ""
            at = page.find(">", at) + 1
        else:
            at += 1
            continue
        held = at
    yield page[held:], False, "", ""


@cache
def closing(tag: str) -> re.Pattern:
    """Where an element of RAW ends."""
    return re.compile(rf"</{tag}\s*>", re.I)


def parsed(html: str, styles: bool = True) -> Page:
    """The elements of a page and its blocks of text, in page order; `styles` too where they are asked for."""
    page, root = Page(), Node("", 0, signed(""), False, False, False, None)
    root.block = root
    stack, held, names = [root], [], {}
    page.parent, page.path, page.article, page.style = [0], [root.path], [False], [0]

    def flush() -> None:
        if held:
            text = "".join(held)
            if text := " ".join((entities.unescape(text) if "&" in text else text).split()):
                block = stack[-1].block
                page.blocks.append((text, block.number, block.outer))
            held.clear()

    def pop() -> None:
        if stack[-1].tag in BLOCK:
            flush()
        n = stack.pop()
        names[n.tag] -= 1
        if styles:
            page.style[n.number] = style_of(*n.children)

    for text, ends, tag, attributes in tags(html):
        if text and (stack[-1].outer or not (stack[-1].hard or stack[-1].soft)):
            held.append(text)
        if tag in ("", "!"):
            continue
        if ends:
            if names.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        if tag == "br":
            held.append(" ")
        if tag in CLOSES_P and names.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in SCOPE:
                    break
        closes, bounds = IMPLIED.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1) if closes and any(names.get(x) for x in closes) else ():
            if stack[k].tag in bounds:
                break
            if stack[k].tag in closes:
                while len(stack) > k:
                    pop()
                if tag not in ("tr", "tbody"):
                    break
        stack[-1].children[tag] = None
        if tag in VOID or tag in RAW:
            continue
        if not attributes.endswith("/") or tag in BLOCK:
            node = element(tag, attributes, stack[-1], len(page.parent))
            page.parent.append(stack[-1].number)
            page.path.append(node.path)
            page.article.append(node.article)
            page.style.append(0)
            names[tag] = names.get(tag, 0) + 1
            stack.append(node)
    while len(stack) > 1:
        pop()
    flush()
    page.style[0] = style_of(*root.children)
    return page


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def site_nodes(pages: DataFrame) -> DataFrame:
    """_host, _html, _copies -> one row per page and node of its tree: host, path, what stands there, whether that is
    a sequence of children (presentation) or a block's text (content), and how many pages of the host are the same."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for host, page, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                p = parsed(page)
                styles: dict[int, list[int]] = {}
                for path, style in zip(p.path, p.style):
                    styles.setdefault(path, []).append(style)
                rows = {(path, False, s[0] if len(s) == 1 else signed(",".join(map(str, s)))) for path, s in styles.items()} | {(p.path[n], True, signed(t)) for t, n, _ in p.blocks}
                for path, content, what in rows:
                    for to, x in zip(out, (host, path, content, what, copies), strict=True):
                        to.append(x)
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["host", "path", "content", "what", "copies"])

    return pages.select("_host", "_html", "_copies").mapInArrow(parse, "host string, path long, content boolean, what long, copies long")


def with_copies(pages: DataFrame) -> DataFrame:
    """_host, _html -> with _copies, how many pages of the host have that html. Only hashes are shuffled; the pages
    stay where they are read unless the list of repeated hashes is too large to broadcast."""
    p = pages.withColumn("_sha", F.sha2("_html", 256))
    many = written(p.groupBy("_host", "_sha").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1), "copies")
    return p.join(many, ["_host", "_sha"], "left").select("_host", "_html", F.coalesce("_copies", F.lit(1)).cast("long").alias("_copies"))


def importances(nodes: DataFrame, min_pages: int, low: float, gamma: float) -> DataFrame:
    """host -> its elements on `min_pages` different pages or more: (path, presentation, content); the (path, text) pairs
    that TEXT_SHARE of the pages with the path have (common); and those on `min_pages` or more, of paths with low content
    (repeated).

    With m pages that have the path, presentation importance is the entropy of the child sequences there to base m; that
    of a text is 1 - log_m(pages that have it), the entropy of its spread over the pages; content importance is the mean
    over the path's texts, null without any. Pages of a host with the same html are one page: each counts as its part
    of it, and sums are rounded to whole pages. Elements of full importance, as others are taken for, are left out.
    """
    counts = nodes.groupBy("host", "path", "content", "what").agg(F.round(F.sum(1 / F.col("copies"))).cast("long").alias("n"))
    counts = written(counts, "node-counts")  # used thrice, pages are parsed once for it
    style = counts.where(~F.col("content")).groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    style = style.where(F.col("m") >= min_pages).select("host", "path", "m", ((F.log("m") - F.col("s") / F.col("m")) / F.log("m")).alias("presentation"))
    texts = counts.where("content").drop("content").join(style, ["host", "path"]).withColumn("importance", 1 - F.log(F.least("n", "m")) / F.log("m"))
    content = texts.groupBy("host", "path").agg((F.sum(F.col("n") * F.col("importance")) / F.sum("n")).alias("content"))
    rows = style.drop("m").join(content, ["host", "path"], "left").where("presentation < 1 or content < 1").select("host", F.struct("path", "presentation", "content").alias("element"))
    said = texts.where(F.col("n") >= min_pages).join(content, ["host", "path"])
    said = said.select("host", F.col("path").bitwiseXOR(F.col("what")).alias("text"), (F.col("n") >= TEXT_SHARE * F.col("m")).alias("common"), (F.col("content") < low / gamma).alias("repeated")).where("common or repeated")
    said = said.select("host", F.lit(None).cast(rows.schema["element"].dataType).alias("element"), F.when(F.col("common"), F.col("text")).alias("common"), F.when(F.col("repeated"), F.col("text")).alias("repeated"))
    none = F.lit(None).cast("long")
    both = rows.withColumns({"common": none, "repeated": none}).unionByName(said)
    return both.groupBy("host").agg(*[F.collect_list(c).alias(c) for c in ("element", "common", "repeated")])


def noisy(page: Page, known: dict[int, tuple[float, float | None]], repeated: set[int], low: float, gamma: float) -> list[bool]:
    """Which elements are noise: those whose own composite importance and that of all elements with text inside are low.

    Composite importance is made bottom-up: (1 - gamma) presentation + gamma times the mean over the children that hold
    text, and over the element's own text. That is as important as texts of its path are, but 1 if it is not repeated on
    the host. What is not known is important.
    """
    n = len(page.parent)
    sums, parts, all_low = [0.0] * n, [0] * n, [True] * n
    for text, node, _ in page.blocks:
        content = known.get(page.path[node], (1.0, 1.0))[1]
        own = content if content is not None and page.path[node] ^ signed(text) in repeated else 1.0
        sums[node], parts[node] = max(sums[node], own), 1
    out = [False] * n
    for i in range(n - 1, -1, -1):
        if parts[i]:
            value = (1 - gamma) * known.get(page.path[i], (1.0, 1.0))[0] + gamma * sums[i] / parts[i]
            out[i] = all_low[i] and value < low
            if i:
                up = page.parent[i]
                sums[up], parts[up], all_low[up] = sums[up] + value, parts[up] + 1, all_low[up] and out[i]
    return out


def main_text(html: str, known: dict[int, tuple[float, float | None]] | None = None, common: Set[int] = frozenset(), repeated: Set[int] = frozenset(), low: float = LOW, gamma: float = GAMMA) -> str:
    """The blocks that are no noise by their kind, nor, outside article and main elements, by what is known of the host's
    elements and texts."""
    page = parsed(html, False)
    cut = noisy(page, known, repeated, low, gamma) if known else None
    keep = lambda text, node, outer: not outer and (page.article[node] or not (cut and cut[node]) and (not common or page.path[node] ^ signed(text) not in common))
    return "\n".join(b[0] for b in page.blocks if keep(*b))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, low: float = LOW, gamma: float = GAMMA) -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars.

    The pages of a host are merged into one style tree, of paths of tags and classes, with all that stands in them;
    pages with the same html are one page there. On each page the importance of its elements is composed bottom-up from
    that of the host's, and an element that is below `low` with all elements inside is cut as a branch, if it stands
    outside article and main elements; so is a text there that nine in ten of the pages with its path have. Both need
    `min_pages` different pages. What is not repeated on the host has high importance, whatever it is: menus, forms,
    adverts or comments are told by tag, role or name, inside an article as outside; an article or main element itself
    is not told by its name. Nothing else is dropped. Blocks are joined by a line feed, white space inside them is one
    space.

    Only hashes of nodes are shuffled, summed before; pages then meet the list of their host's
    elements and repeated texts, which is as long as its templates are.
    Null html: empty text. Pages with null or malformed URLs belong to no host: they have no tree, only the kinds. Very
    long pages are taken whole. Rows are kept as they are, repeated ones included. Other columns, whatever their
    names, are not read. Empty table: empty result.
    """
    p = pages.select(F.col(page_id).alias("_page"), F.col(url).alias("_url"), host_of(F.col(url)).alias("_host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    tree = written(importances(site_nodes(with_copies(p.where("_host <> ''"))), min_pages, low, gamma), "style-tree")
    d = p.join(tree, F.col("_host") == F.col("host"), "left").select("_page", "_url", "_html", "_host", "element", "common", "repeated")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[str] = []
            trees: dict[str, tuple] = {}
            for k, (page, host) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if host not in trees:
                    trees = trees if len(trees) < HELD else {}
                    trees[host] = ({e["path"]: (e["presentation"], e["content"]) for e in b.column(4)[k].as_py() or ()}, *(set(b.column(c)[k].as_py() or ()) for c in (5, 6)))
                made.append(main_text(page, *trees[host], low, gamma))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return d.mapInArrow(texts, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long").toDF(page_id, url, "text", "n_chars")
