"""Main text of web pages with site template removal.

Pass one parses every page, hashes the subtree of each block element bottom-up, and Spark counts, per host, under how many
different titles each subtree stands. Pass two leaves out the subtrees that recur, in and outside the article, and then takes
the main text. What counts cannot know goes by tags, roles and, last, words of class names (`marks`): texts that differ from
page to page, as reader comments, and hosts of few pages.

Within an article or main element only containers are counted (CONTAINERS), and none that holds half of its text: paragraphs,
headings and single cells are the article's own, and an article that is copied under other titles stays. Pages with one
title count once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A subtree is a template of its host if it stands under so many titles.
LEAST_TITLES = 5
#: Template hashes (of all hosts together, 8 bytes each) that may be broadcast; they are counted first.
BROADCAST_HASHES = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
#: Elements that are never part of the main text.
DROP = frozenset("script style textarea title noscript iframe xmp template noframes head nav aside footer form button select option dialog menu svg canvas object audio video map input datalist fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status tooltip".split())
#: Words of class and id that mark what counts cannot find.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars aside footer "
    "masthead topbar cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments respond replies reply disqus discussion widget widgets toolbar pagination pager skip skiplink header copyright disclaimer survey paywall trending popular".split()
)
#: What may be a template inside the main element.
CONTAINERS = frozenset("div section aside nav ul ol dl table figure form fieldset details header footer address center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_P = BLOCK - {"option", "summary", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
FENCES = frozenset("table td th ul ol dl button object article section div body html main".split())

TOKEN = re.compile(
    r"<!--(?:>|->)?.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element. After `measure`: size (characters of text), linked (those in links), and the hash of the subtree."""

    __slots__ = ("tag", "attrs", "kids", "size", "linked", "holds_main", "holds_title", "hash")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


def parse(page: str) -> list[Node]:
    """The elements of a tolerant tree in page order, the root first; nesting may have any depth.

    Elements left open end with their parent, an open paragraph ends at the next block.
    """
    nodes = [Node("#root")]
    stack, open_ = [nodes[0]], Counter()
    at = 0

    def close(i: int) -> None:
        open_.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in VOID:
                if tag == "br":
                    stack[-1].kids.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in FENCES and stack[i].tag in FENCES and tag not in BLOCK:
                    break
        elif m[2] or m[4]:
            tag, attrs = (m[2] or m[4]).lower(), m[3] if m[2] else m[5]
            if tag in KEEPS_P or tag in CLOSES:
                ends = CLOSES.get(tag, ()) + (("p",) if tag in KEEPS_P else ())
                for i in range(len(stack) - 1, 0, -1) if any(open_[e] > 0 for e in ends) else ():
                    if stack[i].tag in ends:
                        close(i)
                        if "p" not in ends or tag not in CLOSES:
                            break
                    elif stack[i].tag in FENCES:
                        break
            node = Node(tag, attrs)
            nodes.append(node)
            stack[-1].kids.append(node)
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                node.kids.append(page[at : end.start() if end else len(page)])
                at = end.end() if end else len(page)
            elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
                stack.append(node)
                open_[tag] += 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return nodes


def measure(nodes: list[Node]) -> list[Node]:
    """Fills in what is known of each subtree, all in one pass from the last element to the first: children come behind parents."""
    for node in reversed(nodes):
        size = linked = 0
        main = title = False
        said = [node.tag, " ".join(node.attrs.split())]
        for k in node.kids:
            if isinstance(k, str):
                k = " ".join(k.split())
                size += len(k)
                said.append(k)
                continue
            if k.tag != "script" and k.tag != "style":
                size += k.size
                linked += k.size if k.tag == "a" else k.linked
            main = main or k.holds_main or k.tag in ("article", "main")
            title = title or k.holds_title or k.tag in ("h1", "h2")
            said.append(f"\1{k.hash:x}")
        node.size, node.linked, node.holds_main, node.holds_title = size, linked, main, title
        node.hash = xxhash.xxh64_intdigest("\0".join(said).encode("utf-8", "replace"))
    return nodes


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attrs)} if node.attrs else {}


def declared(node: Node, in_main: bool, marks: frozenset[str] = MARKS) -> bool:
    """Whether tag, role, visibility or a marking class name say that the element is not main text."""
    if node.tag in DROP:
        return not (node.tag in ("form", "fieldset") and node.holds_main)
    if node.tag == "header":
        return not in_main and not node.holds_main
    if not node.attrs or node.tag in ("html", "body", "main", "article"):
        return False
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}"
    marked = a.get("role", "").lower() in ROLES or any(w.lower() in marks for w in WORD.findall(names))
    if not marked or node.holds_main:
        return False
    return not ("header" in names.lower() and in_main and node.holds_title)


def below(root: Node, enter) -> Iterator[tuple[Node, bool]]:
    """(element, inside) below the root in page order; enter(element, inside) says whether its children come too, and their flag."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is not root:
            yield node, inside
        deeper = (True, inside) if node is root else enter(node, inside)
        if deeper[0]:
            stack += [(k, deeper[1]) for k in reversed(node.kids) if not isinstance(k, str)]


def main_node(root: Node, marks: frozenset[str] = MARKS) -> Node:
    """The article with the most text; without one, the main element, else the whole page."""
    articles: list[Node] = []
    mains: list[Node] = []

    def enter(k: Node, _: bool) -> tuple[bool, bool]:
        return not declared(k, False, marks) and k.tag != "article", False

    for k, _ in below(root, enter):
        if declared(k, False, marks):
            continue
        if k.tag == "article":
            articles.append(k)
        elif k.tag == "main" or "main" in k.attrs and attributes(k).get("role", "").lower() == "main":
            mains.append(k)
    return max(articles or mains or [root], key=lambda n: n.size)


def candidates(root: Node, main: Node) -> list[Node]:
    """The block elements that could be templates: all with text outside the main element, containers of less than half its text inside."""
    out = []
    for k, inside in below(root, lambda k, inside: (k.tag not in RAW, inside or k is main)):
        if k.tag in BLOCK and k is not main and k.size and not k.holds_main and k.tag not in ("html", "body", "article", "main"):
            if not inside or k.tag in CONTAINERS and 2 * k.size < main.size:
                out.append(k)
    return out


def of_host(nodes: list[Node], host: str) -> np.ndarray:
    """Signed hashes of the subtrees as parts of a host."""
    salt = host.encode()
    return np.fromiter((xxhash.xxh64_intdigest(n.hash.to_bytes(8, "little") + salt) for n in nodes), np.uint64, len(nodes)).view(np.int64)


def title_of(nodes: list[Node]) -> str:
    """The page's title, else its first heading."""
    for k in nodes:
        if k.tag in ("title", "h1") and k.size:
            said, stack = [], [k]
            while stack:
                x = stack.pop()
                if isinstance(x, str):
                    said.append(x)
                else:
                    stack += reversed(x.kids)
            return " ".join(" ".join(said).split())
    return ""


def main_text(page: str | None, templates: np.ndarray | None = None, host: str = "", marks: frozenset[str] = MARKS) -> str:
    """The main text: one line per block, white space folded, character references decoded. templates: sorted hashes `of_host`."""
    if not page:
        return ""
    root = measure(parse(page))[0]
    main = main_node(root, marks)
    in_main = main is not root
    gone: set[int] = set()
    if templates is not None and len(templates):
        found = candidates(root, main)
        hashes = of_host(found, host)
        at = np.minimum(np.searchsorted(templates, hashes), len(templates) - 1)
        gone = {id(found[i]) for i in np.flatnonzero(templates[at] == hashes).tolist()}
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        line = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if line:
            blocks.append(line)

    # what is left to do, last first: (text, element or None for a block's end, below a header)
    todo: list[tuple] = [(k, False) for k in reversed(main.kids)]
    while todo:
        k, header = todo.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            if not header:
                held.append(k)
        elif k.tag in ("br", "wbr"):
            held.append(" " if k.tag == "br" else "")
        elif id(k) in gone:
            end()
        elif declared(k, in_main, marks):
            held.append(" ")
        else:
            if k.tag in BLOCK:
                end()
                todo.append((None, False))
            header = (header or k.tag == "header") and k.tag not in HEADINGS
            todo += [(x, header) for x in reversed(k.kids)]
    end()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(authority)


def _subtrees(marks: frozenset[str]):
    kind = pa.struct([("title", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b, hosts in batches:
            titles, hashes = [], []
            for x, host in zip(b, hosts, strict=True):
                nodes = measure(parse(x.as_py() or ""))
                titles.append(xxhash.xxh64_intdigest(title_of(nodes)) >> 1)
                hashes.append(np.unique(of_host(candidates(nodes[0], main_node(nodes[0], marks)), host.as_py())))
            yield pa.StructArray.from_arrays([pa.array(titles, pa.int64()), pa.array(hashes, kind[1].type)], fields=list(kind))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "title long, hashes array<long>")


def templates(pages: DataFrame, least_titles: int = LEAST_TITLES, marks: frozenset[str] = MARKS) -> DataFrame:
    """(hash), a written table: the subtrees, as parts of their hosts, that stand under at least `least_titles` titles.

    The counts are taken over (hash, title) and added up before any shuffle; a hash belongs to one host, so a host may hold
    any share of the pages.
    """
    rows = pages.select(_subtrees(marks)(F.col("html"), host_of(F.col("url"))).alias("c"))
    rows = rows.select(F.col("c.title").alias("title"), F.explode("c.hashes").alias("hash")).distinct()
    return written(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_titles).select("hash"))


def extract(pages: DataFrame, least_titles: int = LEAST_TITLES, marks: frozenset[str] = MARKS, broadcast: int = BROADCAST_HASHES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. A null or empty html gives an empty text; a null url has the host ''.

    Repeated pages give equal rows and count once as templates. Texts of any length are taken whole, at any depth of nesting.
    An empty table gives no rows; other columns are not read. Up to `broadcast` template hashes are given to every task;
    with more, each page gets its own by a join, whatever its host.
    """
    found = templates(pages, least_titles, marks)
    host = host_of(F.col("url"))
    if found.limit(broadcast + 1).count() <= broadcast:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(found.toArrow().column(0).to_numpy()))

        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for pages_, hosts in batches:
                yield pa.array([main_text(p.as_py(), known.value, h.as_py(), marks) for p, h in zip(pages_, hosts, strict=True)], pa.string())

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        text = F.arrow_udf(run, "string")(F.col("html"), host)
        return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

    def own(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages_, hosts, hashes in batches:
            yield pa.array([main_text(p.as_py(), np.array(x.as_py() or [], np.int64), h.as_py(), marks) for p, h, x in zip(pages_, hosts, hashes, strict=True)], pa.string())

    own.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    key = [F.xxhash64(host, "html").alias("k1"), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("k2")]
    parts = pages.select(*key, _subtrees(marks)(F.col("html"), host).alias("c")).select("k1", "k2", F.explode("c.hashes").alias("hash"))
    parts = parts.distinct().join(found, "hash").groupBy("k1", "k2").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
    rows = pages.select("page_id", "url", "html", host.alias("host"), *key).join(parts, ["k1", "k2"], "left")
    text = F.arrow_udf(own, "string")(F.col("html"), F.col("host"), F.col("hashes"))
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
