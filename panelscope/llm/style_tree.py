"""Main text of HTML pages by a site style tree.

Every page is parsed into a light tree. The trees of a host are merged by the
path of tags and classes: an element node of the merged tree knows the
presentation styles (sequences of child tags) and the content (texts of blocks)
that its pages show there. Copies of a page on a host are one page. With m pages,

* presentation importance of an element = -sum p log_m p over its styles,
* importance of a content node = 1 - log_m(pages that show this text here),
* composite importance = 0.1 x presentation + 0.9 x mean content importance.

Content nodes and branches of low importance are removed from each page. Hosts
with few pages say nothing about importance; there, as everywhere, what tags,
roles and class names declare decides: scripts, forms, navigation, adverts,
comments and the like go, and an article or main element is the content where
there is one.

The nodes of a page are dealt out by host and page, where copies meet, and
counts are summed in the map tasks, so a host with a third of all pages is a few
rows per task. Removed nodes are a short list per host.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.sources.durable import durable

MIN_PAGES = 10
LOW = 0.1

# Element and attribute names of HTML and the usual names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
FURNITURE = set("script style noscript template head title nav footer aside form button select textarea input svg canvas iframe object embed audio video dialog menu map datalist fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments reply replies respond responses feedback discussion disqus "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login search toolbar pagination pager copyright disclaimer".split()
)
CLOSES_P = BLOCKS - {"br", "button", "option", "optgroup", "body", "html"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element; children are nodes and texts in order."""

    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), entities.unescape(value.strip("\"'")) if value else "")
    return found


def parse(page: str) -> Node:
    """A tree with the closings that HTML implies; unmatched end tags are ignored."""
    root = top = Node("#", {}, None)
    at = 0
    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            top.children.append(text)
        if not found:
            return root
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                top.children.append(found[0][9:].removesuffix("]]>"))
            continue
        if found[1]:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
            elif tag == "p":
                top.children.append(Node("p", {}, top))
            continue
        if tag in CLOSES_P:
            node = top
            while node is not root and node.tag not in ("p", "table", "td", "th", "button", "li", "div", "section", "article", "main", "body"):
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if tag in SAME:
            node = top
            while node is not root and node.tag not in SAME[tag] and node.tag not in SCOPE[tag]:
                node = node.parent
            if node.tag in SAME[tag]:
                top = node.parent
        node = Node(tag, _attributes(found[3]) if found[3].strip(" /") else {}, top)
        top.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not found[3].endswith("/"):
            top = node


def _names(node: Node) -> set[str]:
    text = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"
    return set(_NAME.findall(_CAMEL.sub(" ", text).lower())) if text != " " else set()


def furniture(node: Node, inside: bool) -> bool:
    """What an element declares itself to be; ``inside``: in an article or main element."""
    a = node.attributes
    if node.tag in FURNITURE or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.tag == "header":
        return not inside
    names = _names(node) & NAMES
    if node.tag in ("html", "body", "main") or node.tag in ("article", "h1") and not names & {"comment", "comments", "reply", "ad", "ads", "promo", "related", "sponsored"}:
        return False
    return bool(names)


def _main(root: Node) -> list[Node]:
    """The outermost article elements, or else main elements, or else the page."""
    for wanted in (lambda n: n.tag == "article" or n.attributes.get("itemprop") == "articleBody", lambda n: n.tag == "main" or n.attributes.get("role") == "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node is not root and wanted(node) and not furniture(node, False):
                found.append(node)
            elif node.tag not in FURNITURE - {"form", "fieldset"} and not (_names(node) & {"comment", "comments", "replies", "related", "sidebar"} and node.tag not in ("body", "html", "main")):
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def _step(node: Node) -> str:
    return f"{node.tag}.{'.'.join(sorted(_names(node)))}"


def blocks(root: Node) -> Iterator[tuple[str, str]]:
    """(path of the element, text) of the blocks of the content, in page order."""
    buffer: list[str] = []
    at = ""

    def flush() -> Iterator[tuple[str, str]]:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            yield at, text

    for start in _main(root):
        whole = start is root
        at = _step(start)
        # (node, path, child position); an explicit stack, as pages may nest deeply
        stack = [(start, at, 0)]
        while stack:
            node, path, i = stack.pop()
            if i == len(node.children):
                if node.tag in BLOCKS or node is start:
                    yield from flush()
                    at = path.rpartition(">")[0] or path
                continue
            stack.append((node, path, i + 1))
            child = node.children[i]
            if isinstance(child, str):
                buffer.append(child)
            elif child.tag in BLOCKS:
                yield from flush()
                at = path
                if not furniture(child, not whole):
                    at = f"{path}>{_step(child)}"
                    stack.append((child, at, 0))
            elif not furniture(child, not whole):
                stack.append((child, f"{path}>{_step(child)}", 0))


def _id(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)


def _styles(root: Node) -> set[tuple[int, int]]:
    """(element path, style) of the content's elements; runs of one tag count once."""
    found = set()
    for start in _main(root):
        stack = [(start, _step(start))]
        while stack:
            node, path = stack.pop()
            kids = [c for c in node.children if isinstance(c, Node)]
            tags = [c.tag for c in kids]
            found.add((_id(path), _id(*[t for t, before in zip(tags, [None, *tags]) if t != before])))
            stack += [(c, f"{path}>{_step(c)}") for c in kids if c.tag in BLOCKS and c.children]
    return found


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, kinds, paths, features) of each page: kind 0 stands for the page, 1 for styles, 2 for texts."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        hosts, pages, bounds, found = [], [], [0], []
        for host, page, html in zip(*[batch.column(c).to_pylist() for c in ("host", "page", "html")]):
            if (host, page) in seen:  # copies within a task are read once
                continue
            if len(seen) < 200_000:  # only spares work; further copies are merged later
                seen.add((host, page))
            root = parse(html or "")
            found.append((0, 0, 0))
            found += [(1, *x) for x in _styles(root)]
            found += [(2, *x) for x in {(_id(path), _id(path, text)) for path, text in blocks(root)}]
            hosts.append(host)
            pages.append(page)
            bounds.append(len(found))
        columns = zip(*found) if found else ((), (), ())
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t)) for x, t in zip(columns, (pa.int8(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), *lists], ["host", "page", "kinds", "paths", "features"])


def host_of(url):
    """Lower-case host without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def low_importance(pages: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """host, removed: ids of content nodes and element paths of low importance, one row per host that has any."""
    # one row per distinct page of a host, known by its hash, so that copies of a page are no template
    slim = pages.select("host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("page"), "html").mapInArrow(_nodes, "host string, page long, kinds array<byte>, paths array<long>, features array<long>")
    slim = slim.groupBy("host", "page").agg(F.any_value(F.struct("kinds", "paths", "features")).alias("x"))
    nodes = slim.select("host", F.explode(F.arrays_zip(F.col("x.kinds").alias("kind"), F.col("x.paths").alias("path"), F.col("x.features").alias("feature"))).alias("x")).select("host", "x.*")
    nodes = durable(nodes.groupBy("host", "kind", "path", "feature").agg(F.count(F.lit(1)).alias("pages")))
    sites = nodes.filter("kind = 0").select("host", F.col("pages").alias("m")).filter(F.col("m") >= min_pages)
    # With S the sum of p log p, the mean importance of an element's texts is 1 - S / (log m * sum p), and its styles'
    # entropy is (log m * sum p - S) / (m log m): both need m only after the sums, where one row per element is left.
    spread = F.col("pages") * F.log("pages")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    elements = nodes.filter("kind > 0").groupBy("host", "path").agg(of(2, F.col("pages")).alias("shown"), of(2, spread).alias("text_spread"), of(1, F.col("pages")).alias("styled"), of(1, spread).alias("style_spread"))
    elements = elements.filter("shown > 0").join(sites, "host")
    scale = F.log("m")
    content = 1 - F.col("text_spread") / (scale * F.col("shown"))
    presentation = F.coalesce((scale * F.col("styled") - F.col("style_spread")) / (F.col("m") * scale), F.lit(0.0))
    composite = 0.1 * F.least(F.lit(1.0), presentation) + 0.9 * content
    # an element that few pages show is no template
    branches = elements.filter((composite < low) & (F.col("shown") * 2 >= F.col("m"))).select("host", F.col("path").alias("node"))
    # importance below ``low`` means p > m ** (1 - low), so texts of fewer pages need not meet their host
    texts = nodes.filter((F.col("kind") == 2) & (F.col("pages") >= math.floor(min_pages ** (1 - low)))).join(sites, "host")
    leaves = texts.filter(1 - F.log("pages") / scale < low).select("host", F.col("feature").alias("node"))
    return durable(branches.union(leaves).groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("removed")))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, removed in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist()):
            found = list(blocks(parse(page or "")))
            if removed:
                gone = set(removed)
                found = [(p, t) for p, t in found if _id(p) not in gone and _id(p, t) not in gone]
            out.append("\n".join(t for _, t in found))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    A null page is empty; a page without content has an empty text. A null or
    relative url belongs to the host "". Rows with equal host and html
    count as one page and get the same text. Other columns are ignored, whatever their names.
    """
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    removed = low_importance(base.select("host", "html"), min_pages, low)
    rows = base.join(removed, "host", "left").select("page_id", "url", "html", "removed")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(_texts, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
