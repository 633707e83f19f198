r"""Main text of web pages: page structure first, then site templates by recurring element subtrees.

Each page is read into its elements by the rules that browsers follow where they matter for text: raw text in scripts and styles,
void elements, implied ends of paragraphs, list items and cells, stray and missing end tags, cut-off pages. Left out by structure
are elements whose tag, role or class says that they are menus, headers, footers, sidebars, notices, adverts, forms or reader
comments, and, where a page marks no article, lists of links. What is left of the article (`article`, else `main`, else the body) is
a list of blocks of text.

Site templates: every block element of that rest is hashed with its whole subtree (tags and texts). Spark counts on how many
pages of a host each subtree occurs; pages of one host with the same text count once, as a copy of an article is no
template. A subtree is a template if at least `share` of the host's pages have it, and `least` of them (`least_inside` within a marked
article). Blocks within templates go, unless they hold more than half of an article's text or all of the text of a page without
one: such a page is a near copy of other pages.

Null and empty pages, and pages without any text, give an empty text. A null address has no host, and a page without a host meets
no template. Rows that repeat an id are rows of their own and tie in nothing. A very long page is one row and is read in one pass
over its tags; elements nested more than DEPTH deep count for their parent, as in browsers. An empty table gives an empty result. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

#: Share of a host's pages that makes a subtree a template, and the fewest pages, without and within a marked article.
SHARE, LEAST, LEAST_INSIDE = 0.5, 3, 8
#: So many hosts, or hashes of templates on pages, are broadcast (some 10 MB); beyond that both sides are shuffled.
SENT = 500_000
#: The deepest nesting of elements.
DEPTH = 512

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split()) | {"table"}
#: Elements that end an open one of the same group, up to the element that bounds the group.
GROUPS = ((frozenset(["li"]), frozenset("ul ol menu dir".split())), (frozenset(["dt", "dd"]), frozenset(["dl"])), (frozenset(["td", "th"]), frozenset(["tr", "table"])), (frozenset(["tr"]), frozenset("table tbody thead tfoot".split())), (frozenset("tbody thead tfoot".split()), frozenset(["table"])), (frozenset(["option"]), frozenset(["select", "datalist"])))
#: Tags, roles and words of a class or id that mark what is no article.
NO_TEXT = RAW | frozenset("head template svg math canvas audio video object select datalist button form nav footer aside dialog menu input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending pagination pager skip toolbar widget widgets".split()
)
HEADER = "header"
COMMENTS = frozenset("comment comments commentlist respond disqus discussion replies".split())

_TAG = re.compile(r"<(?:!--(?P<comment>-?>|.*?(?:--!?>|\Z))|(?P<other>[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z))|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<close>>|\Z)|(?P<loose>/?[a-zA-Z][^>]*(?:>|\Z)))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """Elements in page order (tag, attributes, parent) and texts (element, block, text); a block ends wherever a block element begins or ends."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent = ["#page"], [""], [0]
        self.texts: list[tuple[int, int, str]] = []
        self._open, self._block = [0], 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _TAG.search(source, at)
            self._text(source[at : m.start() if m else size])
            if not m:
                return
            at = m.end()
            name, attrs, end = m["name"], m["attrs"], m["end"]
            if m["loose"] and m["loose"].endswith(">"):  # quotes that do not pair: only the name counts
                end, name, attrs = re.match(r"(/?)([^\s/>]+)", m["loose"])[1], re.match(r"/?([^\s/>]+)", m["loose"])[1], ""
            elif not name or not m["close"]:
                continue
            name = name.lower()
            if end:
                self._end(name)
                continue
            self._begin(name, attrs)
            if name in RAW:
                stop = re.compile(r"</" + re.escape(name) + r"(?=[\s/>]|\Z)", re.I).search(source, at) if name != "plaintext" else None
                at = stop.start() if stop else size

    def _text(self, text: str) -> None:
        if text and not (self.tag[self._open[-1]] in RAW):
            self.texts.append((self._open[-1], self._block, html.unescape(text) if "&" in text else text))

    def _close(self, depth: int) -> None:
        """End all open elements from that place in the stack on."""
        if any(self.tag[e] in BLOCK for e in self._open[depth:]):
            self._block += 1
        del self._open[depth:]

    def _find(self, names, bounds) -> int:
        """The place of the innermost open element of names that no element of bounds hides, or 0."""
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in names:
                return depth
            if tag in bounds:
                return 0
        return 0

    def _begin(self, name: str, attrs: str) -> None:
        if name in ENDS_P and (depth := self._find(("p",), BLOCK - {"p"})):
            self._close(depth)
        for group, bounds in GROUPS:
            if name in group and (depth := self._find(group, bounds)):
                self._close(depth)
        if name == "body" and (depth := self._find(("head",), ())):
            self._close(depth)
        if name in BLOCK:
            self._block += 1
        if name == "br":
            self._text(" ")
        if name in VOID or len(self._open) >= DEPTH:
            return
        self.tag.append(name)
        self.attrs.append(attrs)
        self.parent.append(self._open[-1])
        if not attrs.endswith("/") or name not in ("svg", "math"):
            self._open.append(len(self.tag) - 1)

    def _end(self, name: str) -> None:
        if name == "br":
            self._text(" ")
        if name in ("body", "html"):  # what follows them still belongs to the page
            return
        depth = self._find((name,), ("td", "th", "table") if name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table") else ("table",) if name != "table" else ())
        inline = name not in BLOCK
        if depth and not (inline and any(self.tag[e] in BLOCK for e in self._open[depth:])):
            self._close(depth)
        elif name == "p":
            self._block += 1


def _marked(attrs: str) -> tuple[bool, bool, bool]:
    """(boilerplate, comments, header) by role, class and id."""
    boiler = comments = header = False
    for m in _ATTR.finditer(attrs):
        name = (m[1] or m[5] or "").lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = {w.lower() for w in _SPLIT.split(value)}
            boiler |= not words.isdisjoint(WORDS)
            comments |= not words.isdisjoint(COMMENTS)
            header |= HEADER in words
        elif name == "role":
            boiler |= value.strip().lower() in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
            boiler = True
    return boiler, comments, header


def structure(source: str) -> tuple[bool, list[tuple[str, list[int]]]]:
    """(whether the page marks an article, its blocks): a block is its text and the subtree hashes of the block elements around it."""
    page = Page(source)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    marks = [_marked(a) if a.strip() else (False, False, False) for a in page.attrs]

    def upwards(flags: list[bool]) -> list[bool]:
        """Whether an element or one within it has the flag."""
        out = flags[:]
        for e in range(n - 1, 0, -1):
            out[parent[e]] |= out[e]
        return out

    title = upwards([t in ("h1", "main") for t in tag])
    holds = upwards([t in ("h1", "main") or (t == "article" and not any(marks[e][:2])) for e, t in enumerate(tag)])
    inside, gone = [False] * n, [False] * n
    for e in range(1, n):
        up = parent[e]
        boiler, comments, header = marks[e]
        gone[e] = gone[up] or (tag[e] in NO_TEXT and not (tag[e] == "form" and title[e])) or (tag[e] == "header" and not inside[up])
        if tag[e] not in ("html", "body", "main"):
            gone[e] |= (boiler and not holds[e]) or (comments and not title[e]) or (header and not inside[up] and not holds[e])
        inside[e] = inside[up] or tag[e] in ("article", "main")

    def top(name: str) -> list[bool]:
        """Elements within one of that name that is not left out."""
        found = [False] * n
        for e in range(1, n):
            found[e] = found[parent[e]] or (tag[e] == name and not gone[e])
        return found

    root = next((r for r in (top("article"), top("main")) if any(x and not g for x, g in zip(r, gone, strict=True)) and any(r[e] and not gone[e] and t.strip() for e, _, t in page.texts)), None)
    marked = root is not None
    if root is None:
        root = [True] * n
        _drop_link_lists(page, gone)
    elif not any(r and t == "h1" and not g for r, t, g in zip(root, tag, gone, strict=True)):
        root = [r or x for r, x in zip(root, top("h1"), strict=True)]
    kept = [(e, b, t) for e, b, t in page.texts if root[e] and not gone[e]]
    hashes = _subtrees(page, kept)
    blocks: list[tuple[str, list[int]]] = []
    at = 0
    while at < len(kept):
        e, block, _ = kept[at]
        end = at
        while end < len(kept) and kept[end][1] == block:
            end += 1
        text = " ".join("".join(t for _, _, t in kept[at:end]).split())
        if text:
            around = []
            while e:
                if tag[e] in BLOCK and tag[e] not in ("html", "body", "main", "article"):
                    around.append(hashes[e])
                e = parent[e]
            blocks.append((text, around))
        at = end
    return marked, blocks


def _drop_link_lists(page: Page, gone: list[bool]) -> None:
    """Blocks of three links or more that hold nearly all of their text."""
    n = len(page.tag)
    linked = [False] * n
    for e in range(1, n):
        linked[e] = linked[page.parent[e]] or page.tag[e] == "a"
    all_, in_links, links = [0] * n, [0] * n, [int(t == "a") for t in page.tag]
    for e, _, t in page.texts:
        if not gone[e]:
            size = len(t.strip())
            all_[e] += size
            in_links[e] += size * linked[e]
    for e in range(n - 1, 0, -1):
        for sums in (all_, in_links, links):
            sums[page.parent[e]] += sums[e]
    for e in range(1, n):
        gone[e] = gone[e] or gone[page.parent[e]] or (page.tag[e] in BLOCK and page.tag[e] not in ("html", "body") and links[e] > 2 and in_links[e] > 0.8 * all_[e])


def _subtrees(page: Page, kept: list[tuple[int, int, str]]) -> list[int]:
    """Hash of each element's subtree: its tag and, in page order, its texts and the hashes of its elements. Only kept texts count."""
    n = len(page.tag)
    # each element is followed by its parts in page order; children come before parents when read backwards
    parts: list[list[tuple[int, bytes]]] = [[] for _ in range(n)]
    for order, (e, block, t) in enumerate(kept):
        text = " ".join(t.split())
        if text:
            parts[e].append((order, text.encode("utf-8", "replace")))
    out = [0] * n
    for e in range(n - 1, -1, -1):
        mine = parts[e]
        if not mine:
            continue
        mine.sort()
        h = xxhash.xxh3_64_intdigest(page.tag[e].encode() + b"\0" + b"\0".join(p for _, p in mine))
        out[e] = h - (1 << 64) if h >> 63 else h
        parts[page.parent[e]].append((mine[0][0], h.to_bytes(8, "little")))
        parts[e] = []
    return out


_FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("marked", pa.bool_()), ("texts", pa.list_(pa.string())), ("around", pa.list_(pa.list_(pa.int64())))])
FOUND_DDL = "page_id long, url string, marked boolean, texts array<string>, around array<array<bigint>>"


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            read = [structure(x) for x in part.column("html").to_pylist()]
            yield pa.record_batch(
                [part.column("page_id"), part.column("url"), pa.array([m for m, _ in read], pa.bool_()), pa.array([[t for t, _ in x] for _, x in read], pa.list_(pa.string())), pa.array([[a for _, a in x] for _, x in read], pa.list_(pa.list_(pa.int64())))], schema=_FOUND
            )


def templates(found: DataFrame, share: float, least: int, least_inside: int) -> DataFrame:
    """(host, marked, hash, copies) of the subtrees that recur on many pages of their host. Pages with the same text count once, after combining
    in the map tasks; so do subtrees, and a host of any size is never gathered."""
    same = F.xxhash64(F.array_join("texts", "\n"))
    pages = found.where("host <> ''").groupBy("host", same.alias("same")).agg(F.max("marked").alias("marked"), F.count(F.lit(1)).alias("copies"), F.min(F.array_distinct(F.flatten("around"))).alias("hashes"))
    pages = rt.materialise(pages, "hosts")
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = pages.select("host", "marked", "copies", F.explode("hashes").alias("hash")).groupBy("host", "hash", "marked").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    often = rt.materialise(counted.where(F.col("n") >= F.when(F.col("marked"), least_inside).otherwise(least)), "recurring")
    sizes = hosts.join(often.groupBy("host").agg(F.count(F.lit(1)).alias("rows")), "host")
    return rt.lookup(often, sizes, "host", "rows", often.count()).where(F.col("n") >= share * F.col("pages")).select("host", "marked", "hash", "copies")


def main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST, least_inside: int = LEAST_INSIDE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent: int = SENT) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(rt.named(id_col).cast("long").alias("page_id"), rt.named(url_col).cast("string").alias("url"), rt.text_of(rt.named(html_col)).alias("html"))
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    found = rows.mapInArrow(_structures, FOUND_DDL).withColumn("host", F.coalesce(host, F.lit(""))).withColumn("no", F.monotonically_increasing_id())
    found = rt.materialise(found, "pages")
    known = rt.materialise(templates(found, share, least, least_inside), "templates")
    per_host = known.groupBy("host", "marked").agg(F.count(F.lit(1)).alias("n"))
    held = found.where(F.size("texts") > 0).select("no", "host", "marked", F.explode(F.array_distinct(F.flatten("around"))).alias("hash"))
    held = held.join(F.broadcast(per_host.select("host", "marked")), ["host", "marked"], "left_semi") if per_host.count() <= sent else held
    met = rt.meet(held, known, ["host", "marked", "hash"], "copies", found.count())
    gone = rt.materialise(met.groupBy("no").agg(F.collect_list("hash").alias("gone")), "gone")
    few = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0] <= sent
    told = found.join(F.broadcast(gone) if few else gone, "no", "left")
    left = F.filter(F.arrays_zip("texts", "around"), lambda b: ~F.arrays_overlap(b["around"], F.coalesce("gone", F.array().cast("array<bigint>"))))
    left = F.transform(left, lambda b: b["texts"])
    told = told.withColumn("left", left)
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + F.char_length(t))
    copy = F.when(F.col("marked"), 2 * size("left") < size("texts")).otherwise(F.size("left") == 0)
    text = F.array_join(F.when(copy, F.col("texts")).otherwise(F.col("left")), "\n")
    return told.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(rt.read_table(spark, sf_dir, "pages"))
