"""Main text of web pages by site template removal.

Every page is parsed into a tree, and every block element gets a hash of its whole
subtree. In Spark the subtrees are counted per host, each once for pages with the same
main text, so that copies of an article make no template. A subtree outside ``article`` and
``main`` that recurs in at least ``MIN_PAGES`` pages of its host is template, however many pages
the host has; inside them it must recur in ``MIN_SHARE`` of the host's pages as well. A
second pass deletes templates. Prose inside an article (paragraphs, headings, list items, quotes)
is never taken for template, however common. Elements whose tag, role, class or id says what
they are (navigation, header and footer outside an article, sidebar, notice, advert, form,
script, style, reader comments) go as well. Outside an article, what holds an ``article`` or
``main`` is never deleted, navigation, sidebars and footers excepted. What is left of the ``article`` or ``main``
elements, or of the page if it has none, is the text: one line per block, white space
inside a block as one space, character references decoded.

All templates are broadcast while there are at most ``BROADCAST_TEMPLATES``; beyond that each
page's own subtrees are joined with them, so that a page carries only those it holds.

Null or empty html: empty text. Null or odd url: its pages share no template. Repeated
rows: one result each. Markup cut off or nested wrongly is closed as browsers do. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, sql_type, table

MIN_PAGES = 8
MIN_SHARE = 0.5
BROADCAST_TEMPLATES = 200_000

# How elements are treated.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th ul ol dl table tbody tr figcaption".split())
MAIN = frozenset(["article", "main"])
TEASERS = frozenset(["nav", "aside", "footer"])  # an article in these is a teaser
DROPPED = frozenset("head nav footer aside form button select textarea input iframe object svg canvas noscript template dialog menu".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice "
    "notices banner popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies "
    "respond responses menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended "
    "widget widgets toolbar pagination pager masthead skip".split())
#: A start tag of the key closes an open element of the value, up to the nearest other container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+>|<[!?/a-zA-Z][^>]*\Z", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


def unwanted(tag: str, attributes: str) -> bool:
    """Whether an element's tag, role, class or id marks it as no part of the text."""
    if tag in DROPPED:
        return True
    if attributes and tag not in MAIN and tag not in ("html", "body"):
        for m in _NAMED.finditer(attributes):
            name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return True
            if name in ("class", "id") and not NAMES.isdisjoint(_WORDS.findall(value)):
                return True
    return False


@dataclass
class Element:
    tag: str
    parent: int
    unwanted: bool
    in_main: bool
    parts: list[str] = field(default_factory=list)  # what the subtree's hash is made of
    hash: int = 0
    holds_main: bool = False

    @property
    def key(self) -> int:
        """The hash; its complement inside an article, where another count applies."""
        return ~self.hash if self.in_main else self.hash


@dataclass
class Page:
    """The block elements of a page, parents first, and its text blocks with the element each is in."""

    elements: list[Element]
    blocks: list[tuple[int, str]]

    def kept(self, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
        gone = [False] * len(self.elements)
        for k, e in enumerate(self.elements):
            removable = e.key in template and not (e.in_main and e.tag in PROSE) and e.tag not in MAIN
            spared = e.holds_main and not e.in_main and e.tag not in TEASERS
            gone[k] = (e.unwanted or removable) and not spared or e.parent >= 0 and gone[e.parent]
        left = [(k, text) for k, text in self.blocks if not gone[k]]
        inside = [text for k, text in left if self.elements[k].in_main or self.elements[k].tag in MAIN]
        return inside or [text for _, text in left]


def parse(source: str) -> Page:
    """Block elements become nodes; inline elements and line breaks only contribute their text."""
    import xxhash

    elements = [Element("", -1, False, False)]
    blocks: list[tuple[int, str]] = []
    stack, skipped, pieces = [0], [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            blocks.append((stack[-1], text))
            elements[stack[-1]].parts.append(text)

    def close_top() -> None:
        flush()
        e = elements[stack.pop()]
        e.hash = xxhash.xxh64_intdigest("\x00".join([e.tag, *e.parts]).encode("utf-8", "surrogatepass")) >> 1
        if stack:
            elements[stack[-1]].parts.append(f"{e.hash:x}")

    def close(tags, within) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = elements[stack[k]].tag
            if tag in tags:
                while len(stack) > k:
                    close_top()
                return
            if tag in within:
                return

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            if not skipped:
                pieces.append(source[at:])
            break
        if not skipped:
            pieces.append(source[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        tag, ending, rest = name.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if ending:
            if skipped:
                if tag == skipped[-1]:
                    skipped.pop()
            elif tag in BLOCKS:
                flush()
                close({tag}, MAIN if tag not in MAIN and tag not in ("body", "html") else ())
            continue
        if tag in RAW:  # its content is no markup
            found = re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*>?", re.I).search(source, at)
            at = found.end() if found else end
            continue
        if skipped and tag in MAIN and not (elements[stack[-1]].in_main or elements[stack[-1]].tag in MAIN):
            skipped.clear()  # an unwanted inline element does not take an article with it
        if skipped:
            if tag == skipped[-1] and not rest.endswith("/"):
                skipped.append(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag not in BLOCKS:
            if unwanted(tag, rest) and not rest.endswith("/"):
                skipped.append(tag)  # an unwanted inline element, up to its end tag
            continue
        flush()
        close({"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            close(CLOSES[tag], HOLDS[tag])
        parent = stack[-1]
        above = elements[parent]
        inside = above.in_main or above.tag in MAIN
        off = unwanted(tag, rest) or tag == "header" and not inside
        elements.append(Element(tag, parent, off, inside))
        if tag in MAIN:
            for k in stack:
                elements[k].holds_main = True
        stack.append(len(elements) - 1)
    while stack:
        close_top()
    return Page(elements, blocks)


def subtrees(pages: DataFrame) -> DataFrame:
    """``host, page, main, hash``: every block subtree with text of every page.

    ``page`` is the hash of the page's source, ``main`` that of its main text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows, mains, hashes = [], [], []
            for row, source in enumerate(b.column(1).to_pylist()):
                page = parse(source or "")
                main = xxhash.xxh64_intdigest("\n".join(page.kept()).encode("utf-8", "surrogatepass")) >> 1
                found = {e.key for e in page.elements[1:] if e.parts and e.tag not in ("html", "body")}
                rows += [row] * len(found)
                mains += [main] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at := pa.array(rows, pa.int64())), b.column(2).take(at),
                 pa.array(mains, pa.int64()), pa.array(hashes, pa.int64())],
                ["host", "page", "main", "hash"])

    narrow = pages.where("host is not null").select("host", "html", F.xxhash64("html").alias("page"))
    return narrow.mapInArrow(run, "host string, page long, main long, hash long")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, hash`` of the subtrees that recur across the pages of their host."""
    seen = cut(subtrees(pages).select("host", "main", "hash").distinct())
    totals = seen.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = (F.col("hash") >= 0) | (F.col("n") >= min_share * F.col("pages"))
    return counts.join(totals, "host").where(often).select("host", "hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``id, url, text``: the main text of every page."""
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    named = pages.select(F.when(host != "", host).alias("host"), F.col(html_col).alias("html"),
                         F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    found = cut(templates(named, min_pages, min_share))
    known, shared = named.withColumn("template", F.lit(None).cast("array<long>")), None
    if found.count() <= BROADCAST_TEMPLATES:
        by_host: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
    else:
        held = subtrees(named).select("host", "page", "hash").distinct().join(found, ["host", "hash"], "left_semi")
        lists = held.groupBy("host", "page").agg(F.collect_list("hash").alias("template"))
        known = named.withColumn("page", F.xxhash64("html")).join(lists, ["host", "page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = shared.value if shared else {}
        for b in batches:
            texts = [
                "\n".join(parse(source).kept(by_host.get(host) or set(template or ()))) if source else ""
                for source, template, host in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(3), b.column(4)], ["text", "id", "url"])

    joined = known.select("html", "template", "host", "id", "url")
    return joined.mapInArrow(run, f"text string, id {sql_type(pages, id_col)}, url {sql_type(pages, url_col)}").select("id", "url", "text")


def op4_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
