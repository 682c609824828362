"""Main text of web pages by differencing each page with its nearest neighbours in URL order.

A page is read as lines: one per block element, with white space folded. Pages are sorted by
host and path, so that the neighbours of a page in that order are those of its host whose
path is nearest. The lines of both are aligned by a longest common subsequence, and what they share
is template: it is deleted. A neighbour that shares nearly all of a page's lines is a copy of
it and no witness; then the markup alone decides.

Where the markup says what a line is, that settles it: lines inside navigation, headers, footers,
sidebars, forms, adverts, notices or comments go, shared or not, and lines inside an article
(or main) element are the text, shared or not, as two articles may quote the same passage. An article
inside a form, or in a wrapper that only a class or id names otherwise, is text again, unless that wrapper is itself
inside an article or holds comments or further pages. Differencing decides all lines without such marks, on
pages with an article too, as its articles may be cards beside the text; only if no neighbour bears
witness does such a page keep nothing from outside its articles.

The order is global, so no host is gathered in one task: page keys alone are range-sorted, and
each page is sent to its range, the pages at a range's ends to both sides. A range holds about
as many pages as any other, however common its host.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.session import cut_lineage

#: Share of a page's lines that makes a neighbour its copy.
COPY = 0.9
#: Pages per range, about.
RANGE = 20_000

#: Fixed values of the markup language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
_CLOSED_BY_SIBLING = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
#: Elements that are not read at all, and those whose lines are never text.
_UNREAD = frozenset("head script style noscript template iframe svg math object canvas audio video".split())
_NO_TEXT = frozenset("nav footer aside form button select textarea dialog menu".split())
_TEXT = frozenset(["article", "main"])
_NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id values that name something else than text.
_NO_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner"
    " nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager sidebar rail widget widgets"
    " footer masthead topbar comment comments commentlist disqus reply replies respond discussion"
    " cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription paywall"
    " share sharing social related recommended login signin signup search copyright legal disclaimer".split()
)
#: Of these, what may also name a section of an article, and what holds articles that are not this page's text.
_SECTION_NAMES = frozenset(["discussion"])
_OTHERS_NAMES = frozenset("comment comments commentlist disqus reply replies respond related recommended".split())
#: Parts that make a class or id value tell a state of the page (with-sidebar, nav-open), not what its element is.
_STATE_STARTS = frozenset("with without has have no is not".split())
_STATE_ENDS = frozenset("open opened closed collapsed expanded visible hidden shown enabled disabled active inactive on off".split())
_HEADER_NAMES = frozenset(["header", "site-header", "page-header"])
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

OPEN, TEXT, OTHER = 0, 1, 2


class _Lines(HTMLParser):
    """The lines of a page, each with what the markup says of it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, kind of the lines inside, unread, an article is text again
        self.lines: list[tuple[str, int]] = []
        self.words: list[str] = []

    def _kind(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (OPEN, False, False)

    def _break(self) -> None:
        line = " ".join("".join(self.words).split())
        if line:
            self.lines.append((line, self._kind()[0]))
        self.words = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.words.append(" ")
            return
        if tag not in _INLINE:
            self._break()
        if tag in _VOID:
            return
        closes = _CLOSED_BY_SIBLING.get(tag, frozenset())
        while self.stack and self.stack[-1][0] in closes:
            self.stack.pop()
        if tag in _PARAGRAPH_ENDS:
            self._leave_paragraph()
        kind, unread, again = self._kind()
        if tag in _UNREAD:
            unread = True
        elif kind != OTHER or again:
            hard = (tag in _NO_TEXT and tag != "form") or (tag == "header" and kind != TEXT) or self._marked(tag, attrs, kind)
            names = self._names(tag, attrs, kind)
            if hard or tag == "form" or names:
                again = not hard and kind != TEXT and tag not in _TEXT and _OTHERS_NAMES.isdisjoint(names)
                kind = OTHER
            elif tag in _TEXT:
                kind, again = TEXT, False
        self.stack.append((tag, kind, unread, again))

    def _leave_paragraph(self) -> None:
        """A block ends an open paragraph, with the inline elements left open in it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == "p":
                del self.stack[k:]
                return
            if self.stack[k][0] not in _INLINE:
                return

    def _marked(self, tag: str, attrs: list, kind: int) -> bool:
        """A role or type says that the element is no text."""
        if tag in _INLINE or tag in ("html", "body"):
            return False
        for name, value in attrs:
            if name == "role" and (value or "").lower() in _NO_TEXT_ROLES - {"form"} and not (kind == TEXT and value.lower() == "banner"):
                return True
            if name == "itemtype" and (value or "").endswith("/Comment"):
                return True
        return False

    def _names(self, tag: str, attrs: list, kind: int) -> set[str]:
        """The words of the class and id values that name something else than text."""
        found: set[str] = set()
        if tag in _INLINE or tag in ("html", "body"):
            return found
        for name, value in attrs:
            if name == "role" and (value or "").lower() == "form":
                found.add("form")
            if name in ("class", "id") and value:
                for token in value.split():
                    words = [w.lower() for w in _NAME.findall(token)]
                    if len(words) > 1 and (words[0] in _STATE_STARTS or words[-1] in _STATE_ENDS):
                        continue
                    found |= _NO_TEXT_NAMES.intersection(words) - (_SECTION_NAMES if kind == TEXT else frozenset())
                if kind != TEXT:
                    found |= _HEADER_NAMES.intersection(value.lower().split())
        return found

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self._break()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag in _INLINE and self.stack[k][0] not in _INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self._kind()[1]:
            self.words.append(data)


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The visible lines of a page and their kind: TEXT, OTHER or OPEN (the markup does not say)."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._break()
    return parser.lines


def shared(a: list[str], b: list[str]) -> set[int]:
    """The positions of `a` in a longest common subsequence of both.

    Equal ends are matched first; the rest follows the matching pairs row by row and keeps, for
    every length, the pair that ends earliest.
    """
    front = 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        front += 1
    back = 0
    while back < min(len(a), len(b)) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    out = {*range(front), *range(len(a) - back, len(a))}
    places: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - back - 1, front - 1, -1):
        places[b[j]].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(front, len(a) - back):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            if k == len(ends) or ends[k] > j:
                link = (i, chains[k - 1] if k else None)
                if k == len(ends):
                    ends.append(j)
                    chains.append(link)
                else:
                    ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def main_text(lines: list[tuple[str, int]], neighbours: list[list[str]]) -> str:
    """The text of a page, given the lines of the pages next to it."""
    words = [line for line, _ in lines]
    deleted: set[int] = set()
    witness = False
    if any(kind == OPEN for _, kind in lines):
        for other in neighbours:
            same = shared(words, other)
            if len(same) < COPY * len(words):
                deleted |= same
                witness = True
    article = any(kind == TEXT for _, kind in lines)
    kept = [line for k, (line, kind) in enumerate(lines) if kind == TEXT or (kind == OPEN and (witness or not article) and k not in deleted)]
    return "\n".join(kept)


# ---------------------------------------------------------------- pages in URL order

_KEY = ("host", "path", "url", "page_id")


def _keyed(pages: DataFrame, *more: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return pages.select(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "url", "page_id", *more)


def _sortable(row) -> tuple:
    """A key as Spark orders it: nulls first."""
    return tuple((0, "") if row[c] is None else (1, row[c]) for c in _KEY)


def _ranges(pages: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """First and last key of every range of the global order; keys alone are sorted."""
    keys = cut_lineage(_keyed(pages))
    conf = keys.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE))
    sorted_ = keys.repartitionByRange(n, *_KEY).select(F.spark_partition_id().alias("part"), F.struct(*_KEY).alias("key"))
    ends = sorted_.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    firsts = sorted(_sortable(r["first"]) for r in ends)
    lasts = sorted(_sortable(r["last"]) for r in ends)
    return firsts, lasts


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page.

    Defined results: a null or empty html has no lines and an empty text; a page without a host in its url has no
    neighbours; repeated rows are copies of each other; a page alone on its host keeps all lines the
    markup does not exclude; an empty table gives no rows; other columns are not read.
    """
    firsts, lasts = _ranges(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    line = "lines array<struct<line:string,kind:int>>"
    keyed = _keyed(pages, "html")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            if schema is None:
                kinds = pa.list_(pa.struct([("line", pa.string()), ("kind", pa.int32())]))
                fields = [batch.schema.field(c) for c in _KEY]
                schema = pa.schema([("part", pa.int32()), ("ghost", pa.bool_()), *fields, ("lines", kinds)])
            out, held = [], 0
            for row in batch.to_pylist():
                key = _sortable(row)
                lines = [{"line": x, "kind": k} for x, k in lines_of(row.pop("html"))]
                part = max(0, bisect_right(firsts, key) - 1)
                out.append({"part": part, "ghost": False, **row, "lines": lines})
                if key == firsts[part] and part:
                    out.append({"part": part - 1, "ghost": True, **row, "lines": lines})
                if key == lasts[part] and part + 1 < len(firsts):
                    out.append({"part": part + 1, "ghost": True, **row, "lines": lines})
                held += sum(len(x["line"]) for x in lines)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    key = f"host string, path string, url string, page_id {kind}"
    parsed = keyed.mapInArrow(parse, f"part int, ghost boolean, {key}, {line}")
    placed = parsed.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", *_KEY)

    def differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows() -> Iterator[dict]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([batch.schema.field("page_id"), batch.schema.field("url"), ("text", pa.string())])
                yield from batch.to_pylist()

        def near(row: dict, other: dict | None) -> bool:
            return other is not None and row["host"] != "" and other["host"] == row["host"] and other["part"] == row["part"]

        out, held = [], 0
        before, row = None, None
        for after in chain(rows(), [None]):
            if row is not None and not row["ghost"]:
                others = [[x["line"] for x in o["lines"]] for o in (before, after) if near(row, o)]
                text = main_text([(x["line"], x["kind"]) for x in row["lines"]], others)
                out.append({"page_id": row["page_id"], "url": row["url"], "text": text})
                held += len(text)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            before, row = row, after
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return placed.mapInArrow(differ, f"page_id {kind}, url string, text string")
