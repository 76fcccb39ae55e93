"""Company pages to structured records and links."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flagstone import fixed
from flagstone.functions import text as X
from flagstone.functions.once import let
from flagstone.sources import markup as M

_TABLE = "struct<periods:array<string>,rows:array<struct<label:string,values:array<string>>>>"
# field -> element id, heading used when the id is missing
PAGE_TABLES = {
    "profit_loss": ("profit-loss", ["profit & loss"]),
    "quarters": ("quarters", ["quarterly results"]),
    "balance_sheet": ("balance-sheet", ["balance sheet"]),
    "cash_flow": ("cash-flow", ["cash flow", "cash flows"]),
    "ratios_table": ("ratios", ["ratios"]),
    "shareholding": ("shareholding", ["shareholding pattern", "shareholding"]),
}
DOCUMENT_SECTIONS = [
    ("annual-reports", "annual reports", "ANNUAL_REPORT", "annual_report"),
    ("concalls", "concalls", "EARNINGS_PDF", "concall"),
    ("credit-ratings", "credit ratings", "ANNOUNCEMENT", "credit_rating"),
    ("announcements", "announcements", "ANNOUNCEMENT", "announcement"),
]
PAGE_TYPE = (
    "name string, about string, ratios map<string,string>, "
    + ", ".join(f"{t} {_TABLE}" for t in PAGE_TABLES)
    + ", peers struct<columns:array<string>,rows:array<array<string>>>, pros array<string>, cons array<string>, "
    "links array<struct<category:string,doc_type:string,pos:int,group_label:string,label:string,href:string>>, markup_error string"
)
#: Pages turned into Python objects at a time.
PAGES_AT_ONCE = 64
_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "source", "wbr"}
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}


#: Elements whose end tag may be left out.
_OPTIONAL_END = {"li", "tr", "td", "th", "p", "tbody", "thead", "body", "html", "option", "dd", "dt"}


class _Node:
    """An element. Elements are numbered in document order, so those below one have numbers in a row up to `last`."""

    def __init__(self, tree: _Tree, tag: str, attrs: dict, parent: _Node | None):
        self.tree, self.tag, self.attrs, self.parent, self.parts = tree, tag, attrs, parent, []
        self.at = self.last = len(tree.nodes)
        self.classes = attrs.get("class", "").split()

    def walk(self) -> list[_Node]:
        """All nodes below, in document order. Pages may nest as deep as they like."""
        return self.tree.nodes[self.at + 1 : self.last + 1]

    def all(self, tag: str | None = None, cls: str | None = None, id: str | None = None) -> list[_Node]:
        """The nodes below with a tag, a class or an id, read from the page's index of these."""
        kind, key = ("id", id) if id is not None else ("class", cls) if cls is not None else ("tag", tag)
        listed = self.tree.index.get((kind, key), [])
        below = listed[bisect_right(listed, self.at) : bisect_right(listed, self.last)]
        found = (self.tree.nodes[i] for i in below)
        return [n for n in found if (tag is None or n.tag == tag) and (cls is None or cls in n.classes)]

    def raw(self) -> str:
        out: list[str] = []
        waiting = list(reversed(self.parts))
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                out.append(part)
            else:
                waiting += reversed(part.parts)
        return "".join(out)

    def text(self) -> str:
        return " ".join(self.raw().split())

    def up(self, *tags: str) -> _Node | None:
        node = self.parent
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


class _Tree(HTMLParser):
    """The nodes of a page, and for every tag, class and id the numbers of its nodes."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.stray = self.open_ends = 0
        self.root = self.at = self._add("root", {}, None)
        self.feed(html)
        self.close()
        while self.at.parent is not None:
            self.open_ends += self.at.tag not in _OPTIONAL_END
            self.at = self.at.parent
        self.index: dict[tuple[str, str], list[int]] = {}
        for node in self.nodes[1:]:
            keys = {("tag", node.tag), *(("class", c) for c in node.classes)}
            if "id" in node.attrs:
                keys.add(("id", node.attrs["id"]))
            for key in keys:
                self.index.setdefault(key, []).append(node.at)
        for node in reversed(self.nodes[1:]):
            node.parent.last = max(node.parent.last, node.last)

    def _add(self, tag: str, attrs: dict, parent: _Node | None) -> _Node:
        node = _Node(self, tag, attrs, parent)
        self.nodes.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        while self.at.tag in _CLOSES.get(tag, ()) and self.at.parent is not None:
            self.at = self.at.parent
        node = self._add(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node, passed = self.at, 0
        while node is not None and node.tag != tag:
            passed += node.tag not in _OPTIONAL_END
            node = node.parent
        if node is None or node.parent is None:
            self.stray += 1
        else:
            self.at = node.parent
            self.open_ends += passed

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.parts.append(data)

    @cached_property
    def headings(self) -> list[_Node]:
        return sorted((h for tag in ("h1", "h2", "h3") for h in self.root.all(tag)), key=lambda h: h.at)

    @property
    def error(self) -> str | None:
        return f"{self.stray} end tags without a start, {self.open_ends} elements without an end" if self.stray or self.open_ends else None


def _region(root: _Node, element_id: str, headings: list[str]) -> _Node | None:
    for node in root.all(id=element_id) if element_id else []:
        return node
    for wanted in headings:
        for h in root.tree.headings:
            if h.text().lower() == wanted:
                return h.up("section", "div")
    return None


def _own(table: _Node, nodes: list[_Node]) -> list[_Node]:
    """Those nodes that are not part of a table inside the table."""
    inner = table.all("table")
    return [n for n in nodes if not any(t.at < n.at <= t.last for t in inner)] if inner else nodes


def _cells(table: _Node, tr: _Node) -> list[str]:
    return [n.text() for n in _own(table, tr.all("td"))]


def _period_table(region: _Node | None) -> dict | None:
    tables = region.all("table", cls="data-table") if region else []
    if not tables:
        return None
    table = tables[0]
    heads = [n for part in _own(table, table.all("thead")) for n in _own(table, part.all("th"))]
    rows = []
    for tr in (n for part in _own(table, table.all("tbody")) for n in _own(table, part.all("tr"))):
        cells = _cells(table, tr)
        label = re.sub(r"\s*\+\s*$", "", cells[0]) if len(cells) > 1 else ""
        if label:
            rows.append({"label": label, "values": [c or None for c in cells[1:]]})
    return {"periods": [h.text() for h in heads[1:]], "rows": rows} if rows else None


def _links(root: _Node) -> list[dict]:
    out = []
    for cls, heading, doc_type, category in DOCUMENT_SECTIONS:
        region = next(iter(root.all(cls=cls)), None) or _region(root, "", [heading])
        for pos, a in enumerate(n for n in (region.all("a") if region else []) if n.attrs.get("href")):
            entry = a.up("li")
            label = next((d.text() for d in entry.all("div")), None) if entry else None
            out.append({"category": category, "doc_type": doc_type, "pos": pos, "group_label": label,
                        "label": a.text(), "href": a.attrs["href"]})
    return out


def _read_page(html: str) -> dict:
    tree = _Tree(html or "")
    root = tree.root
    regions = {f: _region(root, i, h) for f, (i, h) in PAGE_TABLES.items()}
    quarterly = regions["shareholding"].all(id="quarterly-shp") if regions["shareholding"] else []
    if quarterly:
        regions["shareholding"] = quarterly[0]
    ratios = {}
    for li in (n for ul in root.all(id="top-ratios") for n in ul.all("li")):
        first = lambda cls, li=li: next((n.text() for n in li.all(cls=cls)), "")
        if first("name"):
            ratios[first("name")] = first("value") or first("number")
    peers, region = None, _region(root, "peers", ["peers", "peer comparison"])
    for table in (region.all("table") if region else [])[:1]:
        rows = [c for tr in _own(table, table.all("tr")) if any(c := _cells(table, tr))]
        peers = {"columns": [n.text() for n in _own(table, table.all("th"))], "rows": rows}
    bullets = lambda cls: [t for d in root.all(cls=cls) for li in d.all("li") if (t := li.text())]
    about = [n for d in root.all(cls="company-profile") for n in d.walk() if n.tag == "p" or "about" in n.classes]
    return {
        "name": next((n.text() for n in root.all("h1")), None) or None,
        "about": (about[0].text() or None) if about else None,
        "ratios": ratios, **{f: _period_table(r) for f, r in regions.items()},
        "peers": peers, "pros": bullets("pros"), "cons": bullets("cons"), "links": _links(root), "markup_error": tree.error,
    }


def structure_pages(pages: DataFrame, keep: tuple[str, ...] = ("company_id", "url")) -> DataFrame:
    """Every page as one nested record. Pages are independent, so each partition reads its own.

    Broken pages are read as far as they go; `markup_error` counts end tags without a start and elements without
    an end, and is null for sound pages. A null or empty page gives a record without parts. Rows of a table inside
    a cell are not rows of the outer table, their text belongs to the cell.
    """
    kept = pages.select(*keep, "html")
    schema = StructType(kept.select(*keep).schema.fields + StructType.fromDDL(PAGE_TYPE).fields)
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                rows = batch.slice(start, PAGES_AT_ONCE).to_pylist()
                records = [{**{k: r[k] for k in keep}, **_read_page(r["html"])} for r in rows]
                for r in records:
                    r["ratios"] = list(r["ratios"].items())
                yield pa.RecordBatch.from_pylist(records, schema=arrow)

    return kept.mapInArrow(read, schema)


def outline(pages: DataFrame) -> DataFrame:
    """Title, headings, paragraphs of the article and links of raw pages, in column expressions (`sources.markup`)."""
    read = M.with_elements(pages.select("page_id", "html")).drop("html")
    elements = F.col("elements")
    of_part = lambda part, tag: F.size(F.filter(
        elements, lambda e: (e["tag"] == tag) & F.exists(M.of_tag(elements, part), lambda p: M.holds(p, e))
    ))
    title = let(M.first(M.of_tag(elements, "h1")), lambda h: F.when(h.isNotNull(), M.text_of(F.col("tokens"), h)))
    return read.select(
        "page_id", title.alias("title"), F.size(M.of_tag(elements, "h1", "h2", "h3")).alias("headings"),
        of_part("article", "p").alias("paragraphs"), F.size(M.of_tag(elements, "a")).alias("links"),
        of_part("nav", "a").alias("nav_links"), "markup_error",
    )


def looks_like_company_page(html: Column) -> Column:
    return html.rlike(fixed.COMPANY_PAGE)


def field_inventory(structured: DataFrame) -> DataFrame:
    """Sizes of the parts of each structured page; zero when a part is missing."""
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return structured.select(
        "company_id", size(F.map_keys("ratios")).alias("ratios"),
        *[size(F.col(t)["rows"]).alias(f"{t}_rows") for t in PAGE_TABLES],
        size(F.col("profit_loss")["periods"]).alias("profit_loss_periods"),
        size(F.col("peers")["rows"]).alias("peers"), size(F.col("pros")).alias("pros"),
        size(F.col("cons")).alias("cons"), size(F.col("links")).alias("links"),
    )


def page_links(structured: DataFrame) -> DataFrame:
    """Document links with category and name, listing links dropped, one per category and address."""
    from flagstone.operators.ordering import first_per_group
    from flagstone.operators.research import is_listing_link, link_rank

    rows = structured.select("company_id", "url", F.explode("links").alias("l")).select(
        "company_id", F.col("url").alias("base"), "l.*"
    )
    rows = rows.filter(~is_listing_link(F.col("label")) & ((F.col("label") != "") | (F.col("category") == "concall")))
    named = rows.select(
        "company_id", "category", "doc_type",
        F.when(F.col("category") == "concall", link_rank(F.col("label"))).otherwise(0).alias("rank"), "pos",
        F.when(
            F.col("category") == "concall",
            F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "group_label", "label")), F.lit("")), F.lit("Concall")),
        ).otherwise(F.col("label")).alias("label"),
        X.absolute_url(F.col("href"), F.col("base")).alias("link"),
    )
    return first_per_group(named, ["company_id", "category", "link"], ["rank", "pos"])


def anchors(pages: DataFrame) -> DataFrame:
    """All links of raw pages by position, without a parser: one expression per page."""
    hrefs, labels = (
        F.regexp_extract_all(F.col("html"), F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'), g) for g in (1, 2)
    )
    return pages.select(
        "page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("pos", "a")
    ).select(
        "page_id", "pos", "a.href",
        X.clean_text(X.clean_markup(F.col("a.label"))).alias("label"),
        X.absolute_url(F.col("a.href"), F.col("url")).alias("link"),
    )


def list_items(pages: DataFrame) -> DataFrame:
    """List entries of raw pages by position, blank ones dropped."""
    items = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)
    return (
        pages.select("page_id", F.posexplode(items).alias("pos", "raw"))
        .select("page_id", "pos", X.clean_text(X.clean_markup(F.col("raw"))).alias("item"))
        .filter(F.col("item") != "")
    )
