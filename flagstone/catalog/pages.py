"""Rendered company pages back to tables, and links and lists of raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.catalog.oracle import with_ctes
from flagstone.catalog.registry import query
from flagstone.operators import finance as fin
from flagstone.sources import pages as PG
from flagstone.sources.bindings import Tables


def structured(t: Tables) -> DataFrame:
    return PG.structure_pages(t.company_pages())


@query("page_tables", with_ctes("SELECT company_id, tbl, row_idx, label, period_idx, period, raw FROM cells", "cells"))
def page_tables(t: Tables) -> DataFrame:
    return fin.cells_from_statements(structured(t)).drop("tbl_priority", "num")


@query("page_kv", "SELECT s_suppkey AS company_id, 'Stock P/E' AS name, CAST(s_suppkey % 40 AS VARCHAR) AS value FROM supplier UNION ALL SELECT s_suppkey, 'Code', 'C-' || s_suppkey FROM supplier")
def page_kv(t: Tables) -> DataFrame:
    return structured(t).select("company_id", F.explode("ratios").alias("name", "value"))


@query("page_bullets", "SELECT s_suppkey AS company_id, 'pro' AS kind, 'Debt & cost under control' AS item FROM supplier UNION ALL SELECT s_suppkey, 'pro', 'Pays dividend no ' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, 'con', 'Slow collection' FROM supplier")
def page_bullets(t: Tables) -> DataFrame:
    s = structured(t)
    both = F.array(F.struct(F.lit("pro").alias("kind"), F.col("pros").alias("items")), F.struct(F.lit("con").alias("kind"), F.col("cons").alias("items")))
    return s.select("company_id", F.explode(both).alias("x")).select("company_id", "x.kind", F.explode("x.items").alias("item"))


@query(
    "page_shareholding",
    with_ctes("SELECT company_id, max(CASE WHEN label = 'Promoters' THEN latest_raw END) AS promoters, max(CASE WHEN label = 'Pledged' THEN latest_raw END) AS pledged FROM rows GROUP BY 1", "rows"),
)
def page_shareholding(t: Tables) -> DataFrame:
    last = lambda which: F.element_at(fin.holding_series(which)["values"], -1)
    return structured(t).select("company_id", last("promoters").alias("promoters"), last("pledged").alias("pledged"))


@query("page_structure")
def page_structure(t: Tables) -> DataFrame:
    pages = t.company_pages().filter(PG.looks_like_company_page(F.col("html")))
    return PG.structure_pages(pages)


@query(
    "field_inventory",
    "SELECT s_suppkey AS company_id, 2 AS ratios, 8 AS profit_loss_rows, 0 AS quarters_rows, 3 AS balance_sheet_rows, 1 AS cash_flow_rows, 2 AS ratios_table_rows, 2 AS shareholding_rows, n AS profit_loss_periods, "
    "0 AS peers, 2 AS pros, 1 AS cons, 8 AS links FROM supplier JOIN (SELECT l_suppkey, count(DISTINCT year(l_shipdate)) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey",
)
def field_inventory(t: Tables) -> DataFrame:
    return PG.field_inventory(structured(t))


_DOC_LINKS = [
    *[("annual_report", f"Annual report {y}", f"/ar/{y}/") for y in range(4)],
    ("concall", "Jan Transcript", "/tr/1"), ("concall", "Jan PPT", "/ppt/1"), ("concall", "Jan REC", "/rec/1"),
]


PAGE_DOCUMENTS_SQL = " UNION ALL ".join(
    f"SELECT s_suppkey AS company_id, '{c}' AS category, '{n}' AS label, 'https://pages.example.org{h}'" + (" || s_suppkey" if c == "annual_report" else "") + " AS link FROM supplier"
    for c, n, h in _DOC_LINKS
)


@query("page_documents", PAGE_DOCUMENTS_SQL)
def page_documents(t: Tables) -> DataFrame:
    return PG.page_links(structured(t)).select("company_id", "category", "label", "link")


_ANCHORS = (
    "SELECT page_id, url, i AS pos, regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1)[i + 1] AS href, "
    "regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2)[i + 1] AS label FROM "
    "(SELECT *, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1)))) AS i FROM pages)"
)


@query(
    "page_links",
    with_ctes(
        "SELECT page_id, pos, href, trim(regexp_replace(regexp_replace(label, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS label, "
        "CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN split_part(url, '/', 1) || href "
        "WHEN href LIKE '/%' THEN site || href WHEN href LIKE '#%' THEN split_part(url, '#', 1) || href WHEN href LIKE '?%' THEN page || href "
        "WHEN page = site THEN site || '/' || href ELSE regexp_extract(page, '^(.*/)', 1) || href END AS link "
        "FROM (SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS site, regexp_extract(url, '^([^?#]*)', 1) AS page FROM a)",
        a=_ANCHORS,
    ),
)
def page_links(t: Tables) -> DataFrame:
    return PG.anchors(t.raw("pages"))


@query(
    "page_list_items",
    "SELECT page_id, i AS pos, item FROM (SELECT page_id, i, trim(regexp_replace(regexp_replace(li[i + 1], '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS item FROM (SELECT page_id, li, unnest(range(0, len(li))) AS i FROM "
    "(SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS li FROM pages))) WHERE item <> ''",
)
def page_list_items(t: Tables) -> DataFrame:
    return PG.list_items(t.raw("pages"))


_QUARTERS = "SELECT l_suppkey AS company_id, year(l_shipdate) AS y, quarter(l_shipdate) AS q, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3"


@query(
    "page_quarters",
    "SELECT company_id, CASE WHEN company_id % 4 = 3 THEN 'Sales of which9' ELSE 'Sales' END AS label, CAST(row_number() OVER (PARTITION BY company_id ORDER BY y, q) - 1 AS INT) AS period_idx, "
    f"'Q' || q || ' ' || y AS period, CAST(n AS VARCHAR) AS raw FROM ({_QUARTERS}) SEMI JOIN supplier ON s_suppkey = company_id",
)
def page_quarters(t: Tables) -> DataFrame:
    rows = PG.structure_pages(t.quarterly_pages()).select("company_id", F.col("quarters.periods").alias("p"), F.explode("quarters.rows").alias("r"))
    return rows.select("company_id", "r.label", F.posexplode(F.arrays_zip(F.col("p").alias("period"), F.col("r.values").alias("raw"))).alias("period_idx", "x")).select(
        "company_id", "label", "period_idx", "x.period", "x.raw"
    )


_WITH_LINES = "FROM supplier SEMI JOIN lineitem ON l_suppkey = s_suppkey"


@query(
    "page_peers",
    f"SELECT s_suppkey AS company_id, 0 AS row_idx, s_name AS Name, 'C-' || s_suppkey AS Code {_WITH_LINES} UNION ALL SELECT s_suppkey, 1, 'Next & Co', 'C-' || (s_suppkey + 1) {_WITH_LINES}",
)
def page_peers(t: Tables) -> DataFrame:
    peers = PG.structure_pages(t.quarterly_pages()).select("company_id", F.col("peers.columns").alias("c"), F.posexplode("peers.rows").alias("row_idx", "r"))
    named = F.map_from_arrays("c", "r")
    return peers.select("company_id", "row_idx", named["Name"].alias("Name"), named["Code"].alias("Code"))


@query(
    "page_quarterly_holding",
    "SELECT s_suppkey AS company_id, 'Jun' AS period, (s_suppkey % 60) || '.5%' AS promoters, CASE WHEN s_suppkey % 4 = 2 THEN '1 end tags without a start, 1 elements without an end' END AS markup_error, 2 AS peers "
    + _WITH_LINES,
)
def page_quarterly_holding(t: Tables) -> DataFrame:
    s = PG.structure_pages(t.quarterly_pages())
    return s.select(
        "company_id", F.col("shareholding.periods")[0].alias("period"), F.col("shareholding.rows")[0]["values"][0].alias("promoters"),
        "markup_error", F.size("peers.rows").alias("peers"),
    )


def _count(pattern: str, text: str = "html") -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INT)"


@query(
    "page_outline",
    "SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, "
    + f"{_count('<h[123][ >]')} AS headings, {_count('<p[ >]', "regexp_extract(html, '(?s)<article.*</article>')")} AS paragraphs, {_count('<a ')} AS links, "
    + f"{_count('<a ', "regexp_extract(html, '(?s)<nav.*</nav>')")} AS nav_links FROM pages",
)
def page_outline(t: Tables) -> DataFrame:
    return PG.outline(t.raw("pages")).drop("markup_error")
