"""Pages of long texts, keyword and heading retrieval, budgets, duplicates and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.catalog.oracle import matches, with_ctes
from flagstone.catalog.registry import query
from flagstone.functions import text as X
from flagstone.operators import research as RS
from flagstone.operators import retrieve as RT
from flagstone.operators.retrieve import Search
from flagstone.sources.bindings import Tables

SEARCHES = [
    Search("R1", ("ANNUAL_REPORT",), ("thing", "ertion", "Hable"), ("thatin", "License")),
    Search("R2", ("ANNUAL_REPORT", "WEB"), ("tion", "ment", "hetition")),
    Search("R3", ("ANNUAL_REPORT", "ANNOUNCEMENT"), ("trash", "idiot"), ("ononst", "hehely", "inoran"), note_mode=True),
    Search("R4", ("EARNINGS_PDF",), ("keit", "schaft", "erung"), ("nosuchheading",)),
]
TRIM = r"regexp_replace({}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"



def terms_sql(searches) -> str:
    rows = ", ".join(f"('{s.item_id}', {_list(s.doc_types)}, {_list(s.terms)})" for s in searches if s.terms)
    return f"SELECT * FROM (VALUES {rows}) AS t(item_id, doc_types, terms)"


def headings_sql(searches) -> str:
    rows = ", ".join(
        f"('{s.item_id}', {_list(s.doc_types)}, {i}, '{h.lower()}', {fixed.NOTE_WINDOW if s.note_mode else fixed.SECTION_WINDOW}, "
        f"{fixed.NOTE_BUDGET if s.note_mode else fixed.PASSAGE_BUDGET})"
        for s in searches for i, h in enumerate(s.headings)
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(item_id, doc_types, heading_idx, heading, win, budget)"


_TERMS, _HEADINGS = terms_sql(SEARCHES), headings_sql(SEARCHES)
_CHUNKS = (
    "SELECT run_id, doc_id, doc_order, doc_type, unlisted, i AS chunk_idx, substr(text, CAST(i * 3000 + 1 AS BIGINT), 3000) AS chunk "
    "FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 3000.0) AS BIGINT))) AS i FROM docs)"
)
_SCORED = (
    "SELECT c.*, t.item_id, t.terms, CAST(list_sum(list_transform(t.terms, lambda k: (length(lower(chunk)) - length(replace(lower(chunk), k, ''))) // length(k))) AS BIGINT) AS score "
    "FROM chunks c JOIN terms t ON c.unlisted OR list_contains(t.doc_types, c.doc_type)"
)
_AT = "list_min(list_filter(list_transform(terms, lambda k: instr(lower(chunk), k)), lambda p: p > 0))"
_EXCERPT = (
    "CASE WHEN spot IS NULL THEN " + TRIM.format("substr(chunk, 1, 1800)") + " ELSE (CASE WHEN spot - 1 - 900 > 0 THEN '…' ELSE '' END) || "
    + TRIM.format("substr(chunk, greatest(spot - 901, 0) + 1, least(spot + 899, length(chunk)) - greatest(spot - 901, 0))")
    + " || (CASE WHEN least(spot + 899, length(chunk)) < length(chunk) THEN '…' ELSE '' END) END"
)
_TOP = (
    f"SELECT *, {_EXCERPT} AS passage FROM (SELECT *, {_AT} AS spot, row_number() OVER (PARTITION BY run_id, item_id ORDER BY score DESC, doc_order, chunk_idx) AS rn "
    "FROM scored WHERE score > 0) WHERE rn <= 4"
)
KEYWORD_STEPS = {"scored": _SCORED, "top": _TOP}
_KEYWORD = {"terms": _TERMS, "chunks": _CHUNKS, "scored": _SCORED, "top": _TOP}


def budget_sql(source: str, budget: str) -> str:
    return (
        f"SELECT *, substr(passage, 1, CAST({budget} - used AS BIGINT)) AS kept FROM (SELECT *, coalesce(sum(length(passage)) OVER (PARTITION BY run_id, item_id ORDER BY rn "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {source}) WHERE used < {budget}"
    )


@query("doc_chunks", with_ctes("SELECT doc_id, chunk_idx, length(chunk) AS chars, sha256(chunk) AS digest FROM chunks", "docs", chunks=_CHUNKS))
def doc_chunks(t: Tables) -> DataFrame:
    return RT.split_pages(t.documents()).select(
        "doc_id", "chunk_idx", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("digest")
    )


MARKED = (
    "'===== PAGE ' || CAST(doc_id % 5 + 1 AS STRING) || ' =====\n' || substr(text, 1, 1500) || '\n\n=====  PAGE ' || CAST(doc_id % 5 + 7 AS STRING) || ' =====\n' || substr(text, 1501)"
)


@query(
    "marked_pages",
    with_ctes(
        f"SELECT doc_id, 0 AS chunk_idx, doc_id % 5 + 1 AS page, {TRIM.format('substr(text, 1, 1500)')} AS chunk FROM docs UNION ALL "
        f"SELECT doc_id, 1, doc_id % 5 + 7, {TRIM.format('substr(text, 1501)')} FROM docs",
        "docs",
    ),
)
def marked_pages(t: Tables) -> DataFrame:
    return RT.split_pages(t.documents().withColumn("text", F.expr(MARKED))).select("doc_id", "chunk_idx", "page", "chunk")


@query("keyword_score", with_ctes("SELECT doc_id, chunk_idx, item_id, score FROM scored WHERE score > 0", "docs", **_KEYWORD))
def keyword_score(t: Tables) -> DataFrame:
    return RT.score_chunks(RT.split_pages(t.documents()), SEARCHES).select("doc_id", "chunk_idx", "item_id", "score")


@query("excerpt", with_ctes(f"SELECT doc_id, chunk_idx, item_id, {_EXCERPT} AS passage FROM (SELECT *, {_AT} AS spot FROM scored) WHERE score > 0", "docs", **_KEYWORD))
def excerpt(t: Tables) -> DataFrame:
    scored = RT.score_chunks(RT.split_pages(t.documents()), SEARCHES)
    return scored.select("doc_id", "chunk_idx", "item_id", X.excerpt(F.col("chunk"), F.col("terms")).alias("passage"))


@query("top_passages", with_ctes("SELECT run_id, item_id, rn, doc_id, chunk_idx, score, passage FROM top", "docs", **_KEYWORD))
def top_passages(t: Tables) -> DataFrame:
    return RT.top_passages(RT.split_pages(t.documents()), SEARCHES).select(
        "run_id", "item_id", "rn", "doc_id", "chunk_idx", "score", "passage"
    )


@query("passage_budget", with_ctes("SELECT run_id, item_id, rn, kept AS passage FROM b", "docs", **_KEYWORD, b=budget_sql("top", "4000")))
def passage_budget(t: Tables) -> DataFrame:
    top = RT.top_passages(RT.split_pages(t.documents()), SEARCHES)
    return RT.apply_budget(top, F.lit(4000)).select("run_id", "item_id", "rn", "passage")


_PLACES = (
    "SELECT *, length(regexp_replace(substr(lower(text), CAST(spot + length(heading) + 1 AS BIGINT), 1200), '[^0-9]', '', 'g')) AS digits FROM ("
    "SELECT *, CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + (i - 1) * length(heading) AS BIGINT) AS spot FROM ("
    "SELECT *, unnest(range(1, len(pieces))) AS i FROM (SELECT d.*, h.item_id, h.heading_idx, h.heading, h.win, h.budget, string_split(lower(d.text), h.heading) AS pieces "
    "FROM docs d JOIN headings h ON d.unlisted OR list_contains(h.doc_types, d.doc_type))))"
)
_SECTIONS = (
    f"SELECT *, {TRIM.format('substr(text, spot + 1, win)')} AS passage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, heading_idx ORDER BY digits DESC, spot) AS pick FROM places) WHERE pick = 1"
)
_HEAD_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, item_id ORDER BY doc_order, heading_idx) AS rn FROM sections) WHERE rn <= 4"
HEADING_STEPS = {"places": _PLACES, "sections": _SECTIONS, "htop": _HEAD_TOP, "hb": budget_sql("htop", "budget")}
_HEADING = {"headings": _HEADINGS, **HEADING_STEPS}


@query("heading_section", with_ctes("SELECT doc_id, item_id, heading_idx, spot, length(passage) AS chars, sha256(passage) AS digest FROM sections", "docs", **_HEADING))
def heading_section(t: Tables) -> DataFrame:
    found = RT.heading_sections(t.documents(), SEARCHES)
    return found.select("doc_id", "item_id", "heading_idx", F.col("at").alias("spot"), F.length("passage").alias("chars"), F.sha2("passage", 256).alias("digest"))


@query(
    "document_evidence",
    with_ctes(
        "SELECT run_id, item_id, rn, doc_id, kept AS passage, 'heading' AS found_by FROM hb UNION ALL SELECT run_id, item_id, rn, doc_id, kept, 'keyword' FROM kb k "
        "WHERE NOT EXISTS (SELECT 1 FROM hb WHERE hb.run_id = k.run_id AND hb.item_id = k.item_id)",
        "docs", **_HEADING, **_KEYWORD, kb=budget_sql("top", "6500"),
    ),
)
def document_evidence(t: Tables) -> DataFrame:
    return RT.document_evidence(t.documents(), SEARCHES).drop("page", "url")


@query(
    "dedup_hash",
    with_ctes(
        "SELECT doc_id, run_id, hash, CASE WHEN url <> first THEN 'duplicate of ' || first END AS note, CASE WHEN url = first THEN length(text) END AS chars FROM "
        "(SELECT *, sha256(text) AS hash, first_value(url) OVER (PARTITION BY run_id, sha256(text) ORDER BY doc_order) AS first FROM (SELECT * REPLACE ('src' || CAST(doc_id % 3 AS VARCHAR) AS run_id) FROM docs))",
        "docs",
    ),
)
def dedup_hash(t: Tables) -> DataFrame:
    """Runs are widened to a third of all documents each, so copies meet."""
    wide = t.documents().withColumn("run_id", F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")))
    return RT.dedup_by_hash(wide).select(
        "doc_id", "run_id", F.col("content_hash").alias("hash"), "note", F.length("text").alias("chars")
    )


_STORED = (
    "SELECT run_id, url, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'FAILED' ELSE 'OK' END AS fetch_status, CASE WHEN doc_id % 5 IN (1, 2) THEN text END AS text, "
    "CASE WHEN doc_id % 5 = 3 THEN 'duplicate of other' END AS note FROM {} WHERE doc_id % 7 <> 0"
)


@query(
    "refetch_plan",
    with_ctes(
        "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'fetch' WHEN doc_id % 5 = 0 THEN 'refetch_failed' WHEN doc_id % 5 IN (1, 2, 3) THEN 'reuse' ELSE 'refetch_pruned' END AS action FROM docs",
        "docs",
    ),
)
def refetch_plan(t: Tables) -> DataFrame:
    links = t.documents().select("run_id", "url", "doc_id")
    stored = t.documents().filter("doc_id % 7 <> 0").selectExpr(
        "run_id", "url", "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'FAILED' ELSE 'OK' END AS fetch_status",
        "CASE WHEN doc_id % 5 IN (1, 2) THEN text END AS text", "CASE WHEN doc_id % 5 = 3 THEN 'duplicate of other' END AS note",
    )
    return RT.plan_refetch(links, stored).select("doc_id", "action")


_NAMED = "CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'Balance sheet ' || CAST(doc_id AS STRING) WHEN 1 THEN 'Provisional FS' WHEN 2 THEN NULL ELSE 'Deck ' || CAST(doc_id AS STRING) END"


@query(
    "feed_select",
    with_ctes(
        "SELECT run_id, doc_id, chars, before AS chars_before FROM (SELECT *, coalesce(sum(chars) OVER (PARTITION BY run_id ORDER BY doc_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
        "FROM (SELECT *, length('\n===== DOCUMENT: ' || coalesce(nm, 'financials') || ' =====\n') + length(text) + 1 AS chars FROM n WHERE st OR NOT EXISTS "
        "(SELECT 1 FROM n m WHERE m.run_id = n.run_id AND m.st))) WHERE before < 20000",
        "docs", n=f"SELECT *, coalesce({matches('nm', fixed.STATEMENT_NAME)}, false) AS st FROM (SELECT *, CASE WHEN run_id = 'src3' THEN 'Deck' ELSE {_NAMED} END AS nm FROM docs)",
    ),
)
def feed_select(t: Tables) -> DataFrame:
    named = t.documents().withColumn("name", F.expr(f"CASE WHEN run_id = 'src3' THEN 'Deck' ELSE {_NAMED} END"))
    return RT.select_feed(named, 20000).select("run_id", "doc_id", "chars", "chars_before")


_LABELS = ["Transcript", "PPT", "Notes", "REC", "Investor presentation", "Audio recording", "Filing"]
_LABEL_CASE = "CASE CAST(doc_id % 7 AS INT) " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(_LABELS)) + " END"
_CATEGORY_CASE = "CASE doc_type WHEN 'ANNUAL_REPORT' THEN 'annual_report' WHEN 'EARNINGS_PDF' THEN 'concall' WHEN 'ANNOUNCEMENT' THEN 'announcement' ELSE 'other' END"
_RANK = "CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 1 WHEN 2 THEN 2 WHEN 6 THEN 3 ELSE 4 END"


def links(t: Tables) -> DataFrame:
    return t.documents().selectExpr("run_id", "doc_id", f"{_CATEGORY_CASE} AS category", f"{_LABEL_CASE} AS label", "url")


@query(
    "link_rank",
    with_ctes(f"SELECT run_id, doc_id, {_RANK} AS rank, row_number() OVER (PARTITION BY run_id ORDER BY {_RANK}, doc_id) AS place FROM docs WHERE doc_type = 'EARNINGS_PDF'", "docs"),
)
def link_rank(t: Tables) -> DataFrame:
    from flagstone.operators.ordering import numbered

    ranked = links(t).filter("category = 'concall'").withColumn("rank", RS.link_rank(F.col("label")))
    # a rank may hold most links of a run, so its pieces are id ranges too
    piece = F.struct("rank", F.floor(F.col("doc_id") / 1024).alias("ids"))
    return numbered(ranked, ["run_id"], piece, ["rank", "doc_id"], "place").select("run_id", "doc_id", "rank", "place")


@query(
    "cap_per_category",
    with_ctes(
        f"SELECT run_id, doc_id, category, rn FROM (SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY doc_id) AS rn FROM (SELECT *, {_CATEGORY_CASE} AS category FROM docs)) "
        "WHERE rn <= CASE category WHEN 'annual_report' THEN 3 WHEN 'concall' THEN 8 WHEN 'announcement' THEN 20 ELSE 10 END",
        "docs",
    ),
)
def cap_per_category(t: Tables) -> DataFrame:
    return RS.cap_per_group(links(t), ["run_id"], [F.asc("doc_id")]).select("run_id", "doc_id", "category", "rn")


@query(
    "citation_pick",
    with_ctes(
        "SELECT e.run_id, e.item_id, coalesce(p.doc_id, f.doc_id) AS doc_id, CASE WHEN p.doc_id IS NOT NULL THEN e.page ELSE f.chunk_idx END AS cited_page FROM "
        "(SELECT run_id, item_id, CASE WHEN max(doc_id) % 2 = 0 THEN max(chunk_idx) ELSE 999 END AS page FROM top GROUP BY 1, 2) e JOIN (SELECT * FROM top WHERE rn = 1) f "
        "ON f.run_id = e.run_id AND f.item_id = e.item_id LEFT JOIN (SELECT run_id, item_id, chunk_idx, arg_min(doc_id, rn) AS doc_id FROM top GROUP BY 1, 2, 3) p "
        "ON p.run_id = e.run_id AND p.item_id = e.item_id AND p.chunk_idx = e.page",
        "docs", **_KEYWORD,
    ),
)
def citation_pick(t: Tables) -> DataFrame:
    """Chunk numbers stand in for pages: these texts carry no markers."""
    top = RT.top_passages(RT.split_pages(t.documents()), SEARCHES).withColumn("page", F.col("chunk_idx"))
    extracts = top.groupBy("run_id", "item_id").agg(
        F.when(F.max("doc_id") % 2 == 0, F.max("chunk_idx")).otherwise(999).alias("page")
    )
    return RS.pick_citation(extracts, top)


@query(
    "evidence_fallback",
    with_ctes(
        "SELECT run_id, item_id, arg_min(source, p) AS source FROM (SELECT *, CASE source WHEN 'structured' THEN 0 WHEN 'web' THEN CASE WHEN item_id = 4 AND run_id % 4 <> 0 THEN 1 ELSE 2 END "
        "ELSE CASE WHEN item_id = 4 AND run_id % 4 <> 0 THEN 2 ELSE 1 END END AS p FROM (SELECT l_orderkey AS run_id, l_linenumber AS item_id, "
        "CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'structured' WHEN 1 THEN 'document' ELSE 'web' END AS source, l_returnflag <> 'R' AS found FROM lineitem) WHERE found) GROUP BY 1, 2",
    ),
)
def evidence_fallback(t: Tables) -> DataFrame:
    candidates = t.raw("lineitem").selectExpr(
        "l_orderkey AS run_id", "l_linenumber AS item_id",
        "CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'structured' WHEN 1 THEN 'document' ELSE 'web' END AS source",
        "l_returnflag <> 'R' AS found", "l_linenumber = 4 AS web_first", "l_orderkey % 4 = 0 AS unlisted",
    )
    return RS.choose_evidence(candidates).select("run_id", "item_id", "source")
