"""The assessment with its evidence: sources, what there is to read, results with lineage, stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.catalog import assessment as A
from flagstone.catalog import research as RQ
from flagstone.catalog import retrieval as RV
from flagstone.catalog.oracle import CTES, na, with_ctes
from flagstone.catalog.registry import query
from flagstone.operators import research as RS
from flagstone.operators import retrieve as RT
from flagstone.operators.retrieve import Search
from flagstone.operators.state import grid
from flagstone.plans import assess
from flagstone.plans import evidence as EV
from flagstone.plans.evidence import Route
from flagstone.plans.stages import Stages
from flagstone.session import scratch_dir
from flagstone.sources.bindings import WRITE_ORDER, Tables

_R1, _R2, _R3, _R4 = RV.SEARCHES


def _for(item: str, s: Search) -> Search:
    return Search(item, s.doc_types, s.keywords, s.headings, s.note_mode)


# documents alone, documents then web, web then documents, web alone, nothing to look in
ROUTES = [
    Route(_for("A2-01", _R1)), Route(_for("A1-02", _R2), web=True), Route(_for("A9-04", _R3), web=True, web_first=True),
    Route(_for("A3-05", _R4)), Route(Search("A15-03", ()), web=True, web_first=True), Route(_for("A4-05", _R4), web=True),
    Route(_for("A14-01", _R2)), Route(Search("A6-04", ())),
]
_SEARCHES = EV.searches(ROUTES)

# about ten documents and five hits for each company; a document has two marked pages
_HIT_ITEM = "CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'A9-04' WHEN 1 THEN 'A4-05' WHEN 2 THEN 'A15-03' ELSE 'A1-02' END AS item_id"
_COMPANY = "CAST(FLOOR(page_id / 5) AS BIGINT)"
_HIT = [
    f"{_COMPANY} AS company_id" if c.endswith(" AS company_id") else _HIT_ITEM if c.endswith(" AS item_id")
    else c.replace("(page_id % 5)", f"({_COMPANY} % 5)") if c.endswith(" AS name")
    else f"CASE WHEN {_COMPANY} % 5 = 0 THEN NULL ELSE 'T' || CAST({_COMPANY} % 5 AS STRING) END AS ticker" if c.endswith(" AS ticker")
    else c
    for c in RQ.HIT
]
_READING = [
    "company_id AS run_id", f"{A._TEXT_ID} AS item_id", f"{A._TEXT_VALUE} AS value", f"{A._TEXT_EVIDENCE} AS evidence",
    "CAST(part_id % 12 AS INT) AS page", "CASE CAST(part_id % 3 AS INT) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence",
    "CASE WHEN part_id % 11 = 0 THEN 'reader timed out' END AS error",
]
_UNREAD = "(run_id + length(item_id)) % 4 = 0"


def documents(t: Tables) -> DataFrame:
    run = F.floor(F.col("doc_id") / 10).cast("bigint")
    return t.documents().withColumn("text", F.expr(RV.MARKED)).withColumn("run_id", run)


def passages(t: Tables) -> DataFrame:
    return RT.document_evidence(documents(t), _SEARCHES)


def hits(t: Tables) -> DataFrame:
    return RS.research_hits(t.raw("pages").selectExpr(*_HIT))


def readings(t: Tables) -> DataFrame:
    rows = t.spread("lineitem").selectExpr(*A._PICK).selectExpr(*_READING, *WRITE_ORDER)
    none = F.lit(None).cast("string")
    return rows.filter(f"NOT ({_UNREAD})").select(
        "run_id", "item_id", F.struct(*WRITE_ORDER).alias("seq"), "page", "value", "evidence", none.alias("rationale"),
        "confidence", F.lit("gamma").alias("provider"), "error",
    )


def candidates(t: Tables) -> DataFrame:
    return A.runs(t).join(t.companies().select("company_id", "ticker"), "company_id").select("run_id", "company_id", "ticker")


def chosen(t: Tables) -> DataFrame:
    return EV.choose_places(candidates(t), ROUTES, passages(t), hits(t))


def assessed(t: Tables, stored: DataFrame | None = None) -> DataFrame:
    findings = EV.with_readings(chosen(t), readings(t), A.CHECKLIST)
    return assess.run_assessment(
        A.runs(t), t.companies(), A.CHECKLIST, t.statements(), findings, A.opinions(t), stored, scale_divisor=A.SCALE_DIVISOR
    )


def stored(t: Tables) -> DataFrame:
    """What earlier passes left: committed, deferred with an old flag, failed, or nothing."""
    turn = F.pmod(F.col("run_id") + F.length("item_id"), F.lit(5))
    cells = grid(A.runs(t), A.CHECKLIST).withColumn("_n", turn).filter("_n < 3")
    kinds = {"flag": "string", "confidence": "double", "gate_pass": "boolean", "doc_id": "bigint", "page": "int"}
    blank = {c: F.lit(None).cast(kinds.get(c, "string")) for c in ["error", *EV.STORED]}
    flag = F.when(F.col("_n") == 0, "GREEN").when(F.col("_n") == 1, "RED")
    status = F.when(F.col("_n") == 0, "DONE").when(F.col("_n") == 1, "DEFERRED").otherwise("ERROR")
    return cells.withColumns({**blank, "flag": flag, "status": status, "attempts": F.col("_n").cast("bigint") + 1})


# --- oracle -----------------------------------------------------------------------------------------------
_MARKER = r"=====\s*PAGE\s+(\d+)\s*====="
_ROUTE_ROWS = ", ".join(
    f"('{r.search.item_id}', {str(r.reads_documents).lower()}, {str(r.web).lower()}, {str(r.web_first).lower()})" for r in ROUTES
)
_CHUNKS = " UNION ALL ".join(
    f"SELECT run_id, doc_id, doc_order, doc_type, unlisted, url, {i} AS chunk_idx, doc_id % 5 + {n} AS page, {RV.TRIM.format(part)} AS chunk FROM plain"
    for i, n, part in [(0, 1, "substr(text, 1, 1500)"), (1, 7, "substr(text, 1501)")]
)
_EVIDENCE = {
    "plain": f"SELECT * REPLACE (doc_id // 10 AS run_id) FROM ({CTES['docs'][0]}) WHERE text IS NOT NULL",
    "docs": f"SELECT * REPLACE ({RV.MARKED} AS text) FROM plain",
    "terms": RV.terms_sql(_SEARCHES), "headings": RV.headings_sql(_SEARCHES), "chunks": _CHUNKS,
    **RV.KEYWORD_STEPS, **RV.HEADING_STEPS, "kb": RV.budget_sql("top", "6500"),
    "pass": (
        f"SELECT run_id, item_id, rn, doc_id, url, CAST(regexp_extract_all(substr(text, 1, spot), '{_MARKER}', 1)[-1] AS INT) AS page, kept AS passage FROM hb UNION ALL "
        "SELECT run_id, item_id, rn, doc_id, url, page, kept FROM kb k WHERE NOT EXISTS (SELECT 1 FROM hb WHERE hb.run_id = k.run_id AND hb.item_id = k.item_id)"
    ),
    "h": "SELECT " + ", ".join(_HIT) + " FROM pages",
    "web": RQ.HITS_KEPT_SQL,
    "routes": f"SELECT * FROM (VALUES {_ROUTE_ROWS}) AS v(item_id, documents, by_web, web_first)",
    "inside": "SELECT *, count(*) OVER (PARTITION BY run_id, item_id) AS n FROM pass QUALIFY row_number() OVER (PARTITION BY run_id, item_id ORDER BY rn) = 1",
    "outside": "SELECT *, count(*) OVER (PARTITION BY company_id, item_id) AS n FROM web QUALIFY row_number() OVER (PARTITION BY company_id, item_id ORDER BY rn) = 1",
    "ch": (
        "SELECT run_id, item_id, source, CASE source WHEN 'web' THEN wn WHEN 'document' THEN dn ELSE 0 END AS places, CASE WHEN source = 'document' THEN doc_id END AS doc_id, "
        "CASE source WHEN 'web' THEN wurl WHEN 'document' THEN durl END AS url, CASE WHEN source = 'document' THEN page END AS page, "
        "CASE WHEN source IS NOT NULL THEN NULL WHEN documents AND by_web THEN 'no passage and no hit' WHEN documents THEN 'no passage' WHEN by_web THEN 'no hit' ELSE 'nothing to look in' END AS note FROM "
        "(SELECT c.company_id AS run_id, r.*, d.doc_id, d.page, d.url AS durl, d.n AS dn, w.url AS wurl, w.n AS wn, CASE WHEN w.url IS NOT NULL AND web_first AND c.ticker IS NOT NULL THEN 'web' "
        "WHEN d.doc_id IS NOT NULL THEN 'document' WHEN w.url IS NOT NULL THEN 'web' END AS source FROM companies c CROSS JOIN routes r "
        "LEFT JOIN inside d ON d.run_id = c.company_id AND d.item_id = r.item_id LEFT JOIN outside w ON w.company_id = c.company_id AND w.item_id = r.item_id AND r.by_web)"
    ),
    "rd": (
        f"SELECT {', '.join(_READING)}, {', '.join(WRITE_ORDER)} FROM (SELECT {', '.join(A._PICK)} FROM lineitem) WHERE NOT ({_UNREAD.replace('run_id', 'company_id').replace('item_id', A._TEXT_ID)}) "
        f"QUALIFY row_number() OVER (PARTITION BY company_id, {A._TEXT_ID} ORDER BY " + ", ".join(f"{c} DESC" for c in WRITE_ORDER) + ") = 1"
    ),
}
# the readings of what was chosen take the place of ready findings
_PICKED = (
    f"SELECT c.run_id, c.item_id, CASE WHEN usable AND NOT {na('r.value')} THEN r.value END AS value, CASE WHEN usable THEN r.evidence END AS evidence, "
    "c.source IS NOT NULL AND r.run_id IS NULL AS deferred, coalesce(c.source, 'none') AS source, CASE WHEN c.source IS NOT NULL THEN r.error END AS error, "
    f"CASE WHEN c.source IS NOT NULL AND r.run_id IS NULL THEN NULL WHEN c.source = 'web' OR NOT usable OR {na('r.value')} THEN 0.3 WHEN r.confidence = 'high' THEN 0.9 WHEN r.confidence = 'low' THEN 0.3 ELSE 0.6 END AS confidence, "
    "CASE WHEN failed THEN NULL WHEN p.run_id IS NOT NULL THEN p.doc_id ELSE c.doc_id END AS doc_id, CASE WHEN failed THEN NULL WHEN p.run_id IS NOT NULL THEN p.page ELSE c.page END AS page, "
    "CASE WHEN failed THEN NULL WHEN p.run_id IS NOT NULL THEN p.url ELSE c.url END AS url FROM (SELECT c.*, c.source IS NOT NULL AND r.run_id IS NOT NULL AND r.error IS NULL AS usable, "
    "c.source IS NOT NULL AND coalesce(r.error IS NOT NULL, false) AS failed FROM ch c LEFT JOIN rd r ON r.run_id = c.run_id AND r.item_id = c.item_id) c "
    "LEFT JOIN rd r ON r.run_id = c.run_id AND r.item_id = c.item_id LEFT JOIN (SELECT * FROM pass QUALIFY row_number() OVER (PARTITION BY run_id, item_id, page ORDER BY rn) = 1) p "
    "ON c.source = 'document' AND p.run_id = c.run_id AND p.item_id = c.item_id AND p.page = r.page"
)
_RESULT = {
    **_EVIDENCE, **A._oracle_ctes(), "picked": _PICKED,
    "traced": (
        "SELECT r.run_id, r.item_id, CASE WHEN c.gone THEN 'none' WHEN s.value IS NOT NULL THEN 'structured' ELSE coalesce(p.source, 'none') END AS source, "
        "CASE WHEN failed THEN 'error' ELSE r.rule_fired END AS rule_fired, CASE WHEN failed THEN 'ERROR' ELSE r.status END AS status, r.flag, "
        "CASE WHEN r.non_negotiable AND r.flag IN ('GREEN', 'RED') THEN r.flag = 'GREEN' END AS gate_pass, "
        "CASE WHEN c.gone OR s.value IS NOT NULL THEN 0.9 WHEN r.status = 'DEFERRED' THEN NULL ELSE coalesce(p.confidence, 0.3) END AS confidence, "
        "CASE WHEN own THEN p.doc_id END AS doc_id, CASE WHEN own THEN p.page END AS page, CASE WHEN own THEN p.url END AS url, "
        "CASE WHEN failed THEN p.error WHEN r.status = 'DEFERRED' THEN 'no reading yet' END AS error "
        "FROM (SELECT r.*, x.failed, x.own FROM res r JOIN (SELECT c.run_id, c.item_id, p.error IS NOT NULL AND NOT c.gone AND s.value IS NULL AS failed, NOT c.gone AND s.value IS NULL AS own FROM cell c "
        "LEFT JOIN picked p ON p.run_id = c.run_id AND p.item_id = c.item_id LEFT JOIN structured s ON s.run_id = c.run_id AND s.item_id = c.item_id) x ON x.run_id = r.run_id AND x.item_id = r.item_id) r "
        "JOIN cell c ON c.run_id = r.run_id AND c.item_id = r.item_id LEFT JOIN picked p ON p.run_id = r.run_id AND p.item_id = r.item_id "
        "LEFT JOIN structured s ON s.run_id = r.run_id AND s.item_id = r.item_id"
    ),
}
_BASES = ("companies", "metrics", "rows", "scale")


@query("evidence_sources", with_ctes("SELECT run_id, item_id, source, places, doc_id, url, page, note FROM ch", "companies", **_EVIDENCE))
def evidence_sources(t: Tables) -> DataFrame:
    return EV.evidence_rows(chosen(t)).drop("company_id")


@query(
    "evidence_to_read",
    with_ctes(
        "SELECT p.run_id, p.item_id, 'document' AS source, p.rn, p.doc_id, p.url, p.page, sha256(p.passage) AS digest FROM pass p JOIN opn o ON o.run_id = p.run_id AND o.item_id = p.item_id AND o.source = 'document' "
        "UNION ALL SELECT o.run_id, o.item_id, 'web', w.rn, NULL, w.url, NULL, sha256(w.passage) FROM web w JOIN opn o ON o.run_id = w.company_id AND o.item_id = w.item_id AND o.source = 'web'",
        "companies", **_EVIDENCE,
        opn=f"SELECT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM (SELECT {', '.join(_READING)} FROM (SELECT {', '.join(A._PICK)} FROM lineitem)) r WHERE NOT ({_UNREAD.replace('run_id', 'r.run_id').replace('item_id', 'r.item_id')}) "
        "AND r.error IS NULL AND r.run_id = ch.run_id AND r.item_id = ch.item_id)",
    ),
)
def evidence_to_read(t: Tables) -> DataFrame:
    # places and texts come from the same passages, which are worked out once
    stages = Stages(t.spark, scratch_dir(t.spark, "evidence"))
    inside, outside, places = EV.gather(
        candidates(t), A.CHECKLIST, documents(t), t.raw("pages").selectExpr(*_HIT), stages, ROUTES
    )
    read = EV.to_read(places, inside, outside, readings(t))
    return read.withColumn("digest", F.sha2("passage", 256)).drop("passage")


@query("assessment_evidence", with_ctes("SELECT * FROM traced", *_BASES, **_RESULT))
def assessment_evidence(t: Tables) -> DataFrame:
    """Every item with where its evidence stands and how sure it is."""
    return assessed(t).select(
        "run_id", "item_id", "source", "rule_fired", "status", "flag", "gate_pass", "confidence", "doc_id", "page", "url", "error"
    )


@query(
    "assessment_stored",
    with_ctes(
        "SELECT run_id, item_id, CASE WHEN n = 0 THEN 'DONE' ELSE status END AS status, CASE WHEN n = 0 THEN 'GREEN' WHEN status = 'DEFERRED' THEN CASE WHEN n = 1 THEN 'RED' END ELSE flag END AS flag, "
        "CASE WHEN n = 0 OR status = 'DEFERRED' THEN NULL ELSE url END AS url, CASE WHEN n > 0 THEN error END AS error, CAST(CASE WHEN n = 0 THEN 1 WHEN n < 3 THEN n + 2 ELSE 1 END AS BIGINT) AS attempts "
        "FROM (SELECT *, (run_id + length(item_id)) % 5 AS n FROM traced)",
        *_BASES, **_RESULT,
    ),
)
def assessment_stored(t: Tables) -> DataFrame:
    """A resumed pass written over what earlier ones left."""
    before = stored(t)
    after = EV.store_results(before, assessed(t, before))
    return after.select("run_id", "item_id", "status", "flag", "url", "error", "attempts")
