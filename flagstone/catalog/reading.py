"""Rollups, gate, report rows, cards, shares, progress and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.catalog.oracle import with_ctes
from flagstone.catalog.registry import query
from flagstone.catalog.state import NOW
from flagstone.functions import predicates as P
from flagstone.operators import classify as C
from flagstone.operators import report as R
from flagstone.operators import state as S
from flagstone.sources.bindings import ITEMS, Tables

_DONE = "status IN ('DONE', 'NEEDS_REVIEW')"


def state(t: Tables) -> DataFrame:
    return S.items_with_results(t.runs().select("run_id", "company_id"), ITEMS, t.results(), ["status", "flag", "doc_id"])


def _counts(flag: str) -> str:
    return ", ".join(
        f"count(*) FILTER ({flag} = '{f}') AS {n}" for f, n in [("GREEN", "green"), ("RED", "red"), ("NEUTRAL", "neutral"), ("NOT_AVAILABLE", "na")]
    )


_LIVE = f"SELECT *, CASE WHEN {_DONE} THEN flag END AS live FROM state"


@query(
    "section_rollup",
    with_ctes(
        f"SELECT run_id, section_code, {_counts('live')}, count(*) AS total FROM l GROUP BY GROUPING SETS ((run_id, section_code), (run_id))",
        "state", l=_LIVE,
    ),
)
def section_rollup(t: Tables) -> DataFrame:
    return R.section_rollup(state(t))


@query(
    "gate",
    with_ctes(
        "SELECT run_id, count(*) FILTER (live = 'RED' AND non_negotiable) AS failed, count(*) FILTER (live = 'RED' AND non_negotiable) = 0 AS gate_pass FROM l GROUP BY 1",
        "state", l=_LIVE,
    ),
)
def gate(t: Tables) -> DataFrame:
    return R.gate(state(t)).select("run_id", F.size("failed_items").alias("failed"), "gate_pass")


_N = lambda s: f"count(*) FILTER (status = '{s}')"


@query(
    "run_complete",
    with_ctes(
        f"SELECT run_id, {_N('DONE')} AS items_done, {_N('NEEDS_REVIEW')} AS items_review, {_N('DEFERRED')} AS items_deferred, {_N('PENDING')} AS items_pending, "
        f"CASE WHEN {_N('DEFERRED')} + {_N('PENDING')} + {_N('ERROR')} = 0 THEN 'DONE' ELSE 'PARTIAL' END AS run_status FROM state GROUP BY 1",
        "state",
    ),
)
def run_complete(t: Tables) -> DataFrame:
    return R.run_status(state(t)).select("run_id", "items_done", "items_review", "items_deferred", "items_pending", "run_status")


@query(
    "run_summary",
    with_ctes(
        f"SELECT run_id, count(*) AS items_total, {_counts('live').replace('AS na', 'AS not_available')}, {_N('DONE')} AS items_done, "
        "count(*) FILTER (live = 'RED' AND non_negotiable) = 0 AS gate_pass FROM l GROUP BY 1",
        "state", l=_LIVE,
    ),
)
def run_summary(t: Tables) -> DataFrame:
    return R.summarize(state(t)).select(
        "run_id", "items_total", "green", "red", "neutral", "not_available", "items_done", "gate_pass"
    )


@query("stale_flag", with_ctes(f"SELECT run_id, item_id, CASE WHEN {_DONE} THEN flag END AS flag, CASE WHEN NOT {_DONE} THEN flag END AS stale_flag FROM state", "state"))
def stale_flag(t: Tables) -> DataFrame:
    live, stale = R.split_flag(F.col("status"), F.col("flag"))
    return state(t).select("run_id", "item_id", live.alias("flag"), stale.alias("stale_flag"))


# --- applicability: results of listed and unlisted companies over known item ids ---------------------------
_IDS = ["A1-01", "A1-02", "A2-01", "A3-05", "A15-01", "A5-06", "A4-05"]
_ID_CASE = "CASE item_id " + " ".join(f"WHEN {n} THEN '{i}'" for n, i in enumerate(_IDS, 1)) + " END"
_RAW = (
    f"SELECT s.run_id, {_ID_CASE} AS item_id, s.section_code, s.status, s.flag, 'T' || s.item_id AS item, CASE WHEN s.company_id % 4 = 0 THEN NULL ELSE 'T' || s.company_id END AS ticker, "
    "CASE WHEN s.flag IS NULL THEN NULL WHEN s.run_id % 3 = 0 THEN 'not available' ELSE 'value ' || s.doc_id END AS value, "
    f"CASE WHEN s.flag = 'NOT_AVAILABLE' AND s.run_id % 2 = 0 THEN '{fixed.LISTED_ONLY_VERDICT}' WHEN s.flag IS NULL THEN NULL ELSE 'verdict ' || s.doc_id END AS verdict, s.doc_id FROM state s"
)
_FORCED = "ticker IS NULL AND item_id IN ('" + "', '".join(fixed.LISTED_ONLY) + "')"
_REPORT = (
    f"SELECT run_id, item_id, item, section_code, ticker, doc_id, CASE WHEN {_FORCED} THEN 'DONE' ELSE status END AS status, "
    f"CASE WHEN {_FORCED} THEN 'NOT_AVAILABLE' WHEN {_DONE} THEN flag END AS flag, CASE WHEN NOT ({_FORCED}) AND NOT {_DONE} THEN flag END AS stale_flag, "
    f"CASE WHEN {_FORCED} THEN 'not_applicable' WHEN {_DONE} AND flag = 'NOT_AVAILABLE' THEN CASE WHEN verdict = '{fixed.LISTED_ONLY_VERDICT}' THEN 'not_applicable' ELSE 'no_data' END END AS na_kind, "
    f"CASE WHEN {_FORCED} THEN 'not applicable' ELSE value END AS value, CASE WHEN {_FORCED} THEN '{fixed.LISTED_ONLY_VERDICT}' ELSE verdict END AS verdict, "
    f"NOT ({_FORCED}) AND status = 'NEEDS_REVIEW' AS needs_review FROM raw"
)


def raw_rows(t: Tables) -> DataFrame:
    return state(t).select(*[v.alias(k) for k, v in _raw_item(F.col).items()])


def _raw_item(c: Callable[[str], Column]) -> dict[str, Column]:
    doc = c("doc_id").cast("string")
    value = F.when(c("flag").isNotNull(), F.when(c("run_id") % 3 == 0, "not available").otherwise(F.concat(F.lit("value "), doc)))
    verdict = (
        F.when((c("flag") == "NOT_AVAILABLE") & (c("run_id") % 2 == 0), fixed.LISTED_ONLY_VERDICT)
        .when(c("flag").isNotNull(), F.concat(F.lit("verdict "), doc))
    )
    return {
        "run_id": c("run_id"), "item_id": F.element_at(F.array(*map(F.lit, _IDS)), c("item_id")),
        "item": F.concat(F.lit("T"), c("item_id").cast("string")), "section_code": c("section_code"),
        "ticker": F.when(c("company_id") % 4 != 0, F.concat(F.lit("T"), c("company_id").cast("string"))),
        "status": c("status"), "flag": c("flag"), "value": value, "verdict": verdict, "doc_id": c("doc_id"),
    }


def report(t: Tables) -> DataFrame:
    return R.report_items(raw_rows(t))


@query(
    "applicability_gate",
    with_ctes(
        f"SELECT run_id, item_id, CASE WHEN {_FORCED} THEN 'DONE' ELSE status END AS status, CASE WHEN {_FORCED} THEN 'NOT_AVAILABLE' ELSE flag END AS flag, "
        f"CASE WHEN {_FORCED} THEN 'not applicable' ELSE value END AS value FROM raw",
        "state", raw=_RAW,
    ),
)
def applicability_gate(t: Tables) -> DataFrame:
    return C.apply_applicability(raw_rows(t)).select("run_id", "item_id", "status", "flag", "value")


@query("applicability_override", with_ctes("SELECT run_id, item_id, status, flag, stale_flag, na_kind, value, verdict, needs_review FROM rep", "state", raw=_RAW, rep=_REPORT))
def applicability_override(t: Tables) -> DataFrame:
    return report(t).select("run_id", "item_id", "status", "flag", "stale_flag", "na_kind", "value", "verdict", "needs_review")


@query(
    "na_split",
    with_ctes(
        "SELECT run_id, count(*) FILTER (flag = 'NOT_AVAILABLE' AND na_kind = 'not_applicable') AS not_applicable, "
        "count(*) FILTER (flag = 'NOT_AVAILABLE' AND na_kind = 'no_data') AS no_data FROM rep GROUP BY 1",
        "state", raw=_RAW, rep=_REPORT,
    ),
)
def na_split(t: Tables) -> DataFrame:
    return R.na_split(report(t))


_SECTION = (
    "SELECT run_id, section_code, count(*) FILTER (flag = 'GREEN') AS green, count(*) FILTER (flag = 'RED') AS red, count(*) FILTER (flag = 'NEUTRAL') AS neutral, "
    "count(*) FILTER (coalesce(flag, 'NOT_AVAILABLE') = 'NOT_AVAILABLE') AS na, count(*) FILTER (flag IN ('GREEN', 'RED', 'NEUTRAL')) AS answered, count(*) AS total FROM rep GROUP BY 1, 2"
)


@query("section_counts", with_ctes(_SECTION, "state", raw=_RAW, rep=_REPORT))
def section_counts(t: Tables) -> DataFrame:
    return R.section_counts(report(t))


@query(
    "export_summary",
    with_ctes("SELECT *, CAST(CAST(floor(answered / total * 100.0e0 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS answered_pct FROM sec", "state", raw=_RAW, rep=_REPORT, sec=_SECTION),
)
def export_summary(t: Tables) -> DataFrame:
    return R.export_summary(report(t))


def checklist_rows(t: Tables) -> DataFrame:
    named = t.documents().select("doc_id", F.col("name").alias("doc_name"))
    rows = report(t).join(named, "doc_id", "left")
    return rows.withColumn("page", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 300)).withColumn(
        "confidence", F.when(F.col("doc_id").isNotNull(), (F.col("doc_id") % 10) / 10.0)
    )


@query(
    "export_checklist",
    with_ctes(
        "SELECT r.run_id, r.section_code, r.item_id, CASE WHEN na_kind = 'not_applicable' THEN 'N/A (n/a)' WHEN na_kind = 'no_data' THEN 'N/A (no data)' WHEN flag = 'GREEN' THEN 'Green' "
        "WHEN flag = 'RED' THEN 'Red' WHEN flag = 'NEUTRAL' THEN 'Neutral' WHEN flag = 'NOT_AVAILABLE' THEN 'N/A' ELSE 'Pending' END AS flag_label, "
        "CASE WHEN value <> '' AND lower(value) <> 'not available' THEN value ELSE '—' END AS finding, coalesce(verdict, '—') AS assessment, "
        "CASE WHEN r.doc_id IS NULL THEN '—' WHEN r.doc_id % 10 >= 8 THEN 'High' WHEN r.doc_id % 10 >= 5 THEN 'Medium' ELSE 'Low' END AS confidence_label, "
        "coalesce(CASE WHEN d.name IS NOT NULL THEN d.name || CASE WHEN r.doc_id % 2 = 0 THEN ' · p.' || (r.doc_id % 300) ELSE '' END "
        "WHEN r.doc_id % 2 = 0 THEN 'p.' || (r.doc_id % 300) END, '—') AS source FROM rep r LEFT JOIN docs d ON d.doc_id = r.doc_id",
        "state", "docs", raw=_RAW, rep=_REPORT,
    ),
)
def export_checklist(t: Tables) -> DataFrame:
    return R.export_checklist(checklist_rows(t))


@query(
    "watchlist",
    with_ctes(
        "SELECT run_id, item_id, CASE WHEN flag = 'RED' THEN 1 ELSE 2 END AS block, coalesce(verdict, value, '—') AS assessment FROM rep WHERE flag = 'RED' OR needs_review",
        "state", raw=_RAW, rep=_REPORT,
    ),
)
def watchlist(t: Tables) -> DataFrame:
    return R.watchlist(report(t))


@query(
    "report_search",
    with_ctes(
        "SELECT run_id, section_code, item_id, effective FROM (SELECT *, coalesce(flag, stale_flag, 'NOT_AVAILABLE') AS effective FROM rep) WHERE effective = 'NEUTRAL' "
        "AND (contains(lower(item_id), 'e 12') OR contains(lower(item), 'e 12') OR contains(lower(coalesce(verdict, '')), 'e 12') OR contains(lower(coalesce(value, '')), 'e 12'))",
        "state", raw=_RAW, rep=_REPORT,
    ),
)
def report_search(t: Tables) -> DataFrame:
    return R.search_report(report(t), "NEUTRAL", " E 12").select("run_id", "section_code", "item_id", "effective")


@query(
    "section_sources",
    with_ctes(
        "SELECT run_id, section_code, count(DISTINCT d.name) AS documents FROM state s JOIN docs d ON d.doc_id = s.doc_id GROUP BY 1, 2".replace("run_id, section", "s.run_id, s.section"),
        "state", "docs",
    ),
)
def section_sources(t: Tables) -> DataFrame:
    named = t.documents().select("doc_id", F.col("name").alias("doc_name"))
    return R.section_sources(state(t).join(named, "doc_id", "left"))


@query(
    "report_rows",
    with_ctes(
        "SELECT x.run_id, x.item_id, x.flag, d.name AS doc_name, c.name AS company, c.ticker FROM results x LEFT JOIN docs d ON d.doc_id = x.doc_id "
        "LEFT JOIN runs r ON r.run_id = x.run_id LEFT JOIN companies c ON c.company_id = r.company_id",
        "results", "docs", "runs", "companies",
    ),
)
def report_rows(t: Tables) -> DataFrame:
    return R.report_rows(t.results(), t.documents(), t.runs(), t.companies()).select(
        "run_id", "item_id", "flag", "doc_name", "company", "ticker"
    )


_CARDS = (
    "SELECT c.company_id, c.ticker, l.run_id, l.status, coalesce(green, 0) AS green, coalesce(red, 0) AS red, coalesce(neutral, 0) AS neutral, coalesce(na, 0) AS na, "
    "coalesce(green + red + neutral, 0) AS answered, coalesce(green + red + neutral + na, 0) AS total, coalesce(failed, 0) = 0 AS gate_pass "
    "FROM companies c JOIN latest l ON l.company_id = c.company_id LEFT JOIN tally t ON t.run_id = l.run_id"
)
_CARD_CTES = {
    "latest": "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, run_id DESC) = 1",
    "tally": f"SELECT run_id, {_counts('flag')}, count(*) FILTER (flag = 'RED' AND item_id = 3) AS failed FROM results WHERE {_DONE} GROUP BY 1",
    "cards": _CARDS,
}


def cards(t: Tables) -> DataFrame:
    results = t.results().withColumn("non_negotiable", F.col("item_id") == 3)
    return R.company_cards(t.companies(), t.runs(), results).select(
        "company_id", "ticker", "run_id", "status", "green", "red", "neutral", "na", "answered", "total", "gate_pass"
    )


@query("company_cards", with_ctes("SELECT * FROM cards", "companies", "runs", "results", **_CARD_CTES))
def company_cards(t: Tables) -> DataFrame:
    return cards(t)


@query(
    "visible_cards",
    with_ctes("SELECT company_id, run_id, answered FROM cards WHERE status = 'DONE' AND answered > CASE WHEN ticker IS NULL THEN 0 ELSE 1 END", "companies", "runs", "results", **_CARD_CTES),
)
def visible_cards(t: Tables) -> DataFrame:
    return R.visible_cards(cards(t), listed_over=1, unlisted_over=0).select("company_id", "run_id", "answered")


@query(
    "flag_share",
    with_ctes(
        "SELECT company_id, " + ", ".join(f"{n} / greatest(total, 1) AS {n}_share" for n in ("green", "red", "neutral", "na"))
        + ", CASE WHEN total > 0 THEN CAST(CAST(floor(answered / total * 100.0e0 + 0.5) AS BIGINT) AS VARCHAR) || '%' ELSE '—' END AS answered_pct FROM cards",
        "companies", "runs", "results", **_CARD_CTES,
    ),
)
def flag_share(t: Tables) -> DataFrame:
    return R.flag_share(cards(t), ["company_id"])


_STATUS7 = "CASE CAST(run_id % 8 AS INT) " + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(fixed.RUN_STATUSES)) + " ELSE 'PROCESSING' END"
_WORK = "floor(15.0e0 + least(1.0e0, done_items / 7.0e0) * 68.0e0 + least(1.0e0, least(answered, done_items) / 7.0e0) * 15.0e0 + 0.5)"


@query(
    "run_progress",
    with_ctes(
        f"SELECT run_id, done_items, answered, CAST(CASE status WHEN 'QUEUED' THEN 4 WHEN 'HARVESTING' THEN 10 WHEN 'HARVESTED' THEN 15 WHEN 'PROCESSING' THEN least(98, {_WORK}) "
        f"WHEN 'PARTIAL' THEN greatest(15, least(98, {_WORK})) ELSE 100 END AS BIGINT) AS percent, CASE status WHEN 'QUEUED' THEN 'queued' WHEN 'HARVESTING' THEN 'harvesting' "
        "WHEN 'HARVESTED' THEN 'harvesting' ELSE lower(status) END AS phase, status = 'DONE' OR (status = 'PARTIAL' AND done_items > 0) AS ready, "
        "status IN ('PARTIAL', 'DONE', 'ERROR') AS done FROM p",
        "runs", "results",
        p=(
            f"SELECT r.run_id, {_STATUS7.replace('run_id', 'r.run_id')} AS status, count(x.item_id) FILTER (x.{_DONE}) AS done_items, "
            f"count(x.item_id) FILTER (x.{_DONE} AND x.flag IN ('GREEN', 'RED', 'NEUTRAL')) AS answered FROM runs r LEFT JOIN results x ON x.run_id = r.run_id GROUP BY 1, 2"
        ),
    ),
)
def run_progress(t: Tables) -> DataFrame:
    runs = t.runs().select("run_id").withColumn("status", F.expr(_STATUS7))
    counted = R.progress_counts(runs, t.results())
    return R.with_progress(counted, F.lit(7)).drop("status")


@query("report_nested")
def report_nested(t: Tables) -> DataFrame:
    from flagstone.operators.state import Checklist, Item

    order = Checklist(tuple(Item(i, "S") for i in _IDS))
    runs = S.runs_with_items(t.runs().select("run_id", "company_id"), ITEMS, t.results(), ["status", "flag", "doc_id"])
    raw = F.transform("items", lambda item: F.struct(*[v.alias(k) for k, v in _raw_item(lambda c: F.col(c) if c == "run_id" else item[c]).items()]))
    return R.nested_report_by_run(R.report_items_by_run(runs.withColumn("items", raw), ["item_id", "section_code"]), order)


@query(
    "member_breakdown",
    "SELECT l_orderkey AS group_id, count(*) AS members, max(n) AS most, count(*) FILTER (n > 30) AS over_limit, arg_max(name, coalesce(n, -1) * 1000000 + l_partkey) AS busiest FROM "
    "(SELECT l_orderkey, l_partkey, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS name, CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_quantity AS INT) END AS n FROM lineitem) GROUP BY 1",
)
def member_breakdown(t: Tables) -> DataFrame:
    members = t.raw("lineitem").selectExpr(
        "l_orderkey AS group_id", "LPAD(CAST(l_partkey AS STRING), 8, '0') AS name", "CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_quantity AS INT) END AS n"
    )
    return R.member_breakdown(members, limit=30)


@query(
    "member_table",
    "SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC NULLS LAST, name) AS position, name, coalesce(CAST(n AS VARCHAR), '—') AS shown, "
    "CASE WHEN n > 30 THEN 'Overboarded' ELSE 'OK' END AS status FROM "
    "(SELECT l_orderkey, lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS name, CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_quantity AS INT) END AS n FROM lineitem)",
)
def member_table(t: Tables) -> DataFrame:
    members = t.raw("lineitem").selectExpr(
        "l_orderkey AS group_id", "LPAD(CAST(l_partkey AS STRING), 8, '0') AS name", "CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_quantity AS INT) END AS n"
    )
    return R.member_table(members, limit=30)


@query(
    "coverage_gaps",
    "SELECT *, gaps || ' competency gap(s) — ' || skills || ' competencies identified, ' || (skills - gaps) || ' covered' AS value FROM "
    "(SELECT l_orderkey AS group_id, count(*) AS skills, count(*) FILTER (l_linenumber % 3 = 0) AS gaps FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1)",
)
def coverage_gaps(t: Tables) -> DataFrame:
    skills = t.raw("lineitem").selectExpr(
        "l_orderkey AS group_id", "CASE l_partkey % 5 WHEN 0 THEN ' \n' ELSE 'skill' END AS skill",
        "CASE l_linenumber % 3 WHEN 0 THEN false WHEN 1 THEN true END AS covered",
    )
    return R.coverage_gaps(skills)


@query(
    "share_pct",
    "SELECT l_orderkey, floor(count(*) FILTER (l_returnflag = 'A') / count(*) * 100.0e0 * 10.0e0 + 0.5) / 10.0e0 AS pct FROM lineitem GROUP BY 1",
)
def share_pct(t: Tables) -> DataFrame:
    from flagstone.functions.numbers import share_percent

    counts = t.raw("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count(F.lit(1)).alias("n"))
    return counts.select("l_orderkey", share_percent(F.col("a"), F.col("n")).alias("pct"))


@query(
    "age_label",
    "SELECT run_id, CASE WHEN s >= 86400 THEN CASE WHEN s // 86400 = 1 THEN '1 day ago' ELSE (s // 86400) || ' days ago' END WHEN s >= 3600 THEN CASE WHEN s // 3600 = 1 THEN '1 hour ago' ELSE (s // 3600) || ' hours ago' END "
    "WHEN s >= 60 THEN CASE WHEN s // 60 = 1 THEN '1 min ago' ELSE (s // 60) || ' min ago' END ELSE 'just now' END AS age FROM (SELECT o_orderkey AS run_id, greatest(0, date_diff('second', "
    "TIMESTAMP '2001-08-01 12:00:00' - CAST(o_orderkey * o_custkey % 200000 AS INT) * INTERVAL 1 SECOND, TIMESTAMP '2001-08-01 12:00:00')) AS s FROM orders)",
)
def age_label(t: Tables) -> DataFrame:
    at = F.expr("timestampadd(SECOND, -CAST(o_orderkey * o_custkey % 200000 AS INT), TIMESTAMP_NTZ '2001-08-01 12:00:00')")
    return t.raw("orders").select(F.col("o_orderkey").alias("run_id"), P.age_label(at, F.lit(NOW)).alias("age"))
