"""The whole assessment over all companies, its rollup, a scoped and a resumed pass, and the repair pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone import strategies as ST
from flagstone.catalog.finance import METRIC_SQL, WC_SQL, custom_sql
from flagstone.catalog.findings import RULE_SQL
from flagstone.catalog.oracle import first_number, matches, max_amount, na, states_nil, with_ctes
from flagstone.catalog.pages import PAGE_DOCUMENTS_SQL
from flagstone.catalog.registry import query
from flagstone.operators import finance as fin
from flagstone.operators import report as RP
from flagstone.operators.state import Checklist, Item, items_with_results
from flagstone.plans import acquire, assess, repair
from flagstone.sources import pages as PG
from flagstone.sources.bindings import ITEMS, WRITE_ORDER, Tables, finding_columns

SCALE_DIVISOR = 1000.0

# an own short checklist: id, output format, green band, red band, non-negotiable
_ROWS = [
    ("A14-01", "Ratio", "<0.05–0.1", ">0.3 / rising", True), ("A14-02", "Text", None, None, False),
    ("A8-01", "Ratio", "≥0.8", "<0.6", True), ("A8-12", "Ratio", "≥0.7", "<0.4", False),
    ("A8-10", "Percentage", None, None, False), ("A8-03", "Days", None, None, False), ("A8-11", "Ratio", None, None, False),
    ("A8-05", "Percentage", None, None, False), ("A8-02", "Days", None, None, False), ("A10-01", "Text", None, None, False),
    ("A3-06", "Percentage", ">45%", "<25%", False), ("A3-02", "Percentage", "<5%", ">8%", True),
    ("A1-02", "Yes / No", None, None, True), ("A2-01", "Text", None, None, False), ("A3-05", "Text", None, None, False),
    ("A4-05", "Categorical", None, None, True), ("A8-06", "Text", None, None, False), ("A5-01", "₹ Crore", None, None, False),
    ("A7a-06", "₹ Crore", None, None, False), ("A7a-13", "Narrative", None, None, False), ("A9-04", "Narrative", None, None, True),
    ("A15-03", "Count", None, None, False), ("A6-04", "Percentage", "<30", ">70", False),
]
CHECKLIST = Checklist(
    tuple(
        Item(i, i.split("-")[0], f"Item {i}", n, nn, fmt, g, r)
        for n, (i, fmt, g, r, nn) in enumerate(_ROWS)
    ),
    tuple((s, f"Section {s}") for s in dict.fromkeys(r[0].split("-")[0] for r in _ROWS)),
)
# items answered by a sentence, with the sentence's column
TEXT_ITEMS = {
    "A1-02": "separation", "A2-01": "committee", "A3-05": "cheap_equity", "A4-05": "opinion", "A8-06": "goodwill",
    "A5-01": "amount", "A7a-06": "amount", "A7a-13": "amount", "A9-04": "absence", "A15-03": "committee", "A6-04": "committee",
}
_T = len(TEXT_ITEMS)
_TEXT_ID = f"CASE CAST((part_id + line_no) % {_T} AS INT) " + " ".join(f"WHEN {n} THEN '{i}'" for n, i in enumerate(TEXT_ITEMS)) + " END"
_TEXT_VALUE = f"CASE CAST((part_id + line_no) % {_T} AS INT) " + " ".join(f"WHEN {n} THEN {c}" for n, c in enumerate(TEXT_ITEMS.values())) + " END"
_TEXT_EVIDENCE = f"CASE CAST((part_id + line_no) % {_T} AS INT) WHEN {list(TEXT_ITEMS).index('A8-06')} THEN goodwill ELSE evidence END"
_PICK = [*finding_columns(), *WRITE_ORDER]
_DEFERRED = "part_id % 17 = 0"
_SOURCE = "CASE WHEN part_id % 4 = 0 THEN 'web' ELSE 'document' END"


def findings(t: Tables) -> DataFrame:
    """The newest sentence of each company and text item."""
    rows = t.spread("lineitem").selectExpr(*_PICK).selectExpr(
        "company_id AS run_id", f"{_TEXT_ID} AS item_id", f"{_TEXT_VALUE} AS value", f"{_TEXT_EVIDENCE} AS evidence",
        "CAST(NULL AS STRING) AS rationale", f"{_SOURCE} AS source", f"{_DEFERRED} AS deferred", *WRITE_ORDER,
    )
    payload = F.struct(*assess.FINDING_COLUMNS)
    return (
        rows.groupBy("run_id", "item_id").agg(F.max_by(payload, F.struct(*WRITE_ORDER)).alias("x")).select("run_id", "item_id", "x.*")
    )


def opinions(t: Tables) -> DataFrame:
    """Labels read as opinions: a document number is ten times the company plus the item's place."""
    ids = F.array(*[F.lit(i.id) for i in CHECKLIST.items])
    place = (F.col("doc_id") % 10).cast("int")
    # the ten items that opinions can touch
    touched = F.element_at(F.array(*map(F.lit, OPINION_ITEMS)), place + 1)
    pair = F.array(
        F.struct(F.lit(1).alias("seq"), F.when(F.col("quality") == 0, "RED").otherwise("GREEN").alias("flag"), F.lit("first reading").alias("reason"), F.lit("alpha").alias("provider")),
        F.struct(F.lit(2).alias("seq"), F.when(F.col("toxic") == 1, "RED").otherwise("GREEN").alias("flag"), F.lit("second reading").alias("reason"), F.lit("beta").alias("provider")),
    )
    return t.raw("labels").select(
        F.floor(F.col("doc_id") / 10).cast("bigint").alias("run_id"), touched.alias("item_id"), F.explode(pair).alias("o")
    ).filter(F.array_contains(ids, F.col("item_id"))).select("run_id", "item_id", "o.*")


OPINION_ITEMS = ["A14-01", "A14-02", "A8-01", "A8-11", "A8-05", "A7a-13", "A9-04", "A15-03", "A6-04", "A3-02"]


def runs(t: Tables) -> DataFrame:
    return t.companies().select(F.col("company_id").alias("run_id"), "company_id")


def assessed(t: Tables, **options) -> DataFrame:
    return assess.run_assessment(
        runs(t), t.companies(), CHECKLIST, t.statements(), findings(t), opinions(t), scale_divisor=SCALE_DIVISOR, **options
    )


# --- oracle -----------------------------------------------------------------------------------------------
def _series_value(label: str) -> str:
    return (
        f"(SELECT latest_raw || ' (' || CASE WHEN latest > first + greatest(2.0e0, abs(first) * 0.02e0) THEN 'rising' WHEN latest < first - greatest(2.0e0, abs(first) * 0.02e0) THEN 'declining' "
        f"ELSE 'stable' END || ')' FROM rows r WHERE r.company_id = c.company_id AND r.label = '{label}')"
    )


_METRIC_ITEMS = {i.id: ST.BY_ITEM[i.id].metric for i in CHECKLIST.items if i.id in ST.BY_ITEM and ST.BY_ITEM[i.id].metric}
_SERIES_LABELS = {"working_capital_days": "Working Capital Days", "dividend_payout": "Dividend Payout %", "pledged": "Pledged", "promoters": "Promoters"}


def _oracle_ctes() -> dict[str, str]:
    item_values = ", ".join(f"('{i.id}', '{i.section_code}', {str(i.non_negotiable).lower()})" for i in CHECKLIST.items)
    structured = " UNION ALL ".join(
        f"SELECT c.company_id AS run_id, '{i}' AS item_id, " + (_series_value(_SERIES_LABELS[m]) if m in _SERIES_LABELS else METRIC_SQL[m]) + " AS value FROM metrics c"
        for i, m in _METRIC_ITEMS.items()
    )
    text = "lower(value || ' ' || coalesce(evidence, ''))"
    rules = {
        "A2-01": RULE_SQL["committee"].replace("committee", "value"),
        "A3-05": RULE_SQL["cheap_equity"].replace("cheap_equity", "value"),
        "A4-05": RULE_SQL["opinion"].replace("lower(opinion ||", "lower(value ||"),
        "A1-02": RULE_SQL["separation"].replace("lower(separation ||", "lower(value ||"),
        "A8-06": RULE_SQL["goodwill"].replace("lower(evidence || ' ' || goodwill)", "lower(value || ' ' || coalesce(evidence, ''))").replace("lower(goodwill)", "lower(coalesce(evidence, ''))"),
    }
    bands = {"A14-01": ("num <= 0.1", "num > 0.3"), "A8-01": ("num >= 0.8", "num < 0.6"), "A8-12": ("num >= 0.7", "num < 0.4"), "A3-06": ("num > 45", "num < 25"),
             "A3-02": ("num < 5", "num > 8"), "A6-04": ("num < 30", "num > 70"), "A15-03": ("false", "false")}
    band = "CASE item_id " + " ".join(f"WHEN '{i}' THEN CASE WHEN {g} THEN 'GREEN' WHEN {r} THEN 'RED' ELSE 'NEUTRAL' END" for i, (g, r) in bands.items()) + " END"
    custom_items = [i.id for i in CHECKLIST.items if i.id in fixed.CUSTOM_NUMERIC]
    custom = "CASE item_id " + " ".join(f"WHEN '{i}' THEN {custom_sql(i, 'num')}" for i in custom_items) + " END"
    listed = "('" + "', '".join(fixed.LISTED_ONLY) + "')"
    amount = f"coalesce({max_amount('value')}, {max_amount('evidence')})"
    base = "CASE item_id WHEN 'A5-01' THEN revenue ELSE net_worth END"
    red, green = "CASE item_id WHEN 'A5-01' THEN 15 ELSE 25 END", "CASE item_id WHEN 'A5-01' THEN 5 ELSE 10 END"
    numeric = "('" + "', '".join(r[0] for r in _ROWS if r[1] in ("Ratio", "Percentage", "Days", "₹ Crore", "Count")) + "')"
    fired = (
        f"CASE WHEN gone THEN 'not_applicable' WHEN deferred THEN 'deferred' WHEN {na('value')} THEN 'not_available' WHEN item_id IN ('A8-02', 'A10-01') THEN 'series' "
        "WHEN item_id IN ('" + "', '".join(custom_items) + "') AND num IS NOT NULL THEN 'custom_numeric' WHEN item_id IN ('" + "', '".join(rules) + "') THEN 'text' "
        f"WHEN item_id IN ('A5-01', 'A7a-06') THEN 'materiality' WHEN item_id IN {numeric} AND num IS NOT NULL THEN 'band' ELSE 'opinion' END"
    )
    return {
        "picked": (
            f"SELECT company_id AS run_id, {_TEXT_ID} AS item_id, {_TEXT_VALUE} AS value, {_TEXT_EVIDENCE} AS evidence, {_DEFERRED} AS deferred, {_SOURCE} AS source FROM "
            f"(SELECT {', '.join(_PICK)} FROM lineitem) QUALIFY row_number() OVER (PARTITION BY company_id, {_TEXT_ID} ORDER BY " + ", ".join(f"{c} DESC" for c in WRITE_ORDER) + ") = 1"
        ),
        "its": f"SELECT * FROM (VALUES {item_values}) AS v(item_id, section_code, non_negotiable)",
        "structured": structured,
        "op": "SELECT doc_id // 10 AS run_id, [" + ", ".join(f"'{i}'" for i in OPINION_ITEMS) + "][doc_id % 10 + 1] AS item_id, CASE WHEN quality = 0 THEN 'RED' ELSE 'GREEN' END AS o1, CASE WHEN toxic = 1 THEN 'RED' ELSE 'GREEN' END AS o2 FROM labels",
        "cell": (
            f"SELECT c.company_id AS run_id, i.item_id, i.section_code, i.non_negotiable, c.ticker IS NULL AND i.item_id IN {listed} AS gone, coalesce(f.deferred, false) AND s.value IS NULL AS deferred, "
            "coalesce(s.value, f.value, 'not available') AS value, CASE WHEN s.value IS NULL THEN f.evidence ELSE '-' END AS evidence, z.net_worth / 1000.0e0 AS net_worth, z.revenue / 1000.0e0 AS revenue, "
            "z.company_id AS sized, o.o1, o.o2 FROM companies c CROSS JOIN its i LEFT JOIN picked f ON f.run_id = c.company_id AND f.item_id = i.item_id LEFT JOIN structured s ON s.run_id = c.company_id AND s.item_id = i.item_id "
            "LEFT JOIN scale z ON z.company_id = c.company_id LEFT JOIN op o ON o.run_id = c.company_id AND o.item_id = i.item_id"
        ),
        "num": f"SELECT *, {first_number('value')} AS num, {amount} AS amount_cr, greatest(coalesce(revenue, 0), coalesce(net_worth, 0)) * 1.5 AS ceiling, {base} AS base FROM cell",
        "fired": f"SELECT *, {fired} AS rule_fired FROM num",
        "mat": (
            f"SELECT f.*, CASE WHEN amount_cr IS NULL THEN CASE WHEN {states_nil('value')} OR {states_nil('evidence')} THEN 'GREEN' ELSE 'NEUTRAL' END WHEN sized IS NULL THEN 'NEUTRAL' "
            f"WHEN ceiling > 0 AND amount_cr > ceiling THEN 'NEUTRAL' WHEN coalesce(base, 0) <= 0 THEN 'NEUTRAL' WHEN amount_cr / base * 100 >= {red} THEN 'RED' WHEN amount_cr / base * 100 <= {green} THEN 'GREEN' "
            f"ELSE 'NEUTRAL' END AS amount_flag, CASE f.item_id WHEN 'A8-02' THEN {WC_SQL} ELSE CASE WHEN list_min(payouts[-4:]) > 0 THEN 'GREEN' ELSE 'NEUTRAL' END END AS series_flag "
            "FROM fired f LEFT JOIN (SELECT company_id AS mid, days, days_first, payouts FROM metrics) m ON m.mid = f.run_id"
        ),
        "judged": (
            "SELECT *, CASE WHEN o1 IS NULL THEN 'NEUTRAL' WHEN o1 = 'RED' AND item_id = 'A7a-13' AND amount_cr IS NOT NULL AND sized IS NOT NULL AND ((ceiling > 0 AND amount_cr > ceiling) OR "
            f"(net_worth > 0 AND amount_cr / net_worth * 100 < 10)) THEN 'NEUTRAL' WHEN o1 = 'GREEN' AND item_id = 'A9-04' AND (trim({text}) = '' OR {matches(text, fixed.ABSENCE)}) THEN 'NEUTRAL' ELSE o1 END AS judged FROM mat"
        ),
        "b": (
            f"SELECT *, CASE rule_fired WHEN 'not_applicable' THEN 'NOT_AVAILABLE' WHEN 'not_available' THEN 'NOT_AVAILABLE' WHEN 'deferred' THEN NULL WHEN 'series' THEN series_flag WHEN 'custom_numeric' THEN {custom} "
            "WHEN 'text' THEN CASE item_id " + " ".join(f"WHEN '{i}' THEN {s}" for i, s in rules.items()) + f" END WHEN 'materiality' THEN amount_flag WHEN 'band' THEN {band} ELSE judged END AS base_flag FROM judged"
        ),
        "c": "SELECT *, coalesce(base_flag = 'RED' AND rule_fired IN ('custom_numeric', 'band', 'opinion'), false) AS checked, CASE WHEN rule_fired = 'opinion' THEN o2 ELSE o1 END AS checker FROM b",
        "res": (
            "SELECT run_id, item_id, section_code, non_negotiable, rule_fired, CASE WHEN checked AND checker <> 'RED' THEN 'NEUTRAL' ELSE base_flag END AS flag, "
            "CASE WHEN rule_fired = 'deferred' THEN 'DEFERRED' WHEN checked AND coalesce(checker, '') <> 'RED' THEN 'NEEDS_REVIEW' ELSE 'DONE' END AS status FROM c"
        ),
    }


_ORACLE = _oracle_ctes()
_BASES = ("companies", "metrics", "rows", "scale")


def _oracle(select: str) -> str:
    return with_ctes(select, *_BASES, **_ORACLE)


@query("assessment", _oracle("SELECT run_id, item_id, rule_fired, status, flag, CASE WHEN non_negotiable AND flag IN ('GREEN', 'RED') THEN flag = 'GREEN' END AS gate_pass FROM res"))
def assessment(t: Tables) -> DataFrame:
    return assessed(t).select("run_id", "item_id", "rule_fired", "status", "flag", "gate_pass")


@query(
    "assessment_summary",
    _oracle(
        "SELECT run_id, count(*) AS items_total, " + ", ".join(f"count(*) FILTER (status <> 'DEFERRED' AND flag = '{f}') AS {f.lower()}" for f in fixed.FLAGS)
        + ", count(*) FILTER (status = 'DEFERRED') AS items_deferred, count(*) FILTER (flag = 'RED' AND non_negotiable) = 0 AS gate_pass, "
        "CASE WHEN count(*) FILTER (status = 'DEFERRED') = 0 THEN 'DONE' ELSE 'PARTIAL' END AS run_status FROM res GROUP BY 1"
    ),
)
def assessment_summary(t: Tables) -> DataFrame:
    return RP.summarize(assessed(t)).select(
        "run_id", "items_total", *[f.lower() for f in fixed.FLAGS], "items_deferred", "gate_pass", "run_status"
    )


@query("assessment_scoped", _oracle("SELECT run_id, item_id, flag FROM res WHERE section_code = 'A8' OR item_id = 'A4-05'"))
def assessment_scoped(t: Tables) -> DataFrame:
    return assessed(t, item_ids=["A4-05", ""], sections=["A8"]).select("run_id", "item_id", "flag")


@query("assessment_resumed", _oracle("SELECT run_id, item_id, flag FROM res WHERE (run_id + length(item_id)) % 3 <> 0"))
def assessment_resumed(t: Tables) -> DataFrame:
    stored = items_with_results(runs(t), CHECKLIST, _no_results(t), ["status"], []).withColumn(
        "status", F.when((F.col("run_id") + F.length("item_id")) % 3 == 0, "DONE").otherwise("DEFERRED")
    )
    return assessed(t, results=stored).select("run_id", "item_id", "flag")


def _no_results(t: Tables) -> DataFrame:
    return runs(t).selectExpr("run_id", "CAST(NULL AS STRING) AS item_id", "CAST(NULL AS STRING) AS status").filter("false")


@query(
    "structured_evidence",
    with_ctes(
        " UNION ALL ".join(f"SELECT company_id, '{m}' AS metric, {s} AS value FROM metrics WHERE {s} IS NOT NULL" for m, s in METRIC_SQL.items())
        + "".join(f" UNION ALL SELECT company_id, '{m}', {_series_value(label)} FROM metrics c" for m, label in _SERIES_LABELS.items()),
        "metrics", "rows",
    ),
)
def structured_evidence(t: Tables) -> DataFrame:
    return assess.structured_evidence(t.statements()).drop("evidence")


@query(
    "document_plan",
    "SELECT company_id AS run_id, link AS url, category, CASE category WHEN 'annual_report' THEN 'ANNUAL_REPORT' ELSE 'EARNINGS_PDF' END AS doc_type, label, "
    "CASE s WHEN 0 THEN NULL WHEN 3 THEN 'FAILED' ELSE 'OK' END AS fetch_status, CASE WHEN s > 0 THEN s = 1 END AS has_text, CASE WHEN s > 0 THEN false END AS is_copy, "
    "CASE s WHEN 0 THEN 'fetch' WHEN 1 THEN 'reuse' WHEN 2 THEN 'refetch_pruned' ELSE 'refetch_failed' END AS action FROM "
    f"(SELECT *, (company_id + length(link)) % 4 AS s FROM ({PAGE_DOCUMENTS_SQL}) WHERE label <> 'Annual report 3')",
)
def document_plan(t: Tables) -> DataFrame:
    """Against a store that holds three of four of the pages' links: fetched, pruned or failed."""
    some = F.pmod(F.col("company_id") + F.length("link"), F.lit(4))
    stored = PG.page_links(PG.structure_pages(t.company_pages())).filter(some > 0).select(
        F.col("company_id").alias("run_id"), F.col("link").alias("url"), F.when(some == 3, "FAILED").otherwise("OK").alias("fetch_status"),
        F.when(some == 1, "text").alias("text"), F.lit(None).cast("string").alias("note"),
    )
    return acquire.document_plan(t.company_pages(), stored)


_BLANK_IDS = {1: "A1-02", 2: "A4-05", 3: "A3-05", 4: "A2-01", 5: "A9-04", 6: "A7a-13", 7: "A5-01"}


@query("backfill_flags")
def backfill_flags(t: Tables) -> DataFrame:
    """Blank stored results answered from the newest sentence of the run's own lines."""
    state = items_with_results(t.runs().select("run_id", "company_id"), ITEMS, t.results())
    ids = F.element_at(F.array(*map(F.lit, _BLANK_IDS.values())), F.col("item_id"))
    none = F.lit(None).cast("string")
    blanks = state.withColumns(
        {
            "item_id": ids, "kind": F.lit("QUALITATIVE"), "note_mode": F.lit(False), "green_band": none, "red_band": none,
        }
    )
    answers = t.findings().groupBy("company_id").agg(
        F.max_by(F.struct("separation", "opinion", "cheap_equity", "committee", "absence", "amount"), F.struct("part_id", "run_id", "line_no")).alias("x")
    )
    each = F.array(
        *[
            F.struct(F.lit(i).alias("item_id"), F.col(f"x.{c}").alias("answer"))
            for i, c in zip(_BLANK_IDS.values(), ["separation", "opinion", "cheap_equity", "committee", "absence", "amount", "amount"])
        ]
    )
    answers = answers.select("company_id", F.explode(each).alias("y")).select("company_id", "y.*")
    return repair.backfill(blanks, answers, opinions(t), fin.company_scale(t.statements()))
