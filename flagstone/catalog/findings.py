"""Findings to flags: predicates, text rules, materiality, guards, opinions, dispatch and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.catalog.oracle import first_number, matches, max_amount, na, states_nil, with_ctes
from flagstone.catalog.registry import query
from flagstone.functions import numbers as N
from flagstone.functions import predicates as P
from flagstone.functions import rules as R
from flagstone.operators import classify as C
from flagstone.operators import finance as fin
from flagstone.sources.bindings import Tables

LINE = ["run_id", "line_no", "part_id"]
_LINE = ", ".join(LINE)


def _over_findings(select: str) -> str:
    return with_ctes(f"SELECT {_LINE}, {select} FROM findings", "findings")


# --- predicates and parsers over findings -----------------------------------------------------------------
@query("max_amount", _over_findings(f"{max_amount('amount')} AS amount_crore"))
def max_amount_query(t: Tables) -> DataFrame:
    return t.findings().select(*LINE, N.max_amount_crore(F.col("amount")).alias("amount_crore"))


@query("states_nil", _over_findings(f"{states_nil('amount')} AS nil, {states_nil('goodwill')} AS goodwill_nil"))
def states_nil_query(t: Tables) -> DataFrame:
    return t.findings().select(
        *LINE, P.states_nil(F.col("amount")).alias("nil"), P.states_nil(F.col("goodwill")).alias("goodwill_nil")
    )


_ABSENT = f"(trim(lower(absence)) = '' OR {matches('lower(absence)', fixed.ABSENCE)})"


@query("absence_finding", _over_findings(f"{_ABSENT} AS absent"))
def absence_finding(t: Tables) -> DataFrame:
    return t.findings().select(*LINE, P.is_absence(F.col("absence")).alias("absent"))


_VALUE_CASE = (
    "CASE CAST((part_id + line_no) % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Not Available ' "
    "WHEN 3 THEN 'not available' ELSE amount END"
)


@query("na_predicate", _over_findings(f"{na('(' + _VALUE_CASE + ')')} AS missing"))
def na_predicate(t: Tables) -> DataFrame:
    return t.findings().select(*LINE, P.is_na(F.expr(_VALUE_CASE)).alias("missing"))


def _ratio_sql(text: str) -> str:
    a = f"TRY_CAST(nullif(regexp_extract({text}, '(?i)(\\d+)\\s*(?:of|out of|/)\\s*(\\d+)', 1), '') AS DOUBLE)"
    b = f"TRY_CAST(nullif(regexp_extract({text}, '(?i)(\\d+)\\s*(?:of|out of|/)\\s*(\\d+)', 2), '') AS DOUBLE)"
    p = f"TRY_CAST(nullif(regexp_extract({text}, '(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE)"
    return f"CASE WHEN {b} > 0 AND {a} <= {b} THEN {a} / {b} WHEN {p} BETWEEN 0 AND 100 THEN {p} / 100 END"


def _meetings_sql(text: str) -> str:
    return (
        f"coalesce(TRY_CAST(nullif(regexp_extract({text}, '(?i)met\\s+(\\d+)\\s+times', 1), '') AS INT), "
        f"TRY_CAST(nullif(regexp_extract({text}, '(?i)(\\d+)\\s+meetings?', 1), '') AS INT))"
    )


@query("ratio_parse", _over_findings(f"{_ratio_sql('committee')} AS ratio, {_meetings_sql('committee')} AS meetings"))
def ratio_parse(t: Tables) -> DataFrame:
    text = F.col("committee")
    return t.findings().select(*LINE, N.parse_ratio(text).alias("ratio"), N.parse_meetings(text).alias("meetings"))


# --- text rules -------------------------------------------------------------------------------------------
def _both(column: str, evidence: str = "evidence") -> str:
    return f"lower({column} || ' ' || coalesce({evidence}, ''))"


_C = _both("committee")
_E = _both("cheap_equity")
_O = _both("opinion")
_S = _both("separation")
_G, _GEV = "lower(evidence || ' ' || goodwill)", "lower(goodwill)"
RULE_SQL = {
    "committee": (
        f"CASE WHEN {_ratio_sql(_C)} IS NULL THEN 'NEUTRAL' WHEN {_ratio_sql(_C)} < 0.5 THEN 'RED' "
        f"WHEN {_meetings_sql(_C)} < 4 THEN 'RED' WHEN {_ratio_sql(_C)} >= 2.0e0 / 3 THEN 'GREEN' ELSE 'NEUTRAL' END"
    ),
    "cheap_equity": (
        f"CASE WHEN {matches(_E, fixed.CHEAP_CLEAN)} OR {matches(_E, fixed.CHEAP_DENIED_BEFORE)} OR "
        f"{matches(_E, fixed.CHEAP_DENIED_AFTER)} OR {states_nil(_E)} THEN 'GREEN' "
        f"WHEN {matches(_E, fixed.CHEAP_INSIDER)} AND {matches(_E, fixed.CHEAP_MENTION)} THEN 'RED' ELSE 'NEUTRAL' END"
    ),
    "opinion": (
        f"CASE WHEN {matches(_O, fixed.OPINION_MODIFIED)} OR ({_O} LIKE '%going concern%' AND {matches(_O, fixed.OPINION_DOUBT)} "
        f"AND NOT {matches(_O, fixed.OPINION_BOILERPLATE)}) THEN 'RED' WHEN {matches(_O, fixed.OPINION_CLEAN)} OR "
        f"{matches(_O, fixed.OPINION_CONTEXT)} THEN 'GREEN' ELSE 'NEUTRAL' END"
    ),
    "separation": (
        f"CASE WHEN {matches(_S, fixed.ROLES_COMBINED)} THEN 'RED' WHEN {matches(_S, fixed.ROLES_SPLIT)} THEN 'GREEN' ELSE 'NEUTRAL' END"
    ),
    # the goodwill sentence is the evidence here, the amount sentence the value
    "goodwill": (
        f"CASE WHEN {states_nil(_G)} OR {matches(_G, fixed.GOODWILL_NONE)} THEN 'GREEN' "
        f"WHEN {matches(_GEV, fixed.GOODWILL_PURCHASE)} AND NOT {matches(_GEV, fixed.GOODWILL_IMPAIRED)} AND NOT "
        f"{matches(_GEV, fixed.GOODWILL_WRITTEN_DOWN)} THEN 'GREEN' WHEN ({matches(_GEV, fixed.GOODWILL_IMPAIRED)} OR "
        f"{matches(_GEV, fixed.GOODWILL_WRITTEN_DOWN)}) AND {_GEV} LIKE '%goodwill%' THEN 'RED' ELSE 'NEUTRAL' END"
    ),
}


def _text_rule(key: str, column: str, rule) -> None:
    @query(key, _over_findings(f"{RULE_SQL[column]} AS flag"))
    def run(t: Tables) -> DataFrame:
        value, evidence = (F.col("evidence"), F.col("goodwill")) if column == "goodwill" else (F.col(column), F.col("evidence"))
        return t.findings().select(*LINE, rule(value, evidence)["flag"].alias("flag"))


for _key, _column, _rule in [
    ("rule_committee", "committee", R.rule_committee), ("rule_cheap_equity", "cheap_equity", R.rule_cheap_equity),
    ("rule_audit_opinion", "opinion", R.rule_audit_opinion), ("rule_separation", "separation", R.rule_separation),
    ("rule_goodwill", "goodwill", R.rule_goodwill),
]:
    _text_rule(_key, _column, _rule)


# --- materiality ------------------------------------------------------------------------------------------
AMOUNT_ITEMS = sorted(fixed.MATERIALITY)
_ITEM_CASE = (
    "CASE CAST((part_id + line_no) % " + str(len(AMOUNT_ITEMS)) + " AS INT) "
    + " ".join(f"WHEN {n} THEN '{i}'" for n, i in enumerate(AMOUNT_ITEMS)) + " END"
)
_GUARD_CASE = (
    "CASE CAST((part_id + line_no) % 4 AS INT) WHEN 0 THEN 'A7a-13' WHEN 1 THEN 'A5-05' WHEN 2 THEN 'A4-01' ELSE 'A7a-02' END"
)
_JUDGED_CASE = "CASE CAST(part_id % 3 AS INT) WHEN 0 THEN 'GREEN' ELSE 'RED' END"


def _limits(part: int) -> str:
    arms = " ".join(
        f"WHEN '{i}' THEN " + (f"'{r[0]}'" if part == 0 else f"{float(r[part])}e0") for i, r in fixed.MATERIALITY.items()
    )
    return f"CASE item_id {arms} END"


# the companies' money is not in crore; amounts are read against it divided by this
SCALE_DIVISOR = 1000.0
_SIZED = (
    "SELECT f.*, s.net_worth / 1000.0e0 AS net_worth, s.revenue / 1000.0e0 AS revenue, s.profit / 1000.0e0 AS profit, s.company_id AS sized FROM findings f "
    "LEFT JOIN scale s ON s.company_id = f.company_id AND s.company_id % 11 <> 0"
)
_AMOUNT = f"coalesce({max_amount('value')}, {max_amount('evidence')})"
_CEILING = (
    "CASE WHEN greatest(coalesce(revenue, 0), coalesce(net_worth, 0)) > 0 THEN greatest(coalesce(revenue, 0), coalesce(net_worth, 0)) "
    "ELSE coalesce(profit, 0) * 10 END"
)


def materiality_sql(item: str) -> dict[str, str]:
    """CTEs from `sized` (value, evidence, size columns) to `judged` with the materiality flag."""
    return {
        "amounts": f"SELECT *, {_AMOUNT} AS amount_cr, {_CEILING} AS ceiling, {item} AS item_id FROM sized_value",
        "judged": (
            f"SELECT *, CASE WHEN amount_cr IS NULL THEN CASE WHEN {states_nil('value')} OR {states_nil('evidence')} THEN 'GREEN' ELSE 'NEUTRAL' END "
            "WHEN sized IS NULL THEN 'NEUTRAL' WHEN ceiling > 0 AND amount_cr > ceiling * 1.5 THEN 'NEUTRAL' "
            f"WHEN coalesce(base, 0) <= 0 THEN 'NEUTRAL' WHEN amount_cr / base * 100 >= {_limits(2)} THEN 'RED' "
            f"WHEN amount_cr / base * 100 <= {_limits(1)} THEN 'GREEN' ELSE 'NEUTRAL' END AS flag FROM (SELECT *, "
            f"CASE {_limits(0)} WHEN 'net_worth' THEN net_worth ELSE revenue END AS base FROM amounts)"
        ),
    }


def sized_findings(t: Tables) -> DataFrame:
    """Findings with the size of their company; none for every eleventh company."""
    scale = fin.company_scale(t.statements()).filter(F.col("company_id") % 11 != 0)
    size = F.struct(
        (F.col("net_worth") / SCALE_DIVISOR).alias("net_worth"), (F.col("revenue") / SCALE_DIVISOR).alias("revenue"),
        (F.col("profit") / SCALE_DIVISOR).alias("profit"),
    )
    return t.findings().join(scale.select("company_id", size.alias("scale")), "company_id", "left")


@query(
    "materiality",
    with_ctes(
        f"SELECT {_LINE}, item_id, flag FROM judged", "findings", "scale", sized=_SIZED,
        sized_value="SELECT *, amount AS value FROM sized", **materiality_sql(_ITEM_CASE),
    ),
)
def materiality(t: Tables) -> DataFrame:
    rows = sized_findings(t).withColumns({"item_id": F.expr(_ITEM_CASE), "figure": R.amount_of(F.col("amount"), F.col("evidence"))})
    item = F.col("item_id")
    flag = R.classify_amount(
        F.col("figure"), F.col("amount"), F.col("evidence"), F.col("scale"), *[R.materiality_rule(item, p) for p in range(3)]
    )["flag"]
    return rows.select(*LINE, "item_id", flag.alias("flag"))


@query(
    "materiality_reason",
    with_ctes(
        f"SELECT {_LINE}, CASE WHEN amount_cr IS NULL THEN 0 WHEN sized IS NULL THEN 1 WHEN ceiling > 0 AND amount_cr > ceiling * 1.5 THEN 2 ELSE 3 END AS reason_kind "
        "FROM amounts", "findings", "scale", sized=_SIZED, sized_value="SELECT *, amount AS value FROM sized",
        amounts=materiality_sql(_ITEM_CASE)["amounts"],
    ),
)
def materiality_reason(t: Tables) -> DataFrame:
    rows = sized_findings(t).withColumns({"item_id": F.expr(_ITEM_CASE), "figure": R.amount_of(F.col("amount"), F.col("evidence"))})
    item = F.col("item_id")
    reason = R.classify_amount(
        F.col("figure"), F.col("amount"), F.col("evidence"), F.col("scale"), *[R.materiality_rule(item, p) for p in range(3)]
    )["reason"]
    kind = (
        F.when(reason.startswith("Nil /") | reason.startswith("No amount"), 0)
        .when(F.contains(reason, F.lit("company size is unavailable")), 1)
        .when(F.contains(reason, F.lit("implausibly large")), 2)
        .otherwise(3)
    )
    return rows.select(*LINE, kind.alias("reason_kind"))


_GUARD_SQL = (
    "CASE WHEN judged_flag = 'RED' AND item_id IN ('" + "', '".join(fixed.GUARDED_ITEMS) + "') AND amount_cr IS NOT NULL AND sized IS NOT NULL "
    "AND ((ceiling > 0 AND amount_cr > ceiling * 1.5) OR (net_worth > 0 AND amount_cr / net_worth * 100 < 10)) "
    "THEN 'NEUTRAL' ELSE judged_flag END"
)


@query(
    "materiality_guard",
    with_ctes(
        f"SELECT {_LINE}, item_id, {_GUARD_SQL} AS flag FROM (SELECT *, {_JUDGED_CASE} AS judged_flag FROM amounts)",
        "findings", "scale", sized=_SIZED, sized_value="SELECT *, amount AS value FROM sized",
        amounts=materiality_sql(_GUARD_CASE)["amounts"],
    ),
)
def materiality_guard(t: Tables) -> DataFrame:
    rows = sized_findings(t).withColumns(
        {"item_id": F.expr(_GUARD_CASE), "judged_flag": F.expr(_JUDGED_CASE), "figure": R.amount_of(F.col("amount"), F.col("evidence"))}
    )
    guard = R.guard_amount(F.col("item_id"), F.col("judged_flag"), F.col("figure"), F.col("scale"))
    return rows.select(*LINE, "item_id", F.coalesce(guard["flag"], F.col("judged_flag")).alias("flag"))


_INTEGRITY_CASE = "CASE CAST(line_no % 3 AS INT) WHEN 0 THEN 'A9-04' WHEN 1 THEN 'A13-01' ELSE 'A9-01' END"
_INTEGRITY_TEXT = "lower(absence || ' ' || coalesce(evidence, ''))"


@query(
    "absence_guard",
    with_ctes(
        f"SELECT {_LINE}, item_id, CASE WHEN judged_flag = 'GREEN' AND item_id IN ('A9-04', 'A13-01') AND (trim({_INTEGRITY_TEXT}) = '' OR "
        f"{matches(_INTEGRITY_TEXT, fixed.ABSENCE)}) THEN 'NEUTRAL' ELSE judged_flag END AS flag FROM "
        f"(SELECT *, {_JUDGED_CASE} AS judged_flag, {_INTEGRITY_CASE} AS item_id FROM findings)",
        "findings",
    ),
)
def absence_guard(t: Tables) -> DataFrame:
    rows = t.findings().withColumns({"item_id": F.expr(_INTEGRITY_CASE), "judged_flag": F.expr(_JUDGED_CASE)})
    guard = R.guard_absence(F.col("item_id"), F.col("judged_flag"), F.col("absence"), F.col("evidence"))
    return rows.select(*LINE, "item_id", F.coalesce(guard["flag"], F.col("judged_flag")).alias("flag"))


@query(
    "web_note",
    with_ctes(
        f"SELECT {_LINE}, opinion || CASE WHEN part_id % 3 <> 0 AND line_no % 2 = 0 THEN '{fixed.WEB_NOTE}' ELSE '' END AS reason FROM findings",
        "findings",
    ),
)
def web_note(t: Tables) -> DataFrame:
    flag, web = F.expr(_JUDGED_CASE), F.col("line_no") % 2 == 0
    return t.findings().select(*LINE, R.note_web(flag, F.col("opinion"), web).alias("reason"))


# --- opinions ---------------------------------------------------------------------------------------------
_OPINION = "SELECT doc_id, CASE WHEN quality = 0 THEN 'RED' ELSE 'GREEN' END AS first, CASE WHEN toxic = 1 THEN 'RED' ELSE 'GREEN' END AS second FROM labels"


def opinions_from_labels(t: Tables) -> DataFrame:
    """First and second opinion of each labelled document."""
    labels = t.raw("labels")
    pair = F.array(
        F.struct(F.lit(1).alias("seq"), F.when(F.col("quality") == 0, "RED").otherwise("GREEN").alias("flag"), F.lit("first reading").alias("reason"), F.lit("alpha").alias("provider")),
        F.struct(F.lit(2).alias("seq"), F.when(F.col("toxic") == 1, "RED").otherwise("GREEN").alias("flag"), F.lit("second reading").alias("reason"), F.lit("beta").alias("provider")),
    )
    return labels.select("doc_id", F.explode(pair).alias("o")).select("doc_id", "o.*")


@query(
    "cross_check",
    with_ctes(
        "SELECT d.doc_id, CASE WHEN d.judged = 'RED' AND o.second IS NOT NULL AND o.second <> 'RED' THEN 'NEUTRAL' ELSE d.judged END AS flag, "
        "d.judged = 'RED' AND (o.second IS NULL OR o.second <> 'RED') AS needs_review, "
        "CASE WHEN d.judged = 'RED' AND o.second IS NOT NULL THEN 'alpha+beta' ELSE 'alpha' END AS provider FROM "
        "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'RED' ELSE 'GREEN' END AS judged FROM documents) d LEFT JOIN opinions o ON o.doc_id = d.doc_id",
        opinions=_OPINION,
    ),
)
def cross_check(t: Tables) -> DataFrame:
    second = C.opinions_wide(opinions_from_labels(t), ["doc_id"]).select("doc_id", F.col("second").alias("checker"))
    judged = F.when(F.col("doc_id") % 2 == 0, "RED").otherwise("GREEN")
    base = t.raw("documents").select(
        "doc_id", F.struct(judged.alias("flag"), F.lit("first reading").alias("reason")).alias("base"), (judged == "RED").alias("checked")
    )
    return C.cross_check(base.join(second, "doc_id", "left"), F.lit("alpha")).select("doc_id", "flag", "needs_review", "provider")


# --- dispatch ---------------------------------------------------------------------------------------------
# (item, kind, finding column used as value, note mode, non-negotiable, green band, red band)
DISPATCH = [
    ("A2-01", "QUALITATIVE", "committee", False, True, None, None),
    ("A3-05", "QUALITATIVE", "cheap_equity", False, False, None, None),
    ("A4-05", "QUALITATIVE", "opinion", False, True, None, None),
    ("A7a-06", "NUMERIC", "amount", False, False, None, None),
    ("A6-05", "QUALITATIVE", "amount", False, False, None, None),
    ("A1-01", "NUMERIC", "committee", False, True, "≥50% independent", "<20%"),
    ("A1-06", "NUMERIC", "committee", True, False, "<3", ">7"),
    ("A9-04", "QUALITATIVE", "absence", False, True, None, None),
    ("A7a-13", "QUALITATIVE", "amount", False, False, None, None),
    ("A4-01", "QUALITATIVE", "opinion", False, False, None, None),
]
_D = len(DISPATCH)


def _dispatch_case(field: int, kind: str = "text") -> str:
    def arm(row):
        v = row[field]
        if kind == "column":
            return v
        if isinstance(v, bool):
            return str(v).lower()
        return "NULL" if v is None else "'" + v + "'"

    return "CASE CAST((part_id + run_id) % " + str(_D) + " AS INT) " + " ".join(f"WHEN {n} THEN {arm(r)}" for n, r in enumerate(DISPATCH)) + " END"


def dispatch_input(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Findings dressed as analyses of ten kinds of item, and opinions about some of them."""
    rows = sized_findings(t).selectExpr(
        "run_id", "line_no", "part_id", "scale", "evidence", f"{_dispatch_case(0)} AS item_id", f"{_dispatch_case(1)} AS kind",
        f"CASE WHEN part_id % 13 = 0 THEN 'not available' ELSE {_dispatch_case(2, 'column')} END AS value",
        f"{_dispatch_case(3)} AS note_mode", f"{_dispatch_case(4)} AS non_negotiable", f"CAST({_dispatch_case(5)} AS STRING) AS green_band",
        f"CAST({_dispatch_case(6)} AS STRING) AS red_band", "line_no % 2 = 0 AS from_web", "CAST(NULL AS ARRAY<STRING>) AS series",
    )
    opinions = opinions_from_labels(t).withColumnRenamed("doc_id", "part_id")
    return rows, opinions


def _dispatch_sql() -> str:
    num = first_number("value")
    text = "lower(value || ' ' || coalesce(evidence, ''))"
    rules = {
        "committee": RULE_SQL["committee"].replace("committee", "value"),
        "cheap": RULE_SQL["cheap_equity"].replace("cheap_equity", "value"),
        "opinion": RULE_SQL["opinion"].replace("lower(opinion ||", "lower(value ||"),
    }
    m = materiality_sql("item_id")
    custom = "CASE WHEN num < 100 THEN 'GREEN' WHEN num >= 200 THEN 'RED' ELSE 'NEUTRAL' END"
    band = "CASE WHEN num >= 50 AND NOT num < 20 THEN 'GREEN' WHEN num < 20 AND NOT num >= 50 THEN 'RED' ELSE 'NEUTRAL' END"
    guard = _GUARD_SQL.replace("judged_flag", "o1")
    fired = (
        f"CASE WHEN {na('value')} THEN 'not_available' WHEN item_id = 'A6-05' AND num IS NOT NULL THEN 'custom_numeric' "
        "WHEN item_id IN ('A2-01', 'A3-05', 'A4-05') THEN 'text' WHEN item_id = 'A7a-06' THEN 'materiality' "
        "WHEN kind = 'NUMERIC' AND NOT note_mode AND num IS NOT NULL THEN 'band' ELSE 'opinion' END"
    )
    ctes = {
        "sized": _SIZED,
        "sized_value": (
            f"SELECT run_id, line_no, part_id, evidence, net_worth, revenue, profit, sized, {_dispatch_case(0)} AS item_id, {_dispatch_case(1)} AS kind, "
            f"CASE WHEN part_id % 13 = 0 THEN 'not available' ELSE {_dispatch_case(2, 'column')} END AS value, {_dispatch_case(3)} AS note_mode, "
            f"{_dispatch_case(4)} AS non_negotiable FROM sized"
        ),
        "amounts": f"SELECT *, {_AMOUNT} AS amount_cr, {_CEILING} AS ceiling, {num} AS num FROM sized_value",
        "judged": m["judged"].replace(" AS flag FROM", " AS amount_flag FROM"),
        "fired": f"SELECT *, {fired} AS rule_fired FROM judged",
        "opinions": _OPINION,
        "o": (
            "SELECT f.*, o.first AS o1, o.second AS o2 FROM fired f LEFT JOIN opinions o ON o.doc_id = f.part_id"
        ),
        "g": (
            f"SELECT *, CASE WHEN o1 IS NULL THEN 'NEUTRAL' WHEN {guard} <> o1 THEN {guard} WHEN o1 = 'GREEN' AND item_id = 'A9-04' AND "
            f"(trim({text}) = '' OR {matches(text, fixed.ABSENCE)}) THEN 'NEUTRAL' ELSE o1 END AS guarded FROM o"
        ),
        "b": (
            "SELECT *, CASE rule_fired WHEN 'not_available' THEN 'NOT_AVAILABLE' WHEN 'custom_numeric' THEN " + custom + " WHEN 'text' THEN CASE item_id "
            f"WHEN 'A2-01' THEN {rules['committee']} WHEN 'A3-05' THEN {rules['cheap']} ELSE {rules['opinion']} END "
            f"WHEN 'materiality' THEN amount_flag WHEN 'band' THEN {band} ELSE guarded END AS base_flag FROM g"
        ),
        "c": (
            "SELECT *, base_flag = 'RED' AND rule_fired IN ('custom_numeric', 'band', 'opinion') AS checked, "
            "CASE WHEN rule_fired = 'opinion' THEN o2 ELSE o1 END AS checker FROM b"
        ),
        "r": "SELECT *, CASE WHEN checked AND checker <> 'RED' THEN 'NEUTRAL' ELSE base_flag END AS flag, checked AND coalesce(checker, '') <> 'RED' AS needs_review FROM c",
    }
    return with_ctes(
        "SELECT run_id, line_no, part_id, item_id, rule_fired, flag, needs_review, CASE WHEN non_negotiable AND flag IN ('GREEN', 'RED') THEN flag = 'GREEN' END AS gate_pass FROM r",
        "findings", "scale", **ctes,
    )


@query("assign_flag", _dispatch_sql())
def assign_flag(t: Tables) -> DataFrame:
    rows, opinions = dispatch_input(t)
    flagged = C.assign_flags(rows, opinions, ["part_id"])
    return flagged.select(*LINE, "item_id", "rule_fired", "flag", "needs_review", "gate_pass")


# --- verdicts ---------------------------------------------------------------------------------------------
_VERDICT_IN = {
    "flag": "CASE WHEN part_id % 9 = 0 THEN 'NOT_AVAILABLE' ELSE 'RED' END",
    "reason": "CASE CAST(part_id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'Figure is implausibly large - downgraded' WHEN 2 THEN opinion ELSE 'Rule says: ' || amount END",
    "rationale": "CASE CAST(line_no % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Reported: ' || opinion ELSE committee END",
    "kind": "CASE WHEN run_id % 2 = 0 THEN 'NUMERIC' ELSE 'QUALITATIVE' END",
    "expected": "part_id % 2 = 0",
}


def _verdict_sql() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in _VERDICT_IN.items())
    return with_ctes(
        f"SELECT {_LINE}, CASE WHEN flag = 'NOT_AVAILABLE' THEN CASE WHEN expected THEN '{fixed.EXPECTED_NA_VERDICT}' ELSE '{fixed.MISSING_VERDICT}' END "
        f"WHEN {matches('reason', fixed.DISTRUST)} THEN reason WHEN rationale <> '' THEN CASE WHEN reason <> '' AND NOT contains(lower(rationale), lower(reason)) "
        "THEN rationale || ' ' || reason ELSE rationale END WHEN kind = 'NUMERIC' OR value IN ('', 'not available') THEN CASE WHEN reason <> '' THEN reason ELSE value END "
        "WHEN reason <> '' AND NOT contains(reason, value) THEN value || ' — ' || reason ELSE value END AS verdict FROM "
        f"(SELECT {_LINE}, amount AS value, {cols} FROM findings)",
        "findings",
    )


@query("verdict_text", _verdict_sql())
def verdict_text(t: Tables) -> DataFrame:
    c = {n: F.expr(e) for n, e in _VERDICT_IN.items()}
    verdict = R.build_verdict(c["flag"], c["reason"], c["rationale"], F.col("amount"), c["kind"], c["expected"], fixed.VERDICT_CHARS)
    return t.findings().select(*LINE, verdict.alias("verdict"))


# --- item kinds -------------------------------------------------------------------------------------------
FORMATS = [
    "Percentage (%)", "Ratio", "₹ Crore", "Count", "Number", "D/E ratio", "1.2x multiple", "Text", "Categorical",
    "Yes / No", "Narrative", "", None, "Yes/No + count", "Days", "Something else",
]
_FORMAT_CASE = (
    f"CASE CAST(p_partkey % {len(FORMATS)} AS INT) "
    + " ".join(f"WHEN {n} THEN " + ("NULL" if f is None else f"'{f}'") for n, f in enumerate(FORMATS)) + " END"
)


def _hints(values: list[str]) -> str:
    return " OR ".join(f"contains(fmt, '{v}')" for v in values)


@query(
    "item_kind",
    f"SELECT p_partkey, CASE WHEN {_hints(fixed.QUALITATIVE_HINTS)} THEN 'QUALITATIVE' WHEN {_hints(fixed.NUMERIC_HINTS)} THEN 'NUMERIC' "
    f"ELSE 'QUALITATIVE' END AS kind FROM (SELECT p_partkey, lower(coalesce({_FORMAT_CASE}, '')) AS fmt FROM part)",
)
def item_kind(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", P.item_kind(F.expr(_FORMAT_CASE)).alias("kind"))


