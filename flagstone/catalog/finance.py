"""Ratios, trends, size and statement building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.catalog.oracle import fixed2, number, rounded, with_ctes
from flagstone.catalog.registry import query
from flagstone.functions import numbers as N
from flagstone.functions import rules as R
from flagstone.operators import finance as fin
from flagstone.sources.bindings import Tables

_PCT = "floor(other_income / profit_before_tax * 1000.0e0 + 0.5) / 10.0e0"
METRIC_SQL = {
    "debt_to_equity": f"CASE WHEN equity_capital + reserves > 0 THEN {fixed2('borrowings / (equity_capital + reserves)')} END",
    "cash_to_profit": f"CASE WHEN profit_sum > 0 THEN {fixed2('cash_sum / profit_sum')} WHEN profit > 0 THEN {fixed2('cash / profit')} END",
    "cash_to_operating_profit": f"CASE WHEN operating_profit > 0 THEN {fixed2('cash / operating_profit')} END",
    "tax_rate": f"{number('tax_pct')} || '%'",
    "debtor_days": f"{number('days')} || ' days'",
    "cash_eps": f"CASE WHEN profit > 0 THEN {fixed2('(profit + depreciation) / profit')} END",
    "other_income_pct": (
        f"CASE WHEN profit_before_tax > 0 THEN {number(_PCT)} || '% of PBT (other income ₹' || "
        f"{rounded('other_income')} || 'cr ÷ PBT ₹' || {rounded('profit_before_tax')} || 'cr)' END"
    ),
    "free_float": f"{fixed2('100.0e0 - promoter_pct')} || '%'",
}


def _metric(key: str, name: str) -> None:
    @query(key, with_ctes(f"SELECT company_id, {METRIC_SQL[name]} AS value FROM metrics", "metrics"))
    def run(t: Tables, name: str = name) -> DataFrame:
        return fin.figures(t.statements()).select("company_id", fin.metric_texts()[name].alias("value"))


for _key, _name in [
    ("debt_to_equity", "debt_to_equity"), ("cfo_to_pat", "cash_to_profit"), ("cfo_to_ebitda", "cash_to_operating_profit"),
    ("tax_rate", "tax_rate"), ("debtor_days", "debtor_days"), ("cash_eps", "cash_eps"),
    ("other_income_pct", "other_income_pct"), ("free_float", "free_float"),
]:
    _metric(_key, _name)


@query("company_scale", with_ctes("SELECT * FROM scale", "scale"))
def company_scale(t: Tables) -> DataFrame:
    return fin.company_scale(t.statements())


@query("financial_cells", with_ctes("SELECT company_id, tbl, row_idx, label, period_idx, period, raw, num FROM cells", "cells"))
def financial_cells(t: Tables) -> DataFrame:
    return fin.cells_from_statements(t.statements()).drop("tbl_priority")


@query("cells_roundtrip", with_ctes("SELECT company_id, tbl, row_idx, label, period_idx, period, raw FROM cells", "cells"))
def cells_roundtrip(t: Tables) -> DataFrame:
    cells = fin.cells_from_statements(t.statements())
    again = fin.cells_from_statements(fin.statements_from_cells(cells))
    return again.drop("tbl_priority", "num")


@query("latest_value", with_ctes("SELECT company_id, tbl, label, latest_raw AS latest_text, latest AS latest_number FROM rows", "rows"))
def latest_value(t: Tables) -> DataFrame:
    return _rows(t).select(
        "company_id", "tbl", "label", N.latest_text(F.col("values")).alias("latest_text"),
        N.latest_number(F.col("values")).alias("latest_number"),
    )


def _rows(t: Tables) -> DataFrame:
    s = t.statements()
    tables = F.array(*[F.struct(F.lit(n).alias("tbl"), F.col(n).alias("t")) for n in fin.TABLES])
    return s.select("company_id", F.explode(tables).alias("x")).select(
        "company_id", "x.tbl", F.col("x.t.periods").alias("periods"), F.explode("x.t.rows").alias("r")
    ).select("company_id", "tbl", "periods", "r.label", "r.values")


@query("row_sum", with_ctes("SELECT company_id, tbl, label, total FROM rows", "rows"))
def row_sum(t: Tables) -> DataFrame:
    return _rows(t).select("company_id", "tbl", "label", N.sum_numbers(F.col("values")).alias("total"))


@query("series_ends", with_ctes("SELECT company_id, tbl, label, first, latest AS last FROM rows", "rows"))
def series_ends(t: Tables) -> DataFrame:
    v = F.col("values")
    return _rows(t).select("company_id", "tbl", "label", N.first_of(v).alias("first"), N.latest_number(v).alias("last"))


@query(
    "trend_label",
    with_ctes(
        "SELECT company_id, tbl, label, CASE WHEN latest > first + greatest(2.0e0, abs(first) * 0.02e0) THEN 'rising' "
        "WHEN latest < first - greatest(2.0e0, abs(first) * 0.02e0) THEN 'declining' ELSE 'stable' END AS trend FROM rows",
        "rows",
    ),
)
def trend_label(t: Tables) -> DataFrame:
    return _rows(t).select("company_id", "tbl", "label", N.trend_label(F.col("values")).alias("trend"))


@query(
    "series_compact",
    with_ctes(
        "SELECT company_id, tbl, label, array_to_string(list(period || ':' || raw ORDER BY yr)[-6:], ', ') AS compact "
        "FROM cells GROUP BY 1, 2, 3",
        "cells",
    ),
)
def series_compact(t: Tables) -> DataFrame:
    return _rows(t).select("company_id", "tbl", "label", N.compact_series(F.col("periods"), F.col("values")).alias("compact"))


@query(
    "first_matching_row",
    with_ctes(
        "SELECT company_id, array_to_string(list(raw ORDER BY yr), ', ') AS picked FROM cells c JOIN (SELECT company_id AS cid, "
        "min(tbl_priority * 100 + row_idx) AS first FROM cells WHERE regexp_matches(label, '(?i)profit') AND tbl_priority <= 4 "
        "GROUP BY 1) f ON f.cid = c.company_id AND f.first = c.tbl_priority * 100 + c.row_idx GROUP BY 1",
        "cells",
    ),
)
def first_matching_row(t: Tables) -> DataFrame:
    return t.statements().select(
        "company_id", F.array_join(fin.find_series("(?i)profit")["values"], ", ").alias("picked")
    )


@query(
    "dividend_consistency",
    with_ctes(
        "SELECT company_id, CASE WHEN list_min(payouts[-4:]) > 0 THEN 'GREEN' ELSE 'NEUTRAL' END AS flag, "
        "len(list_filter(payouts[-4:], lambda v: v > 0)) AS paid FROM metrics",
        "metrics",
    ),
)
def dividend_consistency(t: Tables) -> DataFrame:
    values = fin.find_series(fixed.ROW["dividend_payout"])["values"]
    paid = F.size(F.filter(F.slice(N.numbers_of(values), -4, 4), lambda v: v > 0)).cast("bigint")
    return t.statements().select("company_id", R.rule_dividend(values)["flag"].alias("flag"), paid.alias("paid"))


WC_SQL = (
    "CASE WHEN days <= 0 THEN 'GREEN' WHEN days_first <= 0 OR abs(days_first) < 15 THEN "
    "CASE WHEN floor(days - days_first + 0.5) <= 15 THEN 'GREEN' WHEN floor(days - days_first + 0.5) >= 45 THEN 'RED' ELSE 'NEUTRAL' END "
    "WHEN (days - days_first) / abs(days_first) * 100 <= 10 THEN 'GREEN' "
    "WHEN (days - days_first) / abs(days_first) * 100 >= 40 THEN 'RED' ELSE 'NEUTRAL' END"
)


@query("wc_trend", with_ctes(f"SELECT company_id, {WC_SQL} AS flag FROM metrics", "metrics"))
def wc_trend(t: Tables) -> DataFrame:
    values = fin.find_series(fixed.ROW["working_capital_days"])["values"]
    return t.statements().select("company_id", R.rule_working_capital(values)["flag"].alias("flag"))


# --- classification of the metrics -----------------------------------------------------------------------
CUSTOM_ITEMS = {
    "A8-10": "tax_rate", "A8-03": "debtor_days", "A8-11": "cash_eps", "A14-02": "debt_to_equity", "A8-05": "other_income_pct",
}


def custom_sql(item: str, n: str) -> str:
    bounds = fixed.CUSTOM_NUMERIC[item]
    green = " AND ".join(f"{n} {op} {v}" for op, v in bounds["green"])
    red = " OR ".join(f"{n} {op} {v}" for op, v in bounds["red"])
    return f"CASE WHEN {green} THEN 'GREEN' WHEN {red} THEN 'RED' ELSE 'NEUTRAL' END"


def _first_number_sql(text: str) -> str:
    return f"CAST(regexp_extract({text}, '-?\\d+(?:\\.\\d+)?') AS DOUBLE)"


@query(
    "custom_numeric",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT company_id, '{i}' AS item_id, {custom_sql(i, 'n')} AS flag FROM (SELECT company_id, "
            f"{_first_number_sql(METRIC_SQL[m])} AS n FROM metrics) WHERE n IS NOT NULL"
            for i, m in CUSTOM_ITEMS.items()
        ),
        "metrics",
    ),
)
def custom_numeric(t: Tables) -> DataFrame:
    texts = fin.metric_texts()
    pairs = F.array(
        *[F.struct(F.lit(i).alias("item_id"), N.first_number(texts[m]).alias("n")) for i, m in CUSTOM_ITEMS.items()]
    )
    rows = fin.figures(t.statements()).select("company_id", F.explode(pairs).alias("x")).select("company_id", "x.*")
    flag = F.lit(None).cast("string")
    for item, rule in R.NUMBER_RULES.items():
        if item in CUSTOM_ITEMS:
            flag = F.when(F.col("item_id") == item, rule(F.col("n"))["flag"]).otherwise(flag)
    return rows.filter(F.col("n").isNotNull()).select("company_id", "item_id", flag.alias("flag"))


BANDS = [("<0.05–0.1", ">0.3 / rising"), ("0% (or <0.2)", ">0.5"), ("≥0.2 covered; board 8–12", "<0.2 / bare minimum"), ("", ">0.4")]
_BAND_SQL = [
    ("v <= 0.1", "v > 0.3"), ("v < 0.2", "v > 0.5"), ("v >= 0.2", "v < 0.2"), ("false", "v > 0.4"),
]


@query(
    "band_classify",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT company_id, {i} AS band, CASE WHEN ({g}) AND NOT ({r}) THEN 'GREEN' WHEN ({r}) AND NOT ({g}) THEN 'RED' ELSE 'NEUTRAL' END AS flag FROM v"
            for i, (g, r) in enumerate(_BAND_SQL)
        ),
        "metrics", v=f"SELECT company_id, CAST({METRIC_SQL['debt_to_equity']} AS DOUBLE) AS v FROM metrics",
    ),
)
def band_classify(t: Tables) -> DataFrame:
    bands = F.array(
        *[F.struct(F.lit(i).alias("band"), F.lit(g).alias("green"), F.lit(r).alias("red")) for i, (g, r) in enumerate(BANDS)]
    )
    values = fin.figures(t.statements()).select("company_id", N.first_number(fin.debt_to_equity_text()).alias("v"))
    rows = values.select("company_id", "v", F.explode(bands).alias("b"))
    flag = R.classify_band(F.col("v"), F.col("b.green"), F.col("b.red"))["flag"]
    return rows.select("company_id", F.col("b.band").alias("band"), flag.alias("flag"))


@query(
    "debt_reconcile",
    with_ctes(
        "SELECT company_id, p_like, CASE WHEN p_like AND d < 1 THEN 'use_tier1' ELSE 'trust_doc' END AS decision FROM ("
        f"SELECT company_id, company_id % 2 = 0 AS p_like, CAST({METRIC_SQL['debt_to_equity']} AS DOUBLE) AS d FROM metrics)",
        "metrics",
    ),
)
def debt_reconcile(t: Tables) -> DataFrame:
    f = fin.figures(t.statements())
    high = F.col("company_id") % 2 == 0
    ratio = N.first_number(fin.debt_to_equity_text())
    return f.select("company_id", high.alias("p_like"), R.reconcile_debt(high, ratio).alias("decision"))


# --- statements in absolute money ------------------------------------------------------------------------
def _extracts(t: Tables) -> DataFrame:
    """Metric arrays of each company, in units that differ by company; one metric is missing for some."""
    unit = F.element_at(F.array(*map(F.lit, ["rupees", "lakhs", "crores", "unknown"])), (F.col("company_id") % 4 + 1).cast("int"))
    factor = F.element_at(F.array(F.lit(1e7), F.lit(100.0), F.lit(1.0), F.lit(1.0)), (F.col("company_id") % 4 + 1).cast("int"))
    s = t.statements().withColumn("factor", factor)
    small = F.lit(1e5)

    def series(table: str, key: str) -> F.Column:
        return F.transform(
            N.numbers_of(fin.row_values(F.col(table), fixed.ROW[key])),
            lambda v: F.floor(v / small * F.col("factor")).cast("double"),
        )

    gone = F.expr("cast(null as array<double>)")
    return s.select(
        "company_id", (F.col("company_id") % 10 != 9).alias("found"), unit.alias("unit"),
        F.col("profit_loss.periods").alias("periods"),
        series("profit_loss", "revenue").alias("revenue"), series("profit_loss", "other_income").alias("other_income"),
        series("profit_loss", "profit_before_tax").alias("profit_before_tax"), series("profit_loss", "profit").alias("profit_after_tax"),
        series("profit_loss", "depreciation").alias("depreciation"), gone.alias("finance_cost"),
        series("profit_loss", "tax_rate").alias("current_tax"), series("balance_sheet", "equity_capital").alias("share_capital"),
        F.when(F.col("company_id") % 3 != 0, series("balance_sheet", "reserves")).alias("reserves"),
        series("balance_sheet", "borrowings").alias("borrowings"), series("cash_flow", "cash_from_operations").alias("trade_receivables"),
        gone.alias("inventory"), gone.alias("cash_from_operations"), gone.alias("total_assets"),
    )


_EXTRACT_METRICS = {
    "revenue": "Sales", "other_income": "Other Income", "profit_before_tax": "Profit before tax", "profit_after_tax": "Net Profit",
    "depreciation": "Depreciation", "current_tax": "Tax %", "share_capital": "Equity Capital", "reserves": "Reserves",
    "borrowings": "Borrowings", "trade_receivables": "Cash from Operating Activity",
}
_EXTRACT_CTE = (
    "SELECT company_id, yr, period, CASE company_id % 4 WHEN 0 THEN 'rupees' WHEN 1 THEN 'lakhs' WHEN 2 THEN 'crores' ELSE 'unknown' END AS unit, "
    + ", ".join(
        f"max(CASE WHEN label = '{label}'{' AND company_id % 3 <> 0' if m == 'reserves' else ''} THEN "
        f"floor(num / 100000.0e0 * CASE company_id % 4 WHEN 0 THEN 1e7 WHEN 1 THEN 100.0e0 ELSE 1.0e0 END) END) AS {m}"
        for m, label in _EXTRACT_METRICS.items()
    )
    + " FROM cells WHERE company_id % 10 <> 9 GROUP BY 1, 2, 3, 4"
)
_LARGEST = "SELECT company_id, unit, max(greatest(" + ", ".join(f"coalesce({m}, 0)" for m in _EXTRACT_METRICS) + ")) AS largest FROM extracts GROUP BY 1, 2"
_DIVISOR = (
    "SELECT company_id, unit, largest, CASE WHEN largest >= 1e7 THEN 1e7 WHEN unit = 'crores' THEN 1.0e0 WHEN unit = 'lakhs' THEN 100.0e0 "
    "WHEN unit = 'rupees' THEN 1e7 WHEN largest >= 1e4 THEN 100.0e0 ELSE 1.0e0 END AS divisor FROM largest"
)


@query("max_abs", with_ctes("SELECT company_id, largest FROM largest", "cells", extracts=_EXTRACT_CTE, largest=_LARGEST))
def max_abs(t: Tables) -> DataFrame:
    return _extracts(t).filter("found").select("company_id", fin.max_abs().alias("largest"))


@query("unit_divisor", with_ctes("SELECT company_id, divisor FROM divisors", "cells", extracts=_EXTRACT_CTE, largest=_LARGEST, divisors=_DIVISOR))
def unit_divisor(t: Tables) -> DataFrame:
    return _extracts(t).filter("found").select("company_id", fin.crore_divisor(fin.max_abs(), F.col("unit")).alias("divisor"))


@query(
    "series_combine",
    with_ctes(
        "SELECT c.company_id, n, i, CASE WHEN profit_before_tax > 0 THEN floor(current_tax / profit_before_tax * 1000.0e0 + 0.5) / 10.0e0 END AS tax_pct "
        "FROM (SELECT company_id, n, unnest(range(0, n)) AS i FROM (SELECT DISTINCT company_id FROM extracts), (VALUES (5), (9)) v(n)) c "
        "LEFT JOIN extracts e ON e.company_id = c.company_id AND e.yr - 1995 = c.i",
        "cells", extracts=_EXTRACT_CTE,
    ),
)
def series_combine(t: Tables) -> DataFrame:
    """Cut to five of the seven periods, and padded to nine."""
    share = lambda a, b: F.when(b > 0, F.floor(a / b * 1000.0 + 0.5).cast("double") / 10.0)
    each = _extracts(t).filter("found").select("company_id", "current_tax", "profit_before_tax", F.explode(F.array(F.lit(5), F.lit(9))).alias("n"))
    pct = N.combine(N.align(F.col("current_tax"), F.col("n")), N.align(F.col("profit_before_tax"), F.col("n")), share)
    return each.select("company_id", "n", F.posexplode(pct).alias("i", "tax_pct"))


_SHOWN = {
    ("profit_loss", "Sales"): "revenue / divisor", ("profit_loss", "Other Income"): "other_income / divisor",
    ("profit_loss", "Profit before tax"): "profit_before_tax / divisor",
    ("profit_loss", "Operating Profit"): "(profit_before_tax + 0.0e0 + depreciation) / divisor",
    ("profit_loss", "Depreciation"): "depreciation / divisor", ("profit_loss", "Net Profit"): "profit_after_tax / divisor",
    ("balance_sheet", "Borrowings"): "borrowings / divisor", ("balance_sheet", "Equity Capital"): "share_capital / divisor",
    ("balance_sheet", "Reserves"): "reserves / divisor", ("balance_sheet", "Trade Receivables"): "trade_receivables / divisor",
}
_BUILD = " UNION ALL ".join(
    [
        f"SELECT company_id, '{tbl}' AS tbl, '{label}' AS label, period, floor(({e}) * 100.0e0 + 0.5) / 100.0e0 AS num FROM x"
        + (" WHERE company_id % 3 <> 0" if label == "Reserves" else "")
        for (tbl, label), e in _SHOWN.items()
    ]
    + [
        "SELECT company_id, 'profit_loss', 'Tax %', period, CASE WHEN profit_before_tax > 0 THEN floor(current_tax / profit_before_tax * 1000.0e0 + 0.5) / 10.0e0 END FROM x",
        "SELECT company_id, 'ratios_table', 'Debtor Days', period, CASE WHEN revenue > 0 THEN floor(trade_receivables / revenue * 365.0e0 + 0.5) END FROM x",
    ]
)


@query(
    "statement_build",
    with_ctes(
        _BUILD, "cells", extracts=_EXTRACT_CTE, largest=_LARGEST, divisors=_DIVISOR,
        x="SELECT e.*, d.divisor FROM extracts e JOIN divisors d ON d.company_id = e.company_id",
    ),
)
def statement_build(t: Tables) -> DataFrame:
    cells = fin.cells_from_statements(fin.build_statements(_extracts(t)))
    return cells.select("company_id", "tbl", "label", "period", "num")


@query(
    "statement_ratio",
    with_ctes(
        "SELECT company_id, CASE WHEN share_capital + coalesce(reserves, 0) > 0 THEN floor(borrowings / "
        "(share_capital + coalesce(reserves, 0)) * 100.0e0 + 0.5) / 100.0e0 END AS ratio "
        "FROM extracts WHERE yr = 2001",
        "cells", extracts=_EXTRACT_CTE,
    ),
)
def statement_ratio(t: Tables) -> DataFrame:
    s = fin.build_statements(_extracts(t))
    return s.select("company_id", N.parse_number(F.try_element_at(F.col("ratios"), F.lit("Debt to equity"))).alias("ratio"))
