"""Common table expressions for the oracle SQL, written from the same binding expressions."""

from __future__ import annotations

from flagstone.sources import bindings as B


def _select(columns: list[str], table: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {table}"


_order = ", ".join(f"{c} DESC" for c in B.WRITE_ORDER)
_items = ", ".join(
    f"({i.id}, '{i.section_code}', {str(i.non_negotiable).lower()}, '{i.item}')" for i in B.ITEMS.items
)
_cells = " UNION ALL ".join(
    f"SELECT company_id, '{table}' AS tbl, {priority} AS tbl_priority, {row} AS row_idx, '{label}' AS label, "
    f"yr, {B.money_text(figure)} AS raw FROM figs"
    for priority, (table, rows) in enumerate(B.STATEMENT_ROWS.items(), start=1)
    for row, (label, figure) in enumerate(rows)
)

CTES = {
    "companies": (_select(B.COMPANY, "supplier"), []),
    "runs": (_select(B.RUN, "orders"), []),
    "log": (_select(B.RESULT_LOG, "lineitem"), []),
    "results": (
        "SELECT run_id, item_id, flag, status, doc_id, attempts FROM (SELECT *, row_number() OVER (PARTITION BY "
        f"run_id, item_id ORDER BY {_order}) AS rn, count(*) OVER (PARTITION BY run_id, item_id) AS attempts FROM log) "
        "WHERE rn = 1",
        ["log"],
    ),
    "items": (f"SELECT * FROM (VALUES {_items}) AS t(item_id, section_code, non_negotiable, item)", []),
    "state": (
        "SELECT r.run_id, r.company_id, i.item_id, i.section_code, i.non_negotiable, "
        "coalesce(x.status, 'PENDING') AS status, x.flag, x.doc_id FROM runs r CROSS JOIN items i "
        "LEFT JOIN results x ON x.run_id = r.run_id AND x.item_id = i.item_id",
        ["runs", "items", "results"],
    ),
    "calls": (_select(B.CALL, "events"), []),
    "docs": (_select(B.DOCUMENT, "documents"), []),
    "findings": (_select(B.finding_columns(), "lineitem"), []),
    "fy": (
        "SELECT l_suppkey AS company_id, year(l_shipdate) AS yr, "
        + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in B.YEARLY.items())
        + " FROM lineitem GROUP BY 1, 2",
        [],
    ),
    "cents": (
        "SELECT company_id, yr, "
        + ", ".join(f"{e} AS {n}" for n, e in B.CENTS.items())
        + " FROM fy JOIN supplier ON s_suppkey = company_id",
        ["fy"],
    ),
    "figs": (
        "SELECT *, CAST(sum(net_profit) OVER (PARTITION BY company_id ORDER BY yr ROWS UNBOUNDED PRECEDING) AS BIGINT) "
        "AS reserves FROM cents",
        ["cents"],
    ),
    "cells": (
        "SELECT *, CAST(raw AS DOUBLE) AS num, 'FY' || CAST(yr AS STRING) AS period, "
        "row_number() OVER (PARTITION BY company_id, tbl, row_idx ORDER BY yr) - 1 AS period_idx "
        f"FROM ({_cells})",
        ["figs"],
    ),
    # latest and summed figures of each statement row, sums taken in period order
    "rows": (
        "SELECT company_id, tbl, label, arg_max(num, yr) AS latest, arg_max(raw, yr) AS latest_raw, "
        "arg_min(num, yr) AS first, list_reduce(list(num ORDER BY yr), lambda a, b: a + b) AS total, "
        "list(num ORDER BY yr) AS nums FROM cells GROUP BY 1, 2, 3",
        ["cells"],
    ),
    "metrics": (
        "SELECT company_id, "
        + ", ".join(
            f"max(CASE WHEN label = '{label}' THEN {value} END) AS {name}"
            for name, label, value in [
                ("borrowings", "Borrowings", "latest"), ("equity_capital", "Equity Capital", "latest"),
                ("reserves", "Reserves", "latest"), ("profit", "Net Profit", "latest"),
                ("profit_sum", "Net Profit", "total"), ("cash", "Cash from Operating Activity", "latest"),
                ("cash_sum", "Cash from Operating Activity", "total"),
                ("operating_profit", "Operating Profit", "latest"), ("depreciation", "Depreciation", "latest"),
                ("other_income", "Other Income", "latest"), ("profit_before_tax", "Profit before tax", "latest"),
                ("tax_pct", "Tax %", "latest"), ("days", "Debtor Days", "latest"), ("days_first", "Working Capital Days", "first"),
                ("promoter_pct", "Promoters", "latest"), ("revenue", "Sales", "latest"),
            ]
        )
        + ", max(CASE WHEN label = 'Dividend Payout %' THEN nums END) AS payouts FROM rows GROUP BY 1",
        ["rows"],
    ),
    "scale": (
        "SELECT company_id, CASE WHEN equity_capital + reserves > 0 THEN equity_capital + reserves END AS net_worth, "
        "revenue, profit FROM metrics",
        ["metrics"],
    ),
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """The query body behind the named expressions and everything they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for n in CTES[name][1]:
                need(n)
            ordered.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in ordered] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


# --- shared snippets --------------------------------------------------------------------------------------
def rounded(value: str) -> str:
    return f"CAST(floor(({value}) + 0.5) AS BIGINT)"


def fixed2(value: str) -> str:
    """Two decimals of a non-negative number."""
    c = f"CAST(floor(({value}) * 100.0e0 + 0.5) AS BIGINT)"
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def number(value: str) -> str:
    """A number as plain text without trailing zeros."""
    return (
        f"(CASE WHEN ({value}) = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({value} AS VARCHAR) END)"
    )


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{quoted(pattern)}')"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def states_nil(text: str) -> str:
    from flagstone import fixed

    low = f"lower(coalesce({text}, ''))"
    some = " OR ".join(
        matches(low, p) for p in (fixed.NIL_WORD, fixed.NO_EXPOSURE, fixed.ZERO_EXPOSURE, fixed.ZERO_AMOUNT)
    )
    return f"({low} <> '' AND NOT {matches(low, fixed.DATA_GAP)} AND ({some}))"


def max_amount(text: str) -> str:
    return (
        "list_max(list_transform(regexp_extract_all("
        f"{text}, '(?i)(\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:crore|cr\\b)', 1), lambda f: TRY_CAST(replace(f, ',', '') AS DOUBLE)))"
    )


def first_number(text: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(replace({text}, ',', ''), '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE)"


def na(value: str) -> str:
    return f"({value} IS NULL OR {value} = '' OR lower(trim({value})) = 'not available')"
