"""Ratios, trends and size from period tables.

A statement row is one company with its period tables as nested columns:

    company_id, ratios map<string,string>,
    profit_loss, balance_sheet, cash_flow, ratios_table, shareholding :
        struct<periods array<string>, rows array<struct<label string, values array<string>>>>

All metrics are expressions over that row. Nothing is shuffled, and "the first matching row, then
the last figure in it" needs no window. `statements_from_cells` brings the long form into this one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions import numbers as N

TABLE_TYPE = "struct<periods:array<string>,rows:array<struct<label:string,values:array<string>>>>"
TABLES = ["ratios_table", "profit_loss", "balance_sheet", "cash_flow", "shareholding"]


def row_values(table: Column, pattern: str) -> Column:
    """Values of the first row whose label matches; later matches never count."""
    hit = F.get(F.filter(table["rows"], lambda r: r["label"].rlike(pattern)), F.lit(0))
    return hit["values"]


def find_ratio(ratios: Column, ratios_table: Column, pattern: str) -> Column:
    """A stated headline ratio, else the latest entry of a matching ratios row."""
    stated = F.filter(
        F.map_entries(ratios), lambda e: e["key"].rlike(pattern) & (F.coalesce(e["value"], F.lit("")) != "")
    )
    return F.coalesce(F.get(stated, F.lit(0))["value"], N.latest_text(row_values(ratios_table, pattern)))


def find_series(pattern: str, tables: list[str] | None = None) -> Column:
    """struct<periods,values> of the first matching row over the tables in order."""
    found = []
    for t in tables or TABLES[:4]:
        values = row_values(F.col(t), pattern)
        found.append(
            F.when(values.isNotNull(), F.struct(F.col(t)["periods"].alias("periods"), values.alias("values")))
        )
    return F.coalesce(*found)


def holding_series(which: str) -> Column:
    """Promoter or pledged holding by period."""
    values = row_values(F.col("shareholding"), fixed.ROW[which])
    return F.when(
        values.isNotNull(),
        F.struct(F.col("shareholding")["periods"].alias("periods"), values.alias("values")),
    )


def _latest(table: str, key: str) -> Column:
    return N.latest_number(row_values(F.col(table), fixed.ROW[key]))


def figures(statements: DataFrame, *keep: str, drop_ttm: bool = False) -> DataFrame:
    """The raw figures every metric is made of, one column each, computed once."""
    pl, cf = F.col("profit_loss"), F.col("cash_flow")
    profit_row = row_values(pl, fixed.ROW["profit"])
    if drop_ttm:
        profit_row = F.filter(
            F.zip_with(pl["periods"], profit_row, lambda p, v: F.when(p != "TTM", v)),
            lambda v: v.isNotNull(),
        )
    cash_row = row_values(cf, fixed.ROW["cash_from_operations"])
    columns = {
        "stated_de": find_ratio(F.col("ratios"), F.col("ratios_table"), fixed.ROW["debt_to_equity"]),
        "borrowings": _latest("balance_sheet", "borrowings"),
        "equity_capital": _latest("balance_sheet", "equity_capital"),
        "reserves": _latest("balance_sheet", "reserves"),
        "profit": _latest("profit_loss", "profit"),
        "profit_sum": N.sum_numbers(profit_row),
        "cash": N.latest_number(cash_row),
        "cash_sum": N.sum_numbers(cash_row),
        "operating_profit": _latest("profit_loss", "operating_profit"),
        "depreciation": _latest("profit_loss", "depreciation"),
        "other_income": _latest("profit_loss", "other_income"),
        "profit_before_tax": _latest("profit_loss", "profit_before_tax"),
        "tax_pct": _latest("profit_loss", "tax_rate"),
        "days": _latest("ratios_table", "debtor_days"),
        "promoter_pct": N.parse_number(N.latest_text(holding_series("promoters")["values"])),
        "revenue": _latest("profit_loss", "revenue"),
    }
    return statements.select("company_id", *keep, *[c.alias(n) for n, c in columns.items()])


# --- metrics over `figures` ---------------------------------------------------------------------------
def debt_to_equity() -> Column:
    """Borrowings over capital and reserves; null without positive equity."""
    equity = F.col("equity_capital") + F.col("reserves")
    return F.when(equity > 0, F.col("borrowings") / equity)


def debt_to_equity_text() -> Column:
    return F.coalesce(F.col("stated_de"), N.fixed_text(debt_to_equity(), 2))


def cash_to_profit() -> Column:
    """Cumulative when both sums exist and profit is positive, else the latest year."""
    cumulative = F.col("cash_sum").isNotNull() & F.coalesce(F.col("profit_sum") > 0, F.lit(False))
    return F.when(cumulative, F.col("cash_sum") / F.col("profit_sum")).when(
        F.col("profit") > 0, F.col("cash") / F.col("profit")
    )


def cash_to_operating_profit() -> Column:
    return F.when(F.col("operating_profit") > 0, F.col("cash") / F.col("operating_profit"))


def cash_eps_ratio() -> Column:
    return F.when(F.col("profit") > 0, (F.col("profit") + F.col("depreciation")) / F.col("profit"))


def other_income_pct() -> Column:
    share = F.col("other_income") / F.col("profit_before_tax") * F.lit(1000.0)
    return F.when(F.col("profit_before_tax") > 0, F.floor(share + 0.5).cast("double") / F.lit(10.0))


def free_float() -> Column:
    return F.lit(100.0) - F.col("promoter_pct")


def net_worth() -> Column:
    some = F.col("equity_capital").isNotNull() | F.col("reserves").isNotNull()
    total = F.coalesce(F.col("equity_capital"), F.lit(0.0)) + F.coalesce(F.col("reserves"), F.lit(0.0))
    return F.when(some & (total > 0), total)


def metric_texts() -> dict[str, Column]:
    """Displayed value of each computed metric."""
    crore = lambda c: N.whole(c).cast("string")
    return {
        "debt_to_equity": debt_to_equity_text(),
        "cash_to_profit": N.fixed_text(cash_to_profit(), 2),
        "cash_to_operating_profit": N.fixed_text(cash_to_operating_profit(), 2),
        "tax_rate": F.concat(N.number_text(F.col("tax_pct")), F.lit("%")),
        "debtor_days": F.concat(N.number_text(F.col("days")), F.lit(" days")),
        "cash_eps": N.fixed_text(cash_eps_ratio(), 2),
        "other_income_pct": F.concat(
            N.number_text(other_income_pct()), F.lit("% of PBT (other income ₹"), crore(F.col("other_income")),
            F.lit("cr ÷ PBT ₹"), crore(F.col("profit_before_tax")), F.lit("cr)"),
        ),
        "free_float": F.concat(N.fixed_text(free_float(), 2), F.lit("%")),
    }


def company_scale(statements: DataFrame) -> DataFrame:
    """Net worth, revenue and profit of each company."""
    return figures(statements).select("company_id", net_worth().alias("net_worth"), "revenue", "profit")


# --- long form -----------------------------------------------------------------------------------------
def statements_from_cells(cells: DataFrame) -> DataFrame:
    """Long cells (company_id, tbl, row_idx, label, period_idx, period, raw) to statement rows.

    A company's pages hold a few hundred cells, so its rows are gathered into arrays: one grouping
    by row, one by company; both keyed by company, which the first exchange already provides.
    """
    by_row = cells.groupBy("company_id", "tbl", "row_idx", "label").agg(
        F.array_sort(F.collect_list(F.struct("period_idx", "period", "raw"))).alias("cells")
    )
    by_company = by_row.groupBy("company_id").agg(
        F.array_sort(F.collect_list(F.struct("tbl", "row_idx", "label", "cells"))).alias("all_rows")
    )

    def table(name: str) -> Column:
        rows = F.filter(F.col("all_rows"), lambda r: r["tbl"] == name)
        return F.when(
            F.size(rows) > 0,
            F.struct(
                F.transform(F.get(rows, F.lit(0))["cells"], lambda c: c["period"]).alias("periods"),
                F.transform(
                    rows,
                    lambda r: F.struct(
                        r["label"].alias("label"),
                        F.transform(r["cells"], lambda c: c["raw"]).alias("values"),
                    ),
                ).alias("rows"),
            ),
        )

    return by_company.select(
        "company_id",
        F.expr("cast(map() as map<string,string>)").alias("ratios"),
        *[table(t).alias(t) for t in TABLES],
    )


def cells_from_statements(statements: DataFrame) -> DataFrame:
    """The long form of statement rows."""
    tables = F.array(
        *[F.struct(F.lit(t).alias("tbl"), F.lit(i + 1).alias("tbl_priority"), F.col(t).alias("t")) for i, t in enumerate(TABLES)]
    )
    rows = statements.select("company_id", F.explode(tables).alias("x")).select(
        "company_id", "x.tbl", "x.tbl_priority", F.col("x.t.periods").alias("periods"),
        F.posexplode("x.t.rows").alias("row_idx", "row"),
    )
    return rows.select(
        "company_id", "tbl", "tbl_priority", "row_idx", F.col("row.label").alias("label"),
        F.col("periods"), F.posexplode("row.values").alias("period_idx", "raw"),
    ).select(
        "company_id", "tbl", "tbl_priority", "row_idx", "label", "period_idx",
        F.get(F.col("periods"), F.col("period_idx")).alias("period"), "raw",
        N.parse_number(F.col("raw")).alias("num"),
    )


# --- statements in absolute money -----------------------------------------------------------------------
METRICS = [
    "revenue", "other_income", "profit_before_tax", "profit_after_tax", "depreciation", "finance_cost",
    "current_tax", "share_capital", "reserves", "borrowings", "trade_receivables", "inventory",
    "cash_from_operations", "total_assets",
]
CRORE, LAKHS_PER_CRORE = 1e7, 100.0


def max_abs(metrics: list[str] = METRICS) -> Column:
    """Largest magnitude over all metric arrays; zero when there is none."""
    sizes = [F.array_max(F.transform(F.col(m), lambda v: F.abs(v))) for m in metrics]
    return F.coalesce(F.greatest(*sizes), F.lit(0.0))


def crore_divisor(largest: Column, unit: Column) -> Column:
    """Magnitude decides first, then the stated unit, then magnitude again."""
    return (
        F.when(largest >= CRORE, CRORE)
        .when(unit == "crores", 1.0)
        .when(unit == "lakhs", LAKHS_PER_CRORE)
        .when(unit == "rupees", CRORE)
        .when(largest >= 1e4, LAKHS_PER_CRORE)
        .otherwise(1.0)
    )


def build_statements(extracts: DataFrame) -> DataFrame:
    """Statement rows in crore from extracted metric arrays; companies without any are left out."""
    n = F.size("periods")
    # asked of the input, before anything is derived: a filter on the finished tables would drag
    # their whole definition below every projection
    usable = F.lit(False)
    for m in METRICS:
        if m not in ("finance_cost", "current_tax", "total_assets"):
            usable = usable | F.coalesce(F.exists(F.slice(F.col(m), F.lit(1), n), lambda v: v.isNotNull()), F.lit(False))
    base = extracts.filter(F.col("found") & (n > 0) & usable).select(
        "company_id", "periods", crore_divisor(max_abs(), F.col("unit")).alias("divisor"),
        *[N.align(F.col(m), n).alias(m) for m in METRICS],
    )
    tax = N.combine(
        F.col("current_tax"), F.col("profit_before_tax"),
        lambda t, p: F.when(p > 0, F.floor(t / p * 1000.0 + 0.5).cast("double") / 10.0),
    )
    days = N.combine(
        F.col("trade_receivables"), F.col("revenue"),
        lambda r, s: F.when(s > 0, F.floor(r / s * 365.0 + 0.5).cast("double")),
    )
    operating = F.zip_with(
        F.col("profit_before_tax"),
        F.arrays_zip(F.col("finance_cost").alias("f"), F.col("depreciation").alias("d")),
        lambda p, x: F.when(
            p.isNotNull() & (x["f"].isNotNull() | x["d"].isNotNull()),
            p + F.coalesce(x["f"], F.lit(0.0)) + F.coalesce(x["d"], F.lit(0.0)),
        ),
    )
    base = base.withColumns({"operating_profit": operating, "tax_pct": tax, "days": days})

    def money(label: str, metric: str) -> Column:
        shown = F.transform(
            F.col(metric), lambda v: N.number_text(N.round_half_up(v / F.col("divisor"), 2))
        )
        return _row(label, metric, shown)

    def plain(label: str, metric: str) -> Column:
        return _row(label, metric, F.transform(F.col(metric), N.number_text))

    def _row(label: str, metric: str, shown: Column) -> Column:
        has_any = F.exists(F.col(metric), lambda v: v.isNotNull())
        return F.when(has_any, F.struct(F.lit(label).alias("label"), shown.alias("values")))

    def table(*rows: Column) -> Column:
        kept = F.filter(F.array(*rows), lambda r: r.isNotNull())
        return F.when(F.size(kept) > 0, F.struct(F.col("periods").alias("periods"), kept.alias("rows")))

    last = lambda m: F.try_element_at(F.filter(F.col(m), lambda v: v.isNotNull()), F.lit(-1))
    worth = F.coalesce(last("share_capital"), F.lit(0.0)) + F.coalesce(last("reserves"), F.lit(0.0))
    ratio = F.when((worth > 0) & last("borrowings").isNotNull(), N.round_half_up(last("borrowings") / worth, 2))
    return base.select(
        "company_id",
        F.when(ratio.isNotNull(), F.create_map(F.lit("Debt to equity"), N.number_text(ratio)))
        .otherwise(F.expr("cast(map() as map<string,string>)")).alias("ratios"),
        table(
            money("Sales", "revenue"), money("Other Income", "other_income"),
            money("Profit before tax", "profit_before_tax"), money("Operating Profit", "operating_profit"),
            money("Depreciation", "depreciation"), money("Net Profit", "profit_after_tax"),
            plain("Tax %", "tax_pct"),
        ).alias("profit_loss"),
        table(
            money("Borrowings", "borrowings"), money("Equity Capital", "share_capital"),
            money("Reserves", "reserves"), money("Inventory", "inventory"),
            money("Trade Receivables", "trade_receivables"),
        ).alias("balance_sheet"),
        table(money("Cash from Operating Activity", "cash_from_operations")).alias("cash_flow"),
        table(plain("Debtor Days", "days")).alias("ratios_table"),
        F.expr(f"cast(null as {TABLE_TYPE})").alias("shareholding"),
    )
