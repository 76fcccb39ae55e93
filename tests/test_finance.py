"""Ratios from small period tables and statements in absolute money."""

from pyspark.sql import functions as F

from flagstone.operators import finance as fin

TABLES = {
    "profit_loss": (["FY23", "FY24", "TTM"], {"Net Profit": ["100", "120", "130"], "Operating Profit": ["150", "180", "190"], "Depreciation": ["10", "12", "13"], "Tax %": ["24", "25", "25%"]}),
    "cash_flow": (["FY23", "FY24"], {"Cash from Operating Activity": ["90", "110"]}),
    "ratios_table": (["FY23", "FY24"], {"Debtor Days": ["60", "70"]}),
    "shareholding": (["Q1", "Q2"], {"Promoters": ["72.00%", "72.30%"]}),
    "balance_sheet": (["FY24"], {"Borrowings": ["50"], "Equity Capital": ["10"], "Reserves": ["490"]}),
}


def statement(spark, tables):
    row = {"company_id": 1, "ratios": {}}
    for t in fin.TABLES:
        periods, rows = tables.get(t, (None, None))
        row[t] = None if periods is None else {"periods": periods, "rows": [{"label": k, "values": v} for k, v in rows.items()]}
    schema = "company_id long, ratios map<string,string>, " + ", ".join(f"{t} {fin.TABLE_TYPE}" for t in fin.TABLES)
    return spark.createDataFrame([row], schema)


def metrics(spark, tables, **kw):
    df = fin.figures(statement(spark, tables), **kw)
    return df.select(*[c.alias(n) for n, c in fin.metric_texts().items()]).first().asDict()


def test_ratios(spark):
    got = metrics(spark, TABLES)
    assert got["cash_to_profit"] == "0.57" and got["cash_to_operating_profit"] == "0.58" and got["tax_rate"] == "25%"
    assert got["debtor_days"] == "70 days" and got["cash_eps"] == "1.10" and got["free_float"] == "27.70%" and got["debt_to_equity"] == "0.10"


def test_ttm_can_be_dropped(spark):
    assert metrics(spark, TABLES, drop_ttm=True)["cash_to_profit"] == "0.91"


def test_missing_tables_give_null(spark):
    assert metrics(spark, {})["cash_to_profit"] is None


def test_first_matching_row_hides_later_ones(spark):
    tables = {"profit_loss": (["a", "b"], {"Net Profit before items": [None, ""], "Net Profit": ["5", "6"]})}
    assert fin.figures(statement(spark, tables)).first()["profit"] is None


V = {
    "revenue": [341528009, 925330106], "other_income": [298538, 232111], "profit_before_tax": [42762451, 238135399], "profit_after_tax": [29811419, 168790371],
    "depreciation": [10689248, 35119445], "finance_cost": [14520348, 40932726], "current_tax": [11566301, 69345028], "share_capital": [115900000, 250000000],
    "reserves": [32843933, 201634304], "borrowings": [171245826, 744910414], "trade_receivables": [12346109, 39121971], "inventory": [65841842, 102406251],
    "cash_from_operations": [None, 250325474], "total_assets": [347171455, 1364512942],
}


def extracts(spark, metrics, found=True, unit="rupees"):
    schema = "company_id long, found boolean, unit string, periods array<string>, " + ", ".join(f"{m} array<double>" for m in fin.METRICS)
    row = [1, found, unit, ["FY24-25", "FY25-26"], *[[None if v is None else float(v) for v in metrics[m]] if metrics.get(m) else None for m in fin.METRICS]]
    return spark.createDataFrame([tuple(row)], schema)


def test_statement_in_rupees(spark):
    s = fin.build_statements(extracts(spark, V))
    figures = fin.figures(s).select("*", fin.net_worth().alias("worth"), fin.debt_to_equity_text().alias("de")).first()
    assert figures["revenue"] == 92.53 and figures["profit"] == 16.88 and figures["borrowings"] == 74.49 and figures["operating_profit"] == 31.42
    assert round(figures["worth"], 2) == 45.16 and figures["de"] == "1.65" and 25 < figures["tax_pct"] < 35


def test_nothing_found_gives_no_row(spark):
    assert fin.build_statements(extracts(spark, V, found=False)).count() == 0


def test_divisor(spark):
    rows = [(925330106.0, "crores", 1e7), (9200.0, "lakhs", 100.0), (92.0, "crores", 1.0), (50000.0, "unknown", 100.0), (85.0, "unknown", 1.0)]
    df = spark.createDataFrame([r[:2] for r in rows], "m double, u string").coalesce(1)
    assert [r[0] for r in df.select(fin.crore_divisor(F.col("m"), F.col("u"))).collect()] == [r[2] for r in rows]
