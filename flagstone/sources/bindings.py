"""The domain tables read from the star-schema and text tables under a data folder.

Each binding is a list of SQL expressions both Spark and an SQL oracle understand; here they become
DataFrames. The operators themselves know nothing of this: they take any DataFrame with the columns.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flagstone.operators.state import Checklist, Item

WRITE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]

COMPANY = [
    "s_suppkey AS company_id",
    "s_name AS name",
    "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'T' || CAST(s_suppkey AS STRING) END AS ticker",
]
RUN = [
    "o_orderkey AS run_id",
    "o_custkey AS company_id",
    "o_orderdate AS created_at",
    "CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'PARTIAL' ELSE 'PROCESSING' END AS status",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS last_processed_at",
]
RESULT_LOG = [
    "l_orderkey AS run_id",
    "l_linenumber AS item_id",
    "CASE WHEN l_quantity > 45 THEN 'NOT_AVAILABLE' WHEN l_returnflag = 'A' THEN 'GREEN' "
    "WHEN l_returnflag = 'R' THEN 'RED' ELSE 'NEUTRAL' END AS flag",
    "CASE WHEN l_linestatus = 'F' THEN 'DONE' WHEN l_discount < 0.05 THEN 'NEEDS_REVIEW' ELSE 'DEFERRED' END AS status",
    "l_partkey AS doc_id",
    *WRITE_ORDER,
]
CALL = [
    "event_id AS call_id", "event_type AS provider", "user_id AS key", "ts",
    "CAST(value AS DECIMAL(12,2)) AS tokens", "event_type <> 'error' AS ok",
]
DOCUMENT = [
    "doc_id", "source AS run_id", "doc_id AS doc_order", "'doc ' || CAST(doc_id AS STRING) AS name",
    "'https://files.example.org/' || source || '/' || CAST(doc_id AS STRING) AS url",
    "CASE lang WHEN 'en' THEN 'ANNUAL_REPORT' WHEN 'de' THEN 'EARNINGS_PDF' WHEN 'es' THEN 'ANNOUNCEMENT' ELSE 'WEB' END AS doc_type",
    "source IN ('src0', 'src5', 'src10', 'src15') AS unlisted", "text",
]

ITEMS = Checklist(
    items=tuple(
        Item(i, f"S{s}", f"Item {i}", order_idx=i, non_negotiable=i == 3)
        for i, s in [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3)]
    ),
    sections=(("S1", "Board"), ("S2", "Ownership"), ("S3", "Accounts")),
)

# yearly sums per company, exact decimals
YEARLY = {
    "ext": "SUM(CAST(l_extendedprice AS DECIMAL(12,2)))",
    "disc": "SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)))",
    "tax": "SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)))",
    "qty": "SUM(CAST(l_quantity AS DECIMAL(12,2)))",
    "cash": "SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END)",
    "recv": "SUM(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END)",
    "borr": "SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END)",
}


def _cents(expression: str) -> str:
    return f"CAST(FLOOR(({expression}) * 100 + 0.5) AS BIGINT)"


_PBT = "(ext - disc) * 0.2e0"
_TAX = "tax * 0.25e0 * (company_id % 10)"
# yearly figures in hundredths, so that texts and sums are exact; reserves add up profits
CENTS = {
    "sales": _cents("ext"),
    "other_income": _cents("disc * (company_id % 10) / 5e0"),
    "operating_profit": _cents(f"{_PBT} + qty * 100e0 * (company_id % 10)"),
    "pbt": _cents(_PBT),
    "tax_pct": _cents(f"100e0 * ({_TAX}) / ({_PBT})"),
    "depreciation": _cents("qty * 100e0 * (company_id % 10)"),
    "net_profit": _cents(f"{_PBT} - {_TAX}"),
    "payout": "CAST((company_id + yr) % 4 * 1000 AS BIGINT)",
    "equity": _cents("(ABS(s_acctbal) + 1e0) * 100e0"),
    "borrowings": _cents("borr * 0.2e0 * (company_id % 10) * (company_id % 10)"),
    "cash": _cents("cash * 0.3e0"),
    "days": _cents("365e0 * (recv * (company_id % 10) / 3e0) / ext"),
    "promoters": "CAST(4000 + company_id % 45 * 100 + (yr - 1995) * 25 AS BIGINT)",
    "pledged": "CAST(company_id % 7 * 150 AS BIGINT)",
}
# table -> rows in order: (label, figure)
STATEMENT_ROWS = {
    "ratios_table": [("Debtor Days", "days"), ("Working Capital Days", "days")],
    "profit_loss": [
        ("Sales", "sales"), ("Other Income", "other_income"), ("Operating Profit", "operating_profit"),
        ("Profit before tax", "pbt"), ("Tax %", "tax_pct"), ("Depreciation", "depreciation"),
        ("Net Profit", "net_profit"), ("Dividend Payout %", "payout"),
    ],
    "balance_sheet": [("Equity Capital", "equity"), ("Reserves", "reserves"), ("Borrowings", "borrowings")],
    "cash_flow": [("Cash from Operating Activity", "cash")],
    "shareholding": [("Promoters", "promoters"), ("Pledged", "pledged")],
}


def money_text(cents: str) -> str:
    """SQL text of a non-negative amount in hundredths."""
    return (
        f"CAST(CAST(FLOOR({cents} / 100) AS BIGINT) AS STRING) || '.' || LPAD(CAST({cents} % 100 AS STRING), 2, '0')"
    )


def case_text(selector: str, templates: list[str]) -> str:
    """CASE over `selector % n` choosing a sentence; {q} and {p} are the quantity and price figures."""
    q, p = "CAST(CAST(l_quantity AS BIGINT) AS STRING)", "CAST(CAST(FLOOR(l_extendedprice / 10) AS BIGINT) AS STRING)"
    arms = []
    for n, t in enumerate(templates):
        pieces = t.replace("'", "''").replace("{q}", f"' || {q} || '").replace("{p}", f"' || {p} || '")
        arms.append(f"WHEN {n} THEN '{pieces}'")
    return f"CASE CAST({selector} % {len(templates)} AS INT) {' '.join(arms)} END"


# sentences about a finding, about ten per rule: clean, nil, denied, standard wording, breach, unread
FINDINGS = {
    "committee": [
        "Audit committee: 3 of 4 members independent, met {q} times",
        "{q}% independent, 6 meetings in the year", "2 out of 3 independent", "1 of 4 independent",
        "composition not stated", "100% independent, met 3 times", "4/6 independent directors, {q} meetings",
        "60% independent", "5 of 3 independent, 70% overall", "met {q} times; members not listed",
    ],
    "cheap_equity": [
        "Warrants issued to promoters at a discount of {q}%", "No preferential allotment was made to promoters",
        "Preference shares of Rs {p} crore issued by a subsidiary", "Nil warrants outstanding",
        "Preferential issue to key managerial personnel below market", "Shares issued at market price",
        "Not disclosed in the filings", "Employee options of {q} shares granted", "Warrants: none",
        "Insider received equity at a price lower than fair value",
    ],
    "opinion": [
        "The auditor issued a qualified opinion on {q} matters",
        "In our opinion the statements give a true and fair view",
        "We draw attention to the note: going concern is in significant doubt",
        "We conclude on the appropriateness of the going concern basis of accounting; we draw attention if required",
        "Adverse opinion on controls", "Unmodified report for the year", "Fee of Rs {p} crore paid",
        "The audit covered {q} units", "Material uncertainty related to going concern exists",
        "Nothing was said on the matter",
    ],
    "separation": [
        "The chairman and managing director are different persons", "The same person holds both posts",
        "Roles are split since {q} months", "The chairman is also the ceo", "Non-executive chair appointed",
        "There is no separation of posts", "Board met {q} times", "Separation of roles is in place",
        "The posts were combined in the year", "Post of chair not named",
    ],
    "goodwill": [
        "Goodwill impairment of Rs {q} crore was recorded", "Purchase of intangible assets Rs {p} crore",
        "No goodwill on the balance sheet", "Goodwill was written down by {q}%",
        "Addition to fixed assets, capex Rs {q} crore", "Goodwill of Rs {p} crore; nil impairment",
        "Not available", "Intangibles acquired for Rs {q} crore and impaired later",
        "Goodwill unchanged at Rs {p} crore", "Investment in subsidiaries",
    ],
    "amount": [
        "Corporate guarantees of Rs {p} crore", "Nil contingent liabilities", "Claims of ₹{q} crore and H{p} cr pending",
        "No related party transactions", "not disclosed in the filings", "Exposure Rs 1,{q},000 crore",
        "₹0 crore outstanding", "Amounts could not be determined", "Loan of Rs {q}.5 crore to the group",
        "3 out of 4 members", "Zero guarantees given", "$5 million (equivalent to Rs {q} crore)",
    ],
    "absence": [
        "Nothing adverse: no verified record found", "None reported", "Promoter arrested in a loan case in 20{q}",
        "Long clean record confirmed by {q} filings", "No such case", "Records not found", "",
        "Award for governance", "No litigation reported so far", "History of {q} ventures",
    ],
}
FINDING_SELECTOR = "(l_partkey + l_linenumber)"


def finding_columns() -> list[str]:
    return [
        "l_orderkey AS run_id", "l_linenumber AS line_no", "l_suppkey AS company_id", "l_partkey AS part_id",
        *[f"{case_text(FINDING_SELECTOR, t)} AS {name}" for name, t in FINDINGS.items()],
        f"{case_text('(l_suppkey + l_partkey)', FINDINGS['amount'])} AS evidence",
    ]


class Tables:
    """The tables of one data folder. Reads are lazy; nothing is cached."""

    def __init__(self, spark: SparkSession, folder: str, deal: int | None = None):
        """`deal`: partitions for work that is heavy per row, where the caller knows that the files
        cannot be split (one row group each). Left out, tables are read as they are split by size."""
        self.spark, self.folder, self.deal = spark, folder, deal

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row, dealt out only if the caller asked for it."""
        table = self.raw(name)
        return table.repartition(self.deal) if self.deal else table

    def companies(self) -> DataFrame:
        return self.raw("supplier").selectExpr(*COMPANY)

    def runs(self) -> DataFrame:
        return self.raw("orders").selectExpr(*RUN)

    def result_log(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*RESULT_LOG)

    def results(self) -> DataFrame:
        """Current results: the last write of each run and item."""
        from flagstone.operators.state import current_state

        state = current_state(self.result_log(), ["run_id", "item_id"], WRITE_ORDER)
        return state.select("run_id", "item_id", "flag", "status", "doc_id", "attempts")

    def calls(self) -> DataFrame:
        return self.raw("events").selectExpr(*CALL)

    def documents(self) -> DataFrame:
        return self.spread("documents").selectExpr(*DOCUMENT)

    def findings(self) -> DataFrame:
        return self.spread("lineitem").selectExpr(*finding_columns())

    def yearly(self) -> DataFrame:
        """Figures in hundredths per company and year, reserves added up."""
        sums = (
            self.spread("lineitem")
            .groupBy(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("yr"))
            .agg(*[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in YEARLY.items()])
        )
        sized = sums.join(
            self.raw("supplier").select(F.col("s_suppkey").alias("company_id"), "s_acctbal"), "company_id"
        )
        cents = sized.selectExpr("company_id", "yr", *[f"{e} AS {n}" for n, e in CENTS.items()])
        running = Window.partitionBy("company_id").orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)
        return cents.withColumn("reserves", F.sum("net_profit").over(running))

    def statements(self) -> DataFrame:
        """One row per company with its period tables (see operators.finance)."""
        names = [*CENTS, "reserves"]
        texts = self.yearly().selectExpr(
            "company_id", "yr", *[f"{money_text(n)} AS {n}" for n in names]
        )
        years = texts.groupBy("company_id").agg(
            F.array_sort(F.collect_list(F.struct("yr", *names))).alias("y")
        )

        def figure(name: str) -> Column:
            return F.transform("y", lambda x: x[name])

        def table(rows: list[tuple[str, str]]) -> Column:
            return F.struct(
                F.transform("y", lambda x: F.concat(F.lit("FY"), x["yr"].cast("string"))).alias("periods"),
                F.array(
                    *[
                        F.struct(F.lit(label).alias("label"), figure(n).alias("values"))
                        for label, n in rows
                    ]
                ).alias("rows"),
            )

        return years.select(
            "company_id",
            F.expr("cast(map() as map<string,string>)").alias("ratios"),
            *[table(rows).alias(name) for name, rows in STATEMENT_ROWS.items()],
        )

    def company_pages(self) -> DataFrame:
        """A rendered page of each company: headline list, period tables, notes and document links."""
        ids = {"ratios_table": "ratios", "profit_loss": "profit-loss", "balance_sheet": "balance-sheet",
               "cash_flow": "cash-flow", "shareholding": "shareholding"}
        cell = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))

        def section(name: str) -> Column:
            t = F.col(name)
            head = F.array_join(F.transform(t["periods"], lambda p: cell("th", p)), "")
            rows = F.array_join(
                F.transform(
                    t["rows"],
                    lambda r: F.concat(
                        F.lit('<tr><td class="text">'), r["label"], F.lit("&nbsp;+</td>"),
                        F.array_join(F.transform(r["values"], lambda v: cell("td", v)), ""), F.lit("</tr>"),
                    ),
                ),
                "",
            )
            return F.concat(
                F.lit(f'<section id="{ids[name]}"><table class="data-table"><thead><tr><th></th>'), head,
                F.lit("</tr></thead><tbody>"), rows, F.lit("</tbody></table></section>"),
            )

        cid = F.col("company_id").cast("string")
        html = F.concat(
            F.lit("<html><body><h1>"), F.col("name"), F.lit('</h1><ul id="top-ratios"><li><span class="name">Stock P/E</span>'
            '<span class="value"><span class="number">'), (F.col("company_id") % 40).cast("string"),
            F.lit('</span></span></li><li><span class="name">Code</span><span class="value">C-'), cid,
            F.lit("</span></li></ul>"), *[section(t) for t in ids],
            F.lit('<div class="pros"><ul><li>Debt &amp; cost under control</li><li>Pays dividend no '), cid,
            F.lit('</li></ul></div><div class="cons"><ul><li>Slow collection</li></ul></div><div class="documents annual-reports"><ul>'),
            *[x for y in range(4) for x in (F.lit(f'<li><a href="/ar/{y}/'), cid, F.lit(f'">Annual report {y}</a></li>'))],
            F.lit('<li><a href="/all">All</a></li></ul></div><div class="documents concalls"><ul><li><div>Jan</div>'
                  '<a href="/rec/1">REC</a><a href="/ppt/1">PPT</a><a href="/tr/1">Transcript</a></li></ul></div></body></html>'),
        )
        return (
            self.statements().join(self.companies(), "company_id")
            # reading pages is heavy per row: few small partitions would leave most cores idle
            .repartition(self.spark.sparkContext.defaultParallelism, "company_id")
            .select("company_id", F.concat(F.lit("https://pages.example.org/company/"), cid, F.lit("/")).alias("url"), html.alias("html"))
        )

    def quarterly_pages(self) -> DataFrame:
        """A page of each company with quarters, peers and both shareholding tables, in four shapes: a section
        with an id, a section found by its heading only, one with end tags missing and stray, one with a table in a cell."""
        sums = self.spread("lineitem").groupBy(
            F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")
        ).agg(F.sum("l_quantity").cast("bigint").alias("n"))
        rows = sums.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("y", "q", "n"))).alias("quarters"))
        head = "array_join(transform(quarters, x -> concat('<th>Q', x.q, ' ', x.y, '</th>')), '')"
        figure = "array_join(transform(quarters, x -> concat('<td>', x.n, if(company_id % 4 = 2, '', '</td>'))), '')"
        html = f"""concat('<html><body><h1>', name, '</h1>',
            if(company_id % 4 = 1, '<section><h2>Quarterly  Results</h2>', '<section id="quarters">'),
            '<table class="wide data-table"><thead><tr><th></th>', {head}, '</tr></thead><tbody><tr>',
            CASE company_id % 4 WHEN 2 THEN '<td>Sales&nbsp;+' WHEN 3
                THEN '<td>Sales <table class="data-table"><tbody><tr><td>of which</td><td>9</td></tr></tbody></table></td>'
                ELSE '<td>Sales&nbsp;+</td>' END, {figure}, if(company_id % 4 = 2, '', '</tr>'), '</tbody></table>',
            if(company_id % 4 = 2, '</div><span>', ''), '</section>',
            '<section id="peers"><table><tr><th>Name</th><th>Code</th></tr><tr><td>', name, '</td><td>C-', company_id,
            '</td></tr><tr><td></td><td></td></tr><tr><td>Next &amp; Co</td><td>C-', company_id + 1, '</td></tr></table></section>',
            '<section id="shareholding"><div id="yearly-shp"><table class="data-table"><tbody><tr><td>Promoters</td><td>1%</td></tr></tbody></table></div>',
            '<div id="quarterly-shp"><table class="data-table"><thead><tr><th></th><th>Jun</th></tr></thead><tbody><tr><td>Promoters</td><td>',
            company_id % 60, '.5%</td></tr></tbody></table></div></section></body></html>')"""
        url = "concat('https://pages.example.org/company/', company_id, '/')"
        return rows.join(self.companies(), "company_id").selectExpr("company_id", f"{url} AS url", f"{html} AS html")
