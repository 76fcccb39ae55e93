"""Golden rows: small texts and figures with known flags, through the same functions the jobs use."""

from pyspark.sql import functions as F

from flagstone.functions import numbers as N
from flagstone.functions import predicates as P
from flagstone.functions import rules as R
from flagstone.functions import text as X


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.coalesce(1).select(column).collect()]


def test_first_number(spark):
    texts = ["0.09", "33%", "1.2x", "72.36% (stable)", "1,234", "not available", None]
    got = values(spark, [(t,) for t in texts], "t string", N.first_number(F.col("t")))
    assert got == [0.09, 33, 1.2, 72.36, 1234, None, None]


def test_bands(spark):
    cases = [
        ("<0.5–1.0", ">2 / rising", 0.09, "GREEN"), ("<0.5–1.0", ">2 / rising", 1.5, "NEUTRAL"), ("<0.5–1.0", ">2 / rising", 2.5, "RED"),
        ("0% (or <10%)", ">25% or rising", 0.0, "GREEN"), ("0% (or <10%)", ">25% or rising", 15.0, "NEUTRAL"), ("0% (or <10%)", ">25% or rising", 30.0, "RED"),
        ("Stable/rising, >50%", "Steady decline / sharp drops / <26%", 72.0, "GREEN"), ("Stable/rising, >50%", "Steady decline / sharp drops / <26%", 40.0, "NEUTRAL"),
        ("Stable/rising, >50%", "Steady decline / sharp drops / <26%", 20.0, "RED"), ("≥50% independent; board 8–12", "<50% / only meets bare minimum", 55.0, "GREEN"),
        ("≥50% independent; board 8–12", "<50% / only meets bare minimum", 50.0, "GREEN"), ("≥50% independent; board 8–12", "<50% / only meets bare minimum", 45.0, "RED"),
        (None, "prose", 1.0, "NEUTRAL"),
    ]
    got = values(spark, [c[:3] for c in cases], "g string, r string, v double", R.classify_band(F.col("v"), F.col("g"), F.col("r"))["flag"])
    assert got == [c[3] for c in cases]


def test_custom_numbers(spark):
    cases = {
        "A8-10": [(25, "GREEN"), (8, "RED"), (50, "RED"), (40, "NEUTRAL")], "A8-03": [(30, "GREEN"), (70, "NEUTRAL"), (200, "RED")],
        "A8-11": [(1.1, "GREEN"), (1.6, "NEUTRAL"), (2.5, "RED")], "A6-05": [(20, "GREEN"), (80, "GREEN"), (150, "NEUTRAL"), (250, "RED")],
        "A8-05": [(10, "GREEN"), (30, "NEUTRAL"), (50, "RED")], "A1-04": [(0, "GREEN"), (1, "NEUTRAL"), (3, "RED")],
        "A1-08": [(0, "GREEN"), (1, "NEUTRAL"), (2, "RED")], "A14-02": [(0.11, "GREEN"), (1.5, "NEUTRAL"), (3, "RED")],
    }
    for item, rows in cases.items():
        got = values(spark, [(float(n),) for n, _ in rows], "n double", R.NUMBER_RULES[item](F.col("n"))["flag"])
        assert got == [f for _, f in rows], item


def test_trends(spark):
    days = [([40, 45, 62], "RED"), ([45, 46, 47], "GREEN"), ([40, 50, 55], "NEUTRAL"), ([60, 50, 40], "GREEN"), ([-15, -8, -2], "GREEN"),
            ([-2, -10, -20], "GREEN"), ([-5, 5, 8], "GREEN"), ([2, 40, 60], "RED")]
    got = values(spark, [([str(x) for x in s],) for s, _ in days], "v array<string>", R.rule_working_capital(F.col("v"))["flag"])
    assert got == [f for _, f in days]
    paid = [([30, 32, 35], "GREEN"), ([30, 32, 0], "NEUTRAL"), ([0, 0, 0], "NEUTRAL"), ([], "NEUTRAL")]
    got = values(spark, [([str(x) for x in s],) for s, _ in paid], "v array<string>", R.rule_dividend(F.col("v"))["flag"])
    assert got == [f for _, f in paid]


def test_amounts(spark):
    texts = [("Rs 226 crore", 226), ("₹1,000 crore", 1000), ("H3,566 crore", 3566), ("$25 million (equivalent to Rs 226 crore)", 226),
             ("26 crore in one suit and 7,508 crore in another", 7508), ("3 out of 4 members", None), (None, None)]
    got = values(spark, [(t,) for t, _ in texts], "t string", N.max_amount_crore(F.col("t")))
    assert got == [n for _, n in texts]
    nil = [("Nil contingent liabilities", True), ("No promoter pledge", True), ("₹0 crore", True), ("Not applicable", True),
           ("not available", False), ("not disclosed in the filings", False), ("could not determine", False)]
    assert values(spark, [(t,) for t, _ in nil], "t string", P.states_nil(F.col("t"))) == [b for _, b in nil]


def test_materiality(spark):
    cases = [("A7a-06", "226 crore", True, "GREEN"), ("A5-02", "368 crore", True, "GREEN"), ("A7a-03", "1,234 cr", True, "GREEN"),
             ("A7a-06", "40,000 crore", True, "RED"), ("A5-04", "500,000 crore", True, "NEUTRAL"), ("A7a-06", "226 crore", False, "NEUTRAL"),
             ("A5-01", "No related party transactions (FY2025-26)", True, "GREEN"), ("A7a-06", "amount not disclosed", True, "NEUTRAL")]
    scale = F.when(F.col("s"), F.struct(F.lit(95000.0).alias("net_worth"), F.lit(240000.0).alias("revenue"), F.lit(49000.0).alias("profit")))
    none = F.lit(None).cast("string")
    flag = R.classify_amount(
        R.amount_of(F.col("v"), none), F.col("v"), none, scale, *[R.materiality_rule(F.col("i"), p) for p in range(3)]
    )["flag"]
    assert values(spark, [c[:3] for c in cases], "i string, v string, s boolean", flag) == [c[3] for c in cases]
    guards = [("A7a-13", "RED", "226 crore", "NEUTRAL"), ("A7a-13", "RED", "40,000 crore", None), ("A7a-13", "GREEN", "226 crore", None), ("A4-01", "RED", "226 crore", None)]
    scale = F.struct(F.lit(95000.0).alias("net_worth"), F.lit(240000.0).alias("revenue"), F.lit(49000.0).alias("profit"))
    got = values(spark, [g[:3] for g in guards], "i string, f string, v string", R.guard_amount(F.col("i"), F.col("f"), R.amount_of(F.col("v"), none), scale)["flag"])
    assert got == [g[3] for g in guards]


def test_text_rules(spark):
    cases = {
        "A2-01": [("75% (3 out of 4 members)", None, "GREEN"), ("100% independent, met 6 times", None, "GREEN"), ("1 of 4 independent", None, "RED"),
                  ("3 of 4 independent, met 3 times", None, "RED"), ("composition unknown", None, "NEUTRAL")],
        "A3-05": [("Preferential allotment to promoters at a discount", None, "RED"), ("Preference shares issued by a subsidiary", None, "NEUTRAL"),
                  ("No promoter warrants or preferential allotments", None, "GREEN"), ("Issued at market price", None, "GREEN")],
        "A4-05": [("A qualified opinion was issued", None, "RED"), ("We draw attention to going concern", None, "RED"),
                  ("Auditor's responsibilities: we conclude on the going concern basis of accounting; material uncertainty exists", None, "GREEN"), ("Unmodified opinion", None, "GREEN")],
        "A8-06": [("Impairment of 5", "Purchase of fixed assets", "GREEN"), ("Impairment", "Goodwill was impaired", "RED")],
        "A1-02": [("The roles are split", None, "GREEN"), ("The same person holds both", None, "RED")],
    }
    for item, rows in cases.items():
        got = values(spark, [r[:2] for r in rows], "v string, e string", R.TEXT_RULES[item](F.col("v"), F.col("e"))["flag"])
        assert got == [r[2] for r in rows], item


def test_debt_reconciliation(spark):
    rows = [(True, 0.11, "use_tier1"), (True, 3.0, "trust_doc"), (False, 0.11, "trust_doc"), (True, None, "trust_doc")]
    assert values(spark, [r[:2] for r in rows], "h boolean, d double", R.reconcile_debt(F.col("h"), F.col("d"))) == [r[2] for r in rows]


def test_item_kind(spark):
    kinds = {"Percentage (%)": "NUMERIC", "Ratio": "NUMERIC", "₹ Crore": "NUMERIC", "Count": "NUMERIC", "D/E ratio": "NUMERIC", "1.2x multiple": "NUMERIC",
             "Text": "QUALITATIVE", "Categorical": "QUALITATIVE", "Yes / No": "QUALITATIVE", "": "QUALITATIVE", "Yes/No + count": "QUALITATIVE"}
    assert values(spark, [(k,) for k in kinds], "f string", P.item_kind(F.col("f"))) == list(kinds.values())


def test_identity_gate(spark):
    rows = [("Zenith Cargo Limited reported a loss", "Metal Book Private Limited", True), ("MetalBook grew", "Metal Book Private Limited", False),
            ("Metal Book Logistics Limited is a subsidiary", "Metal Book Private Limited", False), ("A generic remark", "Metal Book Private Limited", False),
            ("Audited by Sharma Gupta LLP", "Metal Book Private Limited", False), ("Zenith Cargo Limited", "", False)]
    assert values(spark, [r[:2] for r in rows], "a string, n string", X.foreign_subject(F.col("a"), F.col("n"))) == [r[2] for r in rows]


def test_urls(spark):
    got = values(spark, [("see https://a.example.org/x. And (https://b.example.org/y), https://a.example.org/x;",)], "t string", X.extract_urls(F.col("t")))
    assert got == [["https://a.example.org/x", "https://b.example.org/y"]]


def test_indian_grouping(spark):
    assert values(spark, [(226.4,), (7508.0,), (123456.0,), (12345678.0,)], "n double", N.format_crore(F.col("n"))) == ["₹226cr", "₹7,508cr", "₹1,23,456cr", "₹1,23,45,678cr"]


def test_no_match_is_null_before_any_cast(spark):
    """An empty text never reaches a cast to a number: each such cast throws and catches an error inside Spark."""
    df = spark.createDataFrame([("none",), ("3 of 4, 80%, met 5 times",), ("5 of 3, 70%",), ("4 meetings",), ("0/2",), (None,)], "t string").coalesce(1)
    c = F.col("t")
    assert [r[0] for r in df.select(N.first_match(c, r"(\d+) of", 1)).collect()] == [None, "3", "5", None, None, None]
    assert [r[0] for r in df.select(N.parse_ratio(c)).collect()] == [None, 0.75, 0.7, None, 0.0, None]
    assert [r[0] for r in df.select(N.parse_meetings(c)).collect()] == [None, 5, None, 4, None, None]
    for made in (N.first_number(c), N.parse_ratio(c), N.parse_meetings(c)):
        plan = df.select(made)._jdf.queryExecution().optimizedPlan().toString()
        assert "try_cast(regexp_extract(" not in plan and "regexp_extract_all" in plan
    bounds = df.limit(1).select(N.parse_band(F.lit(">0.3, <2-1, <=5"))).first()[0]
    assert [tuple(b) for b in bounds] == [(">", 0.3), ("<=", 2.0), ("<=", 5.0)]
