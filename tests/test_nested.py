"""Nested reports without gathering unfolded items."""

from collections import Counter

from pyspark.sql import functions as F

from flagstone.catalog import load_all
from flagstone.operators import report as R
from flagstone.operators import state as S
from flagstone.operators.state import Checklist, Item

ITEMS = Checklist(tuple(Item(i, s, non_negotiable=i == 3) for i, s in [(1, "S2"), (2, "S1"), (3, "S2"), (4, "S1")]))
ORDER = Checklist(tuple(Item(i, "S") for i in ("A2-01", "A1-02", "A1-01")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(x):
    return tuple(plain(v) for v in x) if isinstance(x, (list, tuple)) else x


def counted(df):
    return Counter(plain(r) for r in df.collect())


def test_nested_report_by_run(spark):
    runs = spark.createDataFrame([(1, "T1"), (2, None), (2, "T2"), (None, "T3"), (None, None), (3, "T4")], "run_id long, ticker string")
    results = spark.createDataFrame(
        [(1, 1, "DONE", "RED", "a"), (1, 3, "DEFERRED", "GREEN", "b"), (2, 2, "DONE", "NOT_AVAILABLE", "c"), (2, 2, "ERROR", None, None),
         (3, 9, "DONE", "RED", "x"), (3, 4, None, None, None), (None, 1, "DONE", "GREEN", "d"), (9, 1, "DONE", "GREEN", "e")],
        "run_id long, item_id int, status string, flag string, value string",
    )
    columns = ["status", "flag", "value"]
    ids = F.array(*map(F.lit, ["A2-01", "A1-02", "A1-01"]))
    names = lambda c: F.get(ids, c - 1)
    rows = S.items_with_results(runs, ITEMS, results, columns).withColumns({"item_id": names(F.col("item_id")), "verdict": F.col("value")})
    want = R.nested_report(R.report_items(rows), ORDER)
    kept = S.runs_with_items(runs, ITEMS, results, columns)
    cells = F.transform("items", lambda i: i.withField("item_id", names(i["item_id"])).withField("verdict", i["value"]))
    got = R.nested_report_by_run(R.report_items_by_run(kept.withColumn("items", cells), ["item_id", "section_code"]), ORDER)
    assert counted(got) == counted(want)
    by_run = {r.run_id: r.sections for r in got.collect()}
    assert set(by_run) == {1, 2, 3, None}
    assert [(s.section_code, len(s["items"])) for s in by_run[2]] == [("S1", 4), ("S2", 4)]
    first = by_run[1][1]["items"][0]
    assert (first.pos, first.item_id, first.flag, first.value) == (0, "A2-01", "RED", "a")


def test_report_nested_gathers_no_items(tables):
    assert "Generate" not in plan(load_all()["report_nested"].run(tables))
