"""Inputs that once were lost, cut or ended a job."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from flagstone.functions import numbers as N
from flagstone.functions import predicates as P
from flagstone.functions import text as X
from flagstone.operators import quota, research, retrieve, state
from flagstone.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("value", "text"),
    [(1e24, "1.0E24"), (1e300, "1.0E300"), (1e-20, "1.0E-20"), (120.0, "120"), (0.5, "0.5"), (-3.25, "-3.25"), (1e16, "10000000000000000"), (0.0, "0"), (None, None)],
)
def test_number_text_of_any_size(spark, value, text):
    assert one(spark, N.number_text(F.lit(value).cast("double"))) == text


def test_white_space_of_any_kind_is_trimmed(spark):
    assert one(spark, P.is_na(F.lit("not available\n")))
    assert one(spark, P.is_na(F.lit(" Not Available\t")))
    assert one(spark, P.is_absence(F.lit("\n")))
    assert one(spark, N.latest_text(F.array(F.lit("7"), F.lit("\n")))) == "7"
    assert one(spark, N.trend_label(F.array(F.lit("1"), F.lit("9"), F.lit(" \n")))) == "rising"
    assert one(spark, X.clean_name(F.lit("\nJane Roe\n"))) == "Jane Roe"


def test_29_february_counts_on_from_the_first(spark):
    start, _ = research.date_window(F.lit(datetime.datetime(2024, 2, 29)), F.lit("A9"))
    assert one(spark, start) == datetime.date(1999, 3, 1)


def test_null_keys_and_times_are_admitted(spark):
    at = datetime.datetime(2024, 1, 1, 8)
    calls = spark.createDataFrame([("openai", 1, at), (None, 2, at), ("openai", 3, None)], "provider string, call_id long, ts timestamp")
    assert {r["call_id"]: r["admission"] for r in quota.admit_daily(calls).collect()} == {1: "SERVED", 2: "SERVED", 3: "SERVED"}


def test_null_texts_take_no_place_in_the_feed(spark):
    docs = [("r", n, n, None, "OK") for n in range(6000)] + [("r", 6000 + n, 6000 + n, "x" * 50, "OK") for n in range(10)] + [("r", 9000, -1, "y" * 50, "FAILED")]
    df = spark.createDataFrame(docs, "run_id string, doc_id long, doc_order long, text string, fetch_status string").withColumn("name", F.lit("accounts"))
    assert sorted(r["doc_id"] for r in retrieve.select_feed(df, 2000).collect()) == list(range(6000, 6010))


def test_feed_bound_keeps_every_document_that_fits(spark):
    docs = [("r", n, n, "x") for n in range(3000)]
    df = spark.createDataFrame(docs, "run_id string, doc_id long, doc_order long, text string").withColumn("name", F.lit(""))
    for pieces in (1, 64):
        rows = retrieve.select_feed(df, 2000, pieces).collect()
        size = rows[0]["chars"]
        assert sorted(r["doc_id"] for r in rows) == list(range(-(-2000 // size)))


def test_empty_texts_are_nobodys_copies(spark):
    docs = spark.createDataFrame([("r", n, f"u{n}", "") for n in range(3)], "run_id string, doc_order int, url string, text string")
    assert all(r["note"] is None and r["content_hash"] is None for r in retrieve.dedup_by_hash(docs).collect())


def test_two_results_of_one_item(spark):
    runs = spark.createDataFrame([("r",)], "run_id string")
    results = spark.createDataFrame([("r", "a", "DONE", "GREEN"), ("r", "a", "DONE", "RED"), ("r", "a", "DONE", "RED")], "run_id string, item_id string, status string, flag string")
    checklist = state.Checklist((state.Item("a", "S"), state.Item("b", "S")))
    rows = state.items_with_results(runs, checklist, results).collect()
    assert {r["item_id"]: (r["status"], r["flag"]) for r in rows} == {"a": ("DONE", "RED"), "b": ("PENDING", None)}


@pytest.mark.parametrize("ids", [("a", "b"), (1, 2)])
def test_a_scope_of_nothing_known_gives_no_rows(spark, ids):
    kind = "string" if isinstance(ids[0], str) else "int"
    runs = spark.createDataFrame([("r",)], "run_id string")
    results = spark.createDataFrame([], f"run_id string, item_id {kind}, status string, flag string")
    checklist = state.Checklist(tuple(state.Item(i, "S") for i in ids))
    todo = state.plan_todo(runs, checklist, results, item_ids=["zzz"])
    assert todo.count() == 0 and dict(todo.dtypes)["item_id"] == kind


def test_a_long_checklist_is_no_error(spark):
    assert len(state.Checklist(tuple(state.Item(i, "S") for i in range(10_001))).scoped(item_ids=range(10_000)).items) == 10_000


def test_streamed_streaks_with_ties_late_and_retried_calls(spark, tmp_path):
    schema = "key string, call_id long, ts timestamp, ok boolean"
    at = lambda m: datetime.datetime(2024, 1, 1, 8) + datetime.timedelta(minutes=m)
    batches = [
        [("k", 1, at(0), False), ("k", 2, at(5), False)],
        [("k", 3, at(5), False), ("k", 4, at(5), False), ("j", 5, at(0), True)],
        [("k", 0, at(-90), False), ("j", 6, at(-1), False), ("k", 7, at(9), True)],
    ]
    source, log, check = (os.path.join(str(tmp_path), n) for n in ("in", "log", "check"))
    store = jobs.streak_store(spark, log, fanout=2)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_streaks(spark.readStream.schema(schema).parquet(source), store, check, "hour").awaitTermination()
    got = {r["key"]: (r["calls"], r["longest"], r["tail"]) for r in jobs.read_streaks(store).collect()}
    twin = quota.streak_summary(spark.createDataFrame([x for rows in batches for x in rows], schema))
    assert got == {r["key"]: (r["calls"], r["longest"], r["tail"]) for r in twin.collect()} == {"k": (6, 5, 0), "j": (2, 1, 0)}


def test_deeply_nested_page_is_read(spark):
    from flagstone.sources import pages

    html = "<h1>Name</h1>" + "<div>" * 3000 + '<ul class="x"><li>deep</li></ul>' + "</div>" * 3000
    df = spark.createDataFrame([(1, "https://x.example/c", html)], "company_id int, url string, html string")
    assert pages.structure_pages(df).first()["name"] == "Name"


def test_hits_left_out_are_counted(spark):
    hits = [(1, "A1-01", 0, n, f"https://n{n}.example/a", "Acme Corp news", f"Acme Corp {n}", "Acme Corp", "ACME") for n in range(8)]
    df = spark.createDataFrame(hits, "company_id int, item_id string, query_idx int, pos int, url string, title string, snippet string, name string, ticker string")
    rows = research.research_hits(df, keep_hits=2, keep_research=4).collect()
    assert len(rows) + rows[0]["left_out"] == 8


def test_groups_still_open_at_the_end_come_out(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    closed = [("a", at(1), 5), (None, at(1), 2)]
    twin = spark.createDataFrame([*closed, ("a", at(2), 3)], "k string, d timestamp, n int")
    end, border = F.col("d") + F.expr("INTERVAL 1 DAY"), datetime.datetime(2024, 1, 2, 7, tzinfo=datetime.UTC)
    whole = lambda rows, border: sorted((r["k"] or "", r["d"].day, r["n"]) for r in jobs.with_open_groups(spark.createDataFrame(rows, twin.schema), twin, end, border).collect())
    assert whole(closed, border) == [("", 1, 2), ("a", 1, 5), ("a", 2, 3)]
    # a closed group that the stream lost stays lost
    assert whole(closed[:1], border) == [("a", 1, 5), ("a", 2, 3)]
    assert whole([], None) == [("", 1, 2), ("a", 1, 5), ("a", 2, 3)]


def test_pieces_of_time_do_not_change_the_result(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 8) + datetime.timedelta(seconds=s)
    rows = [("k", n, at(n * 7), n % 11 == 0) for n in range(400)]
    calls = spark.createDataFrame(rows, "key string, call_id long, ts timestamp, ok boolean")
    want = quota.streak_summary(calls).collect()
    assert all(quota.streak_summary(calls, piece).collect() == want for piece in ("second", "minute", "day"))
    asked = calls.withColumnRenamed("key", "provider")
    served = lambda piece: {r["call_id"] for r in quota.admit_daily(asked, {"k": 57}, piece=piece).collect() if r["admission"] == "SERVED"}
    assert served("minute") == served("second") == set(range(57))


@pytest.mark.parametrize("gone", ["flagstone.llm", "zstandard"])
def test_missing_packages_do_not_take_the_core_queries_along(gone):
    """In a process of its own, as imports are kept."""
    import subprocess
    import sys

    code = (
        "import sys, warnings\n"
        f"sys.modules[{gone!r}] = None\n"
        "import __spark_entry__ as e\n"
        "with warnings.catch_warnings(record=True) as said:\n"
        "    warnings.simplefilter('always')\n"
        "    names = set(e.queries())\n"
        "assert 'assessment' in names and not any(n.startswith('op1_') or n == 'pipeline' for n in names), names\n"
        f"assert any({gone.split('.')[-1]!r} in str(w.message) for w in said), said\n"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
