"""Resume, scope, rollup, audit, skewed keys and streams."""

import datetime as dt
import os

from pyspark.sql import functions as F

from flagstone.operators import quota as Q
from flagstone.operators import report as RP
from flagstone.operators import research as RS
from flagstone.operators import retrieve as RT
from flagstone.operators import state as S
from flagstone.operators.ordering import numbered
from flagstone.operators.state import Checklist, Item
from flagstone.streaming import jobs as J

LIST = Checklist((Item("A1-01", "A1"), Item("A1-02", "A1", non_negotiable=True), Item("A2-01", "A2"), Item("A2-02", "A2")))
RESULT = "run_id string, item_id string, status string, flag string"


def runs(spark):
    return spark.createDataFrame([("r",)], "run_id string")


def test_resume_force_and_scope(spark):
    results = spark.createDataFrame([("r", "A1-01", "DONE", "GREEN"), ("r", "A1-02", "DONE", "RED"), ("r", "A2-01", "DEFERRED", "RED")], RESULT)
    todo = lambda **kw: sorted(r["item_id"] for r in S.plan_todo(runs(spark), LIST, results, **kw).collect())
    assert todo() == ["A2-01", "A2-02"]
    assert len(todo(force=True)) == 4
    assert todo(item_ids=["A1-02"]) == ["A1-02"] and todo(sections=["A1"]) == ["A1-01", "A1-02"]
    assert todo(item_ids=[" "], sections=[""]) == ["A2-01", "A2-02"]


def test_summary_ignores_stale_flags(spark):
    results = spark.createDataFrame([("r", "A1-01", "DONE", "GREEN"), ("r", "A1-02", "DONE", "RED"), ("r", "A2-01", "DEFERRED", "RED")], RESULT)
    row = RP.summarize(S.items_with_results(runs(spark), LIST, results)).first()
    assert row["red"] == 1 and row["green"] == 1 and not row["gate_pass"] and row["failed_items"] == ["A1-02"] and row["run_status"] == "PARTIAL"
    assert row["items_pending"] == 1 and row["items_deferred"] == 1


def test_upsert_twice_is_upsert_once(spark):
    log = spark.createDataFrame([("r", "a", 1, "x"), ("r", "a", 2, "y"), ("r", "b", 1, "z")], "run_id string, item_id string, seq int, flag string")
    base = S.current_state(log, ["run_id", "item_id"], ["seq"])
    again = S.upsert(base, log, ["run_id", "item_id"], ["seq"])
    pick = lambda df: sorted((r["item_id"], r["flag"]) for r in df.collect())
    assert pick(base) == pick(again) == [("a", "y"), ("b", "z")]
    assert sorted(r["attempts"] for r in again.collect()) == [2, 4]


def test_audit_only_softens(spark):
    results = spark.createDataFrame(
        [("r", f"i{n}", "DONE", "RED" if n < 5 else "GREEN", "v", None) for n in range(20)], RESULT + ", verdict string, provider string"
    )
    findings = spark.createDataFrame(
        [("r", "i0", "GREEN", "fine"), ("r", "i1", "RED", ""), ("r", "i2", "KEEP", ""), ("r", "i9", "RED", ""), ("r", "i3", "NEUTRAL", "")],
        "run_id string, item_id string, corrected_flag string, note string",
    )
    out = {r["item_id"]: r for r in RS.audit_soften(results, findings).collect()}
    assert out["i0"]["flag"] == "GREEN" and out["i0"]["verdict"] == "fine" and out["i0"]["provider"] == "qa" and out["i3"]["flag"] == "NEUTRAL"
    assert [out[i]["flag"] for i in ("i1", "i2", "i9")] == ["RED", "RED", "GREEN"]
    few = RS.audit_soften(results.filter("item_id <> 'i19'"), findings)
    assert few.filter("softened").count() == 0


def test_one_key_with_all_rows_is_numbered_in_pieces(spark):
    df = spark.range(5000).select(F.lit("hot").alias("key"), ((F.col("id") * 7919) % 5000).alias("t"))
    got = numbered(df, ["key"], F.floor(F.col("t") / 100), ["t"]).select((F.col("position") - F.col("t")).alias("d")).distinct().collect()
    assert [r["d"] for r in got] == [1]


def brute_streak(oks):
    best = run = 0
    for ok in oks:
        run = 0 if ok else run + 1
        best = max(best, run)
    return best


def calls(spark, oks, key="p", start=0):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(key, n, t0 + dt.timedelta(minutes=11 * (n + start)), ok) for n, ok in enumerate(oks)]
    return spark.createDataFrame(rows, "key string, call_id long, ts timestamp, ok boolean")


def test_streaks_against_brute_force(spark):
    import random

    random.seed(7)
    for chance in (0.2, 0.8, 0.97):
        oks = [random.random() > chance for _ in range(300)]
        assert Q.failure_streaks(calls(spark, oks)).first()["longest_streak"] == brute_streak(oks)
    assert Q.failure_streaks(calls(spark, [False] * 40)).first()["longest_streak"] == 40
    assert Q.failure_streaks(calls(spark, [True] * 5)).first()["longest_streak"] == 0


def test_streamed_streaks_over_batches_equal_one_batch(spark, tmp_path):
    import random

    random.seed(3)
    oks = [random.random() > 0.85 for _ in range(240)]
    source, state, check = (os.path.join(str(tmp_path), n) for n in ("in", "state", "check"))
    store = J.streak_store(spark, state)
    for n in range(4):
        calls(spark, oks[n * 60:(n + 1) * 60], start=n * 60).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, call_id long, ts timestamp, ok boolean").parquet(source)
        J.stream_streaks(stream, store, check).awaitTermination()
    row = J.read_streaks(store).first()
    assert (row["calls"], row["longest"]) == (240, brute_streak(oks))


def test_passages_cite_their_page(spark):
    text = "===== PAGE 4 =====\nnothing here\n\n===== PAGE 5 =====\nThe Statutory Auditor is named here 12 34"
    docs = spark.createDataFrame([("r", 1, 1, "ANNUAL_REPORT", False, text)], "run_id string, doc_id long, doc_order long, doc_type string, unlisted boolean, text string")
    searches = [RT.Search("A4-01", ("ANNUAL_REPORT",), ("statutory auditor",)), RT.Search("A7a-13", ("ANNUAL_REPORT",), (), ("statutory auditor",), True), RT.Search("X", ("WEB",), ("statutory",))]
    got = {r["item_id"]: r for r in RT.document_evidence(docs, searches).collect()}
    assert set(got) == {"A4-01", "A7a-13"} and got["A4-01"]["page"] == 5 and got["A7a-13"]["page"] == 5
    assert got["A7a-13"]["found_by"] == "heading" and got["A7a-13"]["passage"].startswith("Statutory Auditor")


def test_progress_and_freshness(spark):
    rows = [("QUEUED", 0, 0), ("PROCESSING", 53, 40), ("PROCESSING", 53, 53), ("PARTIAL", 0, 0), ("DONE", 106, 100)]
    df = spark.createDataFrame(rows, "status string, done_items long, answered long").coalesce(1)
    got = [(r["percent"], r["ready"]) for r in RP.with_progress(df, F.lit(106)).collect()]
    assert got[0][0] == 4 and 15 < got[1][0] < got[2][0] < 99 and got[3] == (15, False) and got[4] == (100, True)


def test_duplicate_texts_name_the_first(spark):
    docs = spark.createDataFrame([("r", n, f"u{n}", "same" if n != 3 else "other") for n in range(1, 6)], "run_id string, doc_order int, url string, text string")
    out = {r["url"]: r for r in RT.dedup_by_hash(docs).collect()}
    assert out["u1"]["text"] == "same" and out["u2"]["note"] == "duplicate of u1" and out["u2"]["text"] is None and out["u3"]["note"] is None
