"""Files in and out, logs folded to snapshots, and small plan steps."""

import datetime
import json
import os

from flagstone.plans import acquire, repair
from flagstone.sources import landing
from flagstone.streaming import jobs


def test_checklist_file(spark, tmp_path):
    body = {"title": "t", "sections": [{"code": "A1", "name": "Board", "items": [{"id": "A1-01", "item": "x", "is_non_negotiable": True}, {"id": "A1-02", "item": "y"}]}]}
    path = tmp_path / "list.json"
    path.write_text(json.dumps(body, indent=1))
    rows = landing.load_checklist(spark, str(path)).orderBy("order_idx").collect()
    assert [(r["id"], r["section_code"], r["is_non_negotiable"]) for r in rows] == [("A1-01", "A1", True), ("A1-02", "A1", False)]


def test_uploads_are_listed_and_audited(spark, tmp_path):
    for name, size in [("a/r1.pdf", 10), ("a/r2.PDF", 20), ("b/notes.txt", 5)]:
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = landing.scan_files(spark, str(tmp_path))
    assert sorted((r["name"], r["bytes"]) for r in files.collect()) == [("notes.txt", 5), ("r1.pdf", 10), ("r2.PDF", 20)]
    ready = files.selectExpr("1 AS run_id", "name", "bytes", "CAST(NULL AS STRING) AS mime", "IF(name = 'r2.PDF', ' \\n', 'text') AS text")
    audited = landing.intake(ready)
    assert {r["name"]: r["reason"] for r in audited.collect()} == {"r1.pdf": None, "r2.PDF": "no readable text (scanned PDF?)", "notes.txt": "not a PDF"}
    assert landing.intake_status(audited).first()["status"] == "HARVESTED"


def test_reports_and_tables_are_written(spark, tmp_path):
    df = spark.sql("SELECT 1 AS run_id, 'A1' AS section_code, array(named_struct('flag', 'RED')) AS items")
    landing.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["items"][0]["flag"] == "RED"
    flat = df.select("run_id", "section_code")
    landing.write_table(flat, str(tmp_path / "csv"), "csv")
    landing.write_table(flat, str(tmp_path / "parts"), partition_by="section_code")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["section_code"] == "A1"
    assert os.path.isdir(tmp_path / "parts" / "section_code=A1")


def test_a_log_folds_to_a_snapshot(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    log = str(tmp_path / "log")
    for batch, rows in enumerate([[("r", 1, "RED", at(0))], [("r", 1, "GREEN", at(2)), ("r", 2, "RED", at(1))]]):
        spark.createDataFrame(rows, "run_id string, item_id int, flag string, ts timestamp").write.parquet(f"{log}/batch_id={batch}")
    jobs.compact_log(spark, log, str(tmp_path / "snapshot"), ["run_id", "item_id"], ["ts"])
    rows = spark.read.parquet(str(tmp_path / "snapshot")).collect()
    assert sorted((r["item_id"], r["flag"], r["attempts"]) for r in rows) == [(1, "GREEN", 2), (2, "RED", 1)]


def test_landed_copies_are_notes(spark):
    docs = spark.createDataFrame([("r", 1, "u1", "t"), ("r", 2, "u2", "t")], "run_id string, doc_order int, url string, text string")
    assert {r["url"]: r["note"] for r in acquire.land_documents(docs).collect()} == {"u1": None, "u2": "duplicate of u1"}


def test_answers_are_collected_once_and_status_follows(spark):
    now = datetime.datetime(2024, 6, 1)
    targets = spark.createDataFrame([(1, "A1-01"), (1, "A1-02"), (2, "A1-01")], "company_id int, item_id string")
    live = spark.createDataFrame([(1, "A1-02", "Acme Industries has two auditors", now), (2, "A1-01", "[Error] none", now)], "company_id int, item_id string, answer string, updated_at timestamp")
    cache = spark.createDataFrame([(1, "A1-01", "Acme Industries pays dividends", now - datetime.timedelta(days=3)), (2, "A1-01", "old", now - datetime.timedelta(days=900))], "company_id int, item_id string, answer string, updated_at timestamp")
    companies = spark.createDataFrame([(1, "Acme Industries"), (2, "Other Works")], "company_id int, name string")
    got = repair.collect_answers(targets, live, cache, companies, now).collect()
    assert sorted((r["company_id"], r["item_id"]) for r in got) == [(1, "A1-01"), (1, "A1-02")]
    summary = spark.createDataFrame([(1, "DONE"), (2, "PARTIAL")], "run_id int, run_status string")
    assert [r["status"] for r in repair.final_status(summary, True).orderBy("run_id").collect()] == ["PROCESSING", "PARTIAL"]
