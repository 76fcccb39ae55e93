"""Streaming jobs run to the end of the data, read back as tables."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.catalog.oracle import with_ctes
from flagstone.catalog.registry import query
from flagstone.operators.quota import usage_daily
from flagstone.session import scratch_dir
from flagstone.sources.bindings import CALL, DOCUMENT, RESULT_LOG, WRITE_ORDER, Tables
from flagstone.streaming import jobs as J
from flagstone.streaming.arrivals import ArrivalIndex
from flagstone.streaming.store import KeyedStore


def _stream(t: Tables, table: str, columns: list[str]) -> DataFrame:
    return J.read_stream(t.spark, t.folder, table).selectExpr(*columns)


def _paths(t: Tables, name: str) -> tuple[str, str]:
    root = scratch_dir(t.spark, name)
    return os.path.join(root, "table"), os.path.join(root, "checkpoint")


def _appended(t: Tables, stream: DataFrame, name: str) -> tuple[DataFrame, datetime | None]:
    """The rows that a stream gave out, and its last watermark."""
    path, checkpoint = _paths(t, name)
    run = J.start_table(stream, path, checkpoint)
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path), J.last_watermark(run)


@query(
    "stream_usage_daily",
    with_ctes(
        "SELECT provider, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, CAST(sum(tokens) AS DOUBLE) AS tokens FROM calls GROUP BY 1, 2",
        "calls",
    ),
)
def stream_usage_daily(t: Tables) -> DataFrame:
    rows, border = _appended(t, J.stream_usage_daily(_stream(t, "events", CALL)), "usage")
    rows = J.with_open_groups(rows, usage_daily(t.calls()), (F.col("day") + F.expr("INTERVAL 1 DAY")).cast("timestamp"), border)
    return rows.select("provider", F.col("day").cast("string").alias("day"), "requests", F.col("tokens").cast("double").alias("tokens"))


@query("stream_upsert", with_ctes("SELECT run_id, item_id, flag, status, attempts FROM results", "results"))
def stream_upsert(t: Tables) -> DataFrame:
    path, checkpoint = _paths(t, "writes")
    store = KeyedStore(t.spark, path, ["run_id", "item_id"], WRITE_ORDER)
    J.stream_upsert(_stream(t, "lineitem", RESULT_LOG), store, checkpoint).awaitTermination()
    return store.read().select("run_id", "item_id", "flag", "status", "attempts")


@query(
    "stream_streaks",
    with_ctes(
        "SELECT key, sum(n) AS calls, coalesce(max(n) FILTER (NOT ok), 0) AS longest, coalesce(max(n) FILTER (NOT ok), 0) >= 3 AS retired FROM "
        "(SELECT key, ok, island, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, call_id) - "
        "row_number() OVER (PARTITION BY key, ok ORDER BY ts, call_id) AS island FROM calls) GROUP BY 1, 2, 3) GROUP BY 1",
        "calls",
    ),
)
def stream_streaks(t: Tables) -> DataFrame:
    path, checkpoint = _paths(t, "streaks")
    store = J.streak_store(t.spark, path)
    J.stream_streaks(_stream(t, "events", CALL), store, checkpoint).awaitTermination()
    return J.read_streaks(store, retire_at=3).select(F.col("key").cast("long").alias("key"), "calls", "longest", "retired")


@query(
    "stream_progress",
    with_ctes(
        "SELECT run_id, count(DISTINCT item_id) FILTER (status IN ('DONE', 'NEEDS_REVIEW')) AS done_items, "
        "count(DISTINCT item_id) FILTER (status IN ('DONE', 'NEEDS_REVIEW') AND flag <> 'NOT_AVAILABLE') AS answered FROM log GROUP BY 1",
        "log",
    ),
)
def stream_progress(t: Tables) -> DataFrame:
    path, checkpoint = _paths(t, "progress")
    counts = J.stream_progress(_stream(t, "lineitem", RESULT_LOG), F.col("item_id") - 1, items=7)
    J.start_versions(counts, path, checkpoint).awaitTermination()
    return J.read_versions(t.spark, path, ["run_id"])


@query(
    "stream_idle_runs",
    "SELECT run_id, max(writes) AS most_writes, count(*) AS stretches FROM (SELECT run_id, s, count(*) AS writes, max(ts) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS s FROM "
    "(SELECT user_id AS run_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) "
    "GROUP BY 1",
)
def stream_idle_runs(t: Tables) -> DataFrame:
    writes = ["user_id AS run_id", "CAST(ts AS TIMESTAMP) AS ts"]
    rows, border = _appended(t, J.stream_idle_runs(_stream(t, "events", writes)), "idle")
    twin = J.stream_idle_runs(t.raw("events").selectExpr(*writes))
    rows = J.with_open_groups(rows, twin, F.col("last_write") + F.expr("INTERVAL 12 MINUTES"), border)
    return rows.groupBy("run_id").agg(F.max("writes").alias("most_writes"), F.count(F.lit(1)).alias("stretches"))


@query("stream_dedup", with_ctes("SELECT DISTINCT run_id, sha256(text) AS content_hash FROM docs", "docs"))
def stream_dedup(t: Tables) -> DataFrame:
    path, checkpoint = _paths(t, "arrivals")
    index = ArrivalIndex(t.spark, path)
    # the tables say nothing of when a document came; its place in its run stands for it
    arrived = _stream(t, "documents", DOCUMENT).withColumn("arrived", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_order", F.lit(7)).cast("int")))
    J.stream_dedup(arrived, index, checkpoint, "arrived").awaitTermination()
    return index.firsts().select("run_id", "content_hash")
