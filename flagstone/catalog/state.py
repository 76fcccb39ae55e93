"""Stored results: upsert, partial update, resume, scope, audits, quota."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.catalog.oracle import with_ctes
from flagstone.catalog.registry import query
from flagstone.operators import quota as Q
from flagstone.operators import state as S
from flagstone.operators.ordering import latest_per_group
from flagstone.operators.report import tally
from flagstone.sources.bindings import ITEMS, WRITE_ORDER, Tables

NOW = datetime(2001, 8, 1, 12, 0, 0)
_NOW = "TIMESTAMP '2001-08-01 12:00:00'"
_DAY = "CAST(CAST({} AS DATE) AS STRING)"


def day(column: str):
    return F.expr(_DAY.format(column))


@query(
    "scan_filter_order",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40 ORDER BY l_orderkey, l_linenumber",
)
def scan_filter_order(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity").orderBy("l_orderkey", "l_linenumber")


_ARGS = (
    "SELECT CAST(o_orderkey AS STRING) AS arg FROM orders WHERE o_orderkey % 50 = 0 UNION ALL "
    "SELECT 't' || CAST(s_suppkey AS STRING) FROM supplier"
)


@query(
    "resolve_latest_run",
    with_ctes(
        "SELECT a.arg, coalesce(r.run_id, l.run_id) AS run_id FROM args a LEFT JOIN runs r ON CAST(r.run_id AS STRING) = a.arg "
        "LEFT JOIN companies c ON c.ticker = upper(a.arg) LEFT JOIN latest l ON l.company_id = c.company_id",
        "runs", "companies", args=_ARGS,
        latest="SELECT company_id, run_id FROM runs QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, run_id DESC) = 1",
    ),
)
def resolve_latest_run(t: Tables) -> DataFrame:
    ids = t.raw("orders").filter("o_orderkey % 50 = 0").selectExpr("CAST(o_orderkey AS STRING) AS arg")
    tickers = t.raw("supplier").selectExpr("'t' || CAST(s_suppkey AS STRING) AS arg")
    companies = t.companies().withColumn("created_at", F.lit(NOW))
    return S.resolve_runs(ids.unionByName(tickers), t.runs(), companies)


@query("result_upsert", with_ctes("SELECT run_id, item_id, flag, status, attempts FROM results", "results"))
def result_upsert(t: Tables) -> DataFrame:
    """Stored state of the writes before 1999, then the later writes on top."""
    log = t.result_log()
    cut = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    base = S.current_state(log.filter(cut), ["run_id", "item_id"], WRITE_ORDER)
    return S.upsert(base, log.filter(~cut), ["run_id", "item_id"], WRITE_ORDER).select(
        "run_id", "item_id", "flag", "status", "attempts"
    )


@query(
    "usage_daily",
    with_ctes(
        f"SELECT provider, {_DAY.format('ts')} AS day, count(*) AS requests, CAST(sum(tokens) AS DOUBLE) AS tokens FROM calls GROUP BY 1, 2",
        "calls",
    ),
)
def usage_daily(t: Tables) -> DataFrame:
    return Q.usage_daily(t.calls()).select(
        "provider", F.col("day").cast("string").alias("day"), "requests", F.col("tokens").cast("double").alias("tokens")
    )


@query(
    "partial_update",
    "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'DONE' END ELSE o_orderstatus END AS status, "
    "CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'patched' ELSE o_orderpriority END AS note FROM orders",
)
def partial_update(t: Tables) -> DataFrame:
    base = t.raw("orders").selectExpr("o_orderkey AS run_id", "o_orderstatus AS status", "o_orderpriority AS note")
    patch = t.raw("orders").filter("o_orderkey % 3 = 0").selectExpr(
        "o_orderkey AS run_id", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'DONE' END AS status", "'patched' AS note",
        "filter(array(CASE WHEN o_orderkey % 2 = 0 THEN 'status' END, CASE WHEN o_orderkey % 4 = 0 THEN 'note' END), x -> x IS NOT NULL) AS given",
    )
    return S.partial_update(base, patch, ["run_id"])


_DOC_RUNS = "SELECT DISTINCT source AS run_id, CASE WHEN source LIKE '%1%' THEN 'DONE' ELSE 'PARTIAL' END AS status FROM documents"


@query(
    "prune_text",
    with_ctes(
        "SELECT d.doc_id, CASE WHEN r.status = 'DONE' THEN 0 ELSE length(d.text) END AS chars, r.status = 'DONE' AS pruned "
        "FROM docs d JOIN doc_runs r ON r.run_id = d.run_id",
        "docs", doc_runs=_DOC_RUNS,
    ),
)
def prune_text(t: Tables) -> DataFrame:
    runs = t.raw("documents").select(F.col("source").alias("run_id")).distinct().withColumn(
        "status", F.when(F.contains(F.col("run_id"), F.lit("1")), "DONE").otherwise("PARTIAL")
    )
    return S.prune_text(t.documents(), runs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "pruned")


@query(
    "dim_sync_stale",
    "SELECT l_partkey AS part_id FROM lineitem GROUP BY 1 EXCEPT SELECT p_partkey FROM part WHERE p_size < 40",
)
def dim_sync_stale(t: Tables) -> DataFrame:
    current = t.raw("lineitem").select(F.col("l_partkey").alias("part_id"))
    source = t.raw("part").filter("p_size < 40").select(F.col("p_partkey").alias("part_id"))
    return S.stale_ids(current, source, "part_id")


@query(
    "dim_sync",
    "SELECT p_partkey AS part_id, 'new ' || p_name AS name FROM part WHERE p_size < 40",
)
def dim_sync(t: Tables) -> DataFrame:
    current = t.raw("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"))
    source = t.raw("part").filter("p_size < 40").selectExpr("p_partkey AS part_id", "'new ' || p_name AS name")
    return S.sync_dimension(current, source, "part_id")


@query(
    "dim_sync_results",
    "SELECT l_orderkey, l_linenumber, l_partkey AS part_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40)",
)
def dim_sync_results(t: Tables) -> DataFrame:
    """The results of items that the source no longer names go with them."""
    source = t.raw("part").filter("p_size < 40").select(F.col("p_partkey").alias("part_id"))
    results = t.raw("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part_id"))
    return S.prune_results(results, S.stale_ids(results, source, "part_id"), "part_id")


@query("audit_unique", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def audit_unique(t: Tables) -> DataFrame:
    return S.audit_unique(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "audit_fk",
    with_ctes("SELECT company_id, count(*) AS orphans FROM runs WHERE company_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1", "runs"),
)
def audit_fk(t: Tables) -> DataFrame:
    return S.audit_fk(t.runs(), t.companies(), "company_id")


@query("items_left_results", with_ctes("SELECT run_id, item_id, section_code, status, flag FROM state", "state"))
def items_left_results(t: Tables) -> DataFrame:
    return S.items_with_results(t.runs().select("run_id"), ITEMS, t.results()).drop("non_negotiable")


@query("plan_resume", with_ctes("SELECT run_id, item_id, section_code FROM state WHERE status NOT IN ('DONE', 'NEEDS_REVIEW')", "state"))
def plan_resume(t: Tables) -> DataFrame:
    return S.plan_todo(t.runs().select("run_id"), ITEMS, t.results())


@query("plan_scope", with_ctes("SELECT run_id, item_id, section_code FROM state WHERE item_id = 2 OR section_code = 'S3'", "state"))
def plan_scope(t: Tables) -> DataFrame:
    return S.plan_todo(t.runs().select("run_id"), ITEMS, t.results(), item_ids=[2, " "], sections=["S3", ""])


@query("plan_force", with_ctes("SELECT run_id, item_id, section_code FROM state", "state"))
def plan_force(t: Tables) -> DataFrame:
    return S.plan_todo(t.runs().select("run_id"), ITEMS, t.results(), force=True)


@query("drain_queue", with_ctes("SELECT run_id, company_id FROM runs WHERE status = 'PARTIAL' ORDER BY created_at, run_id LIMIT 25", "runs"))
def drain_queue(t: Tables) -> DataFrame:
    return S.drain_queue(t.runs(), 25).select("run_id", "company_id")


@query(
    "resume_candidates",
    with_ctes(
        f"SELECT run_id, status FROM runs WHERE status IN ('PARTIAL', 'PROCESSING') AND (last_processed_at IS NULL OR last_processed_at < {_NOW} - INTERVAL 12 MINUTE) "
        "ORDER BY created_at, run_id LIMIT 8",
        "runs",
    ),
)
def resume_candidates(t: Tables) -> DataFrame:
    return S.resume_candidates(t.runs(), NOW).select("run_id", "status")


_AGE = f"date_diff('second', last_processed_at, {_NOW})"


@query(
    "run_freshness",
    with_ctes(
        f"SELECT run_id, coalesce({_AGE} > 90 * 86400, true) AS stale, coalesce(greatest(0, {_AGE} // 86400), 0) AS days FROM runs", "runs"
    ),
)
def run_freshness(t: Tables) -> DataFrame:
    from flagstone.functions.predicates import days_since, is_stale

    at, now = F.col("last_processed_at"), F.lit(NOW)
    return t.runs().select("run_id", is_stale(at, now).alias("stale"), days_since(at, now).alias("days"))


_LATEST = "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, run_id DESC) = 1"


@query(
    "start_decision",
    with_ctes(
        f"SELECT company_id, run_id, CASE WHEN status = 'DONE' AND date_diff('second', coalesce(last_processed_at, created_at), {_NOW}) <= 90 * 86400 THEN 'fresh' "
        "WHEN status = 'PROCESSING' THEN 'reuse' ELSE 'new' END AS decision FROM latest",
        "runs", latest=_LATEST,
    ),
)
def start_decision(t: Tables) -> DataFrame:
    return S.start_decision(t.runs(), NOW).select("company_id", "run_id", "decision")


@query("latest_per_group", with_ctes(f"SELECT company_id, run_id, status, {_DAY.format('created_at')} AS created FROM latest", "runs", latest=_LATEST))
def latest_per_group_query(t: Tables) -> DataFrame:
    last = latest_per_group(t.runs(), ["company_id"], ["created_at", "run_id"])
    return last.select("company_id", "run_id", "status", day("created_at").alias("created"))


@query(
    "blank_targets",
    with_ctes(
        "SELECT run_id, item_id FROM state WHERE status NOT IN ('DONE', 'NEEDS_REVIEW') OR flag IS NULL OR flag = 'NOT_AVAILABLE'", "state"
    ),
)
def blank_targets(t: Tables) -> DataFrame:
    state = S.items_with_results(t.runs().select("run_id"), ITEMS, t.results())
    return S.blank_targets(state).select("run_id", "item_id")


CAPS, CAP = {"click": 60, "view": 40}, 50


@query(
    "quota_admission",
    with_ctes(
        "SELECT call_id, provider, nth, CASE WHEN nth <= CASE provider WHEN 'click' THEN 60 WHEN 'view' THEN 40 ELSE 50 END THEN 'SERVED' ELSE 'DEFERRED' END AS admission "
        "FROM (SELECT *, row_number() OVER (PARTITION BY provider, CAST(ts AS DATE) ORDER BY ts, call_id) AS nth FROM calls)",
        "calls",
    ),
)
def quota_admission(t: Tables) -> DataFrame:
    return Q.admit_daily(t.calls(), CAPS, CAP).select("call_id", "provider", "nth", "admission")


@query(
    "failure_streak",
    with_ctes(
        "SELECT key, sum(n) AS calls, coalesce(max(n) FILTER (NOT ok), 0) AS longest_streak, coalesce(max(n) FILTER (NOT ok), 0) >= 3 AS retired FROM "
        "(SELECT key, ok, island, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, call_id) - "
        "row_number() OVER (PARTITION BY key, ok ORDER BY ts, call_id) AS island FROM calls) GROUP BY 1, 2, 3) GROUP BY 1",
        "calls",
    ),
)
def failure_streak(t: Tables) -> DataFrame:
    return Q.failure_streaks(t.calls(), retire_at=3)


@query(
    "harvest_counts",
    with_ctes("SELECT doc_type, status, count(*) AS n FROM (SELECT doc_type, CASE WHEN length(text) < 100 THEN 'EMPTY' ELSE 'OK' END AS status FROM docs) GROUP BY 1, 2", "docs"),
)
def harvest_counts(t: Tables) -> DataFrame:
    status = F.when(F.length("text") < 100, "EMPTY").otherwise("OK")
    return tally(t.documents().withColumn("status", status), "doc_type", "status")


@query("harvest_documents", with_ctes("SELECT doc_id, run_id, doc_type, length(text) AS text_chars, url FROM docs", "docs"))
def harvest_documents(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", "run_id", "doc_type", F.length("text").alias("text_chars"), "url")


