"""Filling blanks from research answers, and the audit that may only soften."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.functions import predicates as P
from flagstone.functions import rules as R
from flagstone.operators import classify as C
from flagstone.operators import research as RS
from flagstone.operators.state import blank_targets


def collect_answers(targets: DataFrame, live: DataFrame, cache: DataFrame, companies: DataFrame, now: datetime) -> DataFrame:
    """One usable answer per target: a fresh cached one first, about this company only."""
    cached = RS.fresh_answers(cache, targets, now)
    merged = RS.merge_answers(live.filter(RS.usable_answer(F.col("answer"))), cached)
    wanted = targets.select("company_id", "item_id").distinct()
    named = merged.join(wanted, ["company_id", "item_id"], "left_semi").join(
        companies.select("company_id", "name"), "company_id"
    )
    return RS.identity_gate(named).drop("name")


def backfill(state: DataFrame, answers: DataFrame, opinions: DataFrame, scale: DataFrame) -> DataFrame:
    """Results for blank items from their answers.

    Needs state (run_id, company_id, item_id, kind, status, flag, note_mode, non_negotiable,
    green_band, red_band), answers (company_id, item_id, answer), opinions by run and item. Answers
    that lead to no flag are not written: a blank never replaces a blank.
    """
    needed = ["run_id", "company_id", "item_id", "kind", "note_mode", "non_negotiable", "green_band", "red_band"]
    blanks = blank_targets(state).select(*needed)
    sized = scale.select("company_id", F.struct("net_worth", "revenue", "profit").alias("scale"))
    rows = (
        blanks.join(answers.select("company_id", "item_id", F.col("answer").alias("value")), ["company_id", "item_id"])
        .join(sized, "company_id", "left")
        .withColumns(
            {
                "evidence": F.lit(None).cast("string"), "series": F.expr("cast(null as array<string>)"),
                "from_web": F.lit(True),
            }
        )
    )
    flagged = C.assign_flags(rows, opinions, ["run_id", "item_id"]).filter(F.col("flag") != "NOT_AVAILABLE")
    none = F.lit(None).cast("string")
    return flagged.select(
        "run_id", "company_id", "item_id", "flag", "needs_review", "gate_pass", "rule_fired",
        "value",
        R.build_verdict(F.col("flag"), F.col("reason"), none, F.col("value"), F.col("kind"), F.lit(False)).alias("verdict"),
        F.when(F.col("needs_review"), "NEEDS_REVIEW").otherwise("DONE").alias("status"),
        P.provider_set(F.lit("research"), F.col("provider")).alias("provider"),
    )


def final_status(summary: DataFrame, audit_follows: bool = False) -> DataFrame:
    """Status of a run after a pass: a complete one waits in PROCESSING while an audit follows."""
    finished = "PROCESSING" if audit_follows else "DONE"
    return summary.withColumn("status", F.when(F.col("run_status") == "DONE", finished).otherwise("PARTIAL"))


audit = RS.audit_soften
