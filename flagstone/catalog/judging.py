"""A pass of questions to a judge. The judge here is a list of words that stands where a user's own would."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.catalog.registry import query
from flagstone.plans.judging import Answer, ask
from flagstone.plans.stages import Stages
from flagstone.session import scratch_dir
from flagstone.sources.bindings import FINDINGS, Tables, case_text

CAP = 2
#: One question an order, worded like the findings.
_ORDER = "o_orderkey AS call_id, 'opinion' AS provider, CAST(o_orderdate AS TIMESTAMP) AS ts, o_custkey AS l_quantity, o_totalprice AS l_extendedprice"
_QUESTION = ["call_id", "provider", "ts", f"{case_text('call_id', FINDINGS['opinion'])} AS text"]
#: Words -> flag; MAYBE is not a flag, so such answers must be refused.
_WORDS = [("a qualified", "RED"), ("Adverse", "RED"), ("true and fair", "GREEN"), ("Fee of", "MAYBE")]


def word_judge() -> Answer:
    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        read = batch[~batch["text"].str.contains("Nothing was said", regex=False)]
        flags = pd.Series("NEUTRAL", index=read.index)
        for words, flag in reversed(_WORDS):
            flags[read["text"].str.contains(words, regex=False)] = flag
        return pd.DataFrame({"call_id": read["call_id"], "flag": flags, "reason": "read: " + read["text"]})

    return answer


def judged(t: Tables) -> DataFrame:
    questions = t.raw("orders").selectExpr(*_ORDER.split(", ")).selectExpr(*_QUESTION)
    stages = Stages(t.spark, scratch_dir(t.spark, "judging"))
    return ask(questions, word_judge, stages, caps={"opinion": CAP})


_FLAG = "CASE " + " ".join(f"WHEN text LIKE '%{w}%' THEN '{f}'" for w, f in _WORDS) + " ELSE 'NEUTRAL' END"
JUDGED_SQL = f"""
WITH q AS (SELECT {", ".join(_QUESTION)} FROM (SELECT {_ORDER} FROM orders)),
placed AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, call_id) AS nth, {_FLAG} AS said FROM q),
judged AS (SELECT *, CASE WHEN nth > {CAP} THEN 'DEFERRED' WHEN text LIKE '%Nothing was said%' THEN 'MISSING'
    WHEN said = 'MAYBE' THEN 'INVALID' ELSE 'ANSWERED' END AS state FROM placed)
SELECT call_id, state, CASE WHEN state = 'ANSWERED' THEN said END AS flag, CASE WHEN state = 'ANSWERED' THEN 'read: ' || text END AS reason,
    CASE state WHEN 'DEFERRED' THEN 'daily cap reached' WHEN 'MISSING' THEN 'no answer' WHEN 'INVALID' THEN 'unknown flag ''MAYBE''' END AS error
FROM judged
"""


@query("judge_log", JUDGED_SQL)
def judge_log(t: Tables) -> DataFrame:
    return judged(t).select("call_id", "state", "flag", "reason", "error")


@query("judge_states", f"SELECT state, count(*) AS calls FROM ({JUDGED_SQL}) GROUP BY 1")
def judge_states(t: Tables) -> DataFrame:
    return judged(t).groupBy("state").agg(F.count(F.lit(1)).alias("calls"))
