"""Questions to a judge that the user supplies: admitted by daily caps, asked in rounds, answers checked and logged.

The judge is a function that is called once in each task and gives the function that answers a batch, so a model or a
connection is set up once a task. What it gives back is not trusted: every question ends in exactly one logged state,
and an answer counts only if it has the right columns, one row and known values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.operators.quota import admit_daily
from flagstone.plans.stages import Stages

FLAGS = ("GREEN", "RED", "NEUTRAL")
#: ANSWERED counts; INVALID broke the schema, MISSING was not answered, FAILED is an error of the judge, DEFERRED had no room today.
LOG = "call_id bigint, provider string, ts timestamp, state string, flag string, reason string, error string"

#: A batch of questions (call_id and the caller's columns) to its answers (call_id, flag, reason).
Answer = Callable[[pd.DataFrame], pd.DataFrame]


def _state(answers: pd.DataFrame) -> tuple[str, str | None, str | None, str | None]:
    """State, flag, reason and error of one question from the rows that answer it."""
    if len(answers) != 1:
        return ("INVALID", None, None, f"answered {len(answers)} times") if len(answers) else ("MISSING", None, None, "no answer")
    flag, reason = answers["flag"].iloc[0], answers["reason"].iloc[0]
    if flag not in FLAGS:
        return "INVALID", None, None, f"unknown flag {flag!r}"
    if not isinstance(reason, str) or not reason.strip():
        return "INVALID", None, None, "no reason"
    return "ANSWERED", flag, reason, None


def check_batch(asked: pd.DataFrame, answer: Answer) -> pd.DataFrame:
    """One logged row for each question of a batch, whatever the judge does."""
    try:
        given = answer(asked.copy())
        missing = {"call_id", "flag", "reason"} - set(given.columns)
        fault = ("INVALID", None, None, f"columns missing: {', '.join(sorted(missing))}") if missing else None
    except Exception as e:  # noqa: BLE001  the judge is foreign code; its error is the question's state
        given, fault = None, ("FAILED", None, None, f"{type(e).__name__}: {e}")
    if fault is None:
        by_call = dict(tuple(given.groupby("call_id")))
        none = given.iloc[:0]
        states = [_state(by_call.get(c, none)) for c in asked["call_id"]]
    else:
        states = [fault] * len(asked)
    out = asked[["call_id", "provider", "ts"]].reset_index(drop=True)
    return out.join(pd.DataFrame(states, columns=["state", "flag", "reason", "error"], dtype=object))


def _asked(questions: DataFrame, judge: Callable[[], Answer]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = None
        for batch in batches:
            answer = answer or judge()
            yield check_batch(batch, answer)

    return questions.mapInPandas(run, LOG)


def ask(
    questions: DataFrame, judge: Callable[[], Answer], stages: Stages, earlier: DataFrame | None = None,
    caps: dict[str, int] = fixed.DAILY_CAPS, default: int = fixed.DEFAULT_DAILY_CAP, rounds: int = 4,
) -> DataFrame:
    """The log rows of a pass over questions (call_id bigint, unique and not null; provider; ts; what the judge reads).

    `earlier` is the log of passes before: an answered question is not asked again, and every call made that day counts
    against the cap of its provider (a null provider has a cap like any other). Who is admitted is
    settled in the first stage, and the second joins the texts to them once. They are then asked in rounds, each a stage
    of its own, so a pass that is started again asks only the rounds that are not whole; inside a round a lost task asks its own questions again. Deferred questions are logged without a call.
    A table without questions gives no rows.
    """
    spark = questions.sparkSession
    log = earlier if earlier is not None else spark.createDataFrame([], LOG)
    made = log.filter("state <> 'DEFERRED'")

    def admission() -> DataFrame:
        open_ = questions.join(log.filter("state = 'ANSWERED'").select("call_id").distinct(), "call_id", "left_anti")
        calls = open_.select("call_id", "provider", "ts", F.lit(1).alias("_new")).unionByName(
            made.select("call_id", "provider", "ts", F.lit(0).alias("_new"))
        )
        placed = admit_daily(calls, caps, default).filter("_new = 1")
        return placed.select("call_id", "provider", "ts", "admission")

    admitted = stages.table("admission", admission)
    turn = F.pmod(F.xxhash64("call_id"), F.lit(rounds)).alias("_turn")
    allowed = admitted.filter("admission = 'SERVED'").select("call_id", "provider", "ts", turn)
    served = stages.table("served", lambda: questions.drop("provider", "ts").join(allowed, "call_id"))
    of_round = lambda n: served.filter(F.col("_turn") == n).drop("_turn")
    parts = [stages.table(f"answers-{n}", lambda n=n: _asked(of_round(n), judge)) for n in range(rounds)]
    nothing = F.lit(None).cast("string")
    waiting = admitted.filter("admission = 'DEFERRED'").select(
        "call_id", "provider", "ts", F.lit("DEFERRED").alias("state"), nothing.alias("flag"), nothing.alias("reason"),
        F.lit("daily cap reached").alias("error"),
    )
    out = waiting
    for part in parts:
        out = out.unionByName(part)
    return out


def opinions(log: DataFrame, questions: DataFrame) -> DataFrame:
    """The answered questions as the opinions an assessment takes: run_id, item_id, seq, flag, reason, provider."""
    return questions.select("call_id", "run_id", "item_id", "seq").join(
        log.filter("state = 'ANSWERED'").select("call_id", "flag", "reason", "provider"), "call_id"
    ).drop("call_id")
