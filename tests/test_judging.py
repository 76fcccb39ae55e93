"""Passes of questions to a judge: restart, caps over passes, answers that break the rules."""

import datetime
import glob
import uuid

import pandas as pd
import pytest

from flagstone.plans import judging
from flagstone.plans.stages import Stages

DAY = datetime.datetime(2024, 5, 1, 9)


def questions(spark, n, first=0):
    rows = [(i, "p", DAY + datetime.timedelta(seconds=i), f"text {i}", i, "A1", 0) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "call_id long, provider string, ts timestamp, text string, run_id long, item_id string, seq int")


def noting(folder):
    """A judge that leaves a file for every question it is asked."""

    def make():
        def answer(batch):
            for i in batch["call_id"]:
                open(f"{folder}/{i}-{uuid.uuid4().hex}", "w").close()
            return pd.DataFrame({"call_id": batch["call_id"], "flag": "GREEN", "reason": "fine"})

        return answer

    return make


def test_a_restarted_pass_asks_no_question_twice(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    asked = questions(spark, 40)
    root = str(tmp_path / "stages")

    class Stopping(Stages):
        def table(self, name, build):
            if name == "answers-2":
                raise RuntimeError("stopped")
            return super().table(name, build)

    with pytest.raises(RuntimeError):
        judging.ask(asked, noting(notes), Stopping(spark, root), caps={"p": 30})
    before = len(glob.glob(f"{notes}/*"))
    assert 0 < before < 30
    log = judging.ask(asked, noting(notes), Stages(spark, root), caps={"p": 30}).collect()
    names = [f.rsplit("/", 1)[1].split("-")[0] for f in glob.glob(f"{notes}/*")]
    assert sorted(map(int, names)) == list(range(30))
    assert sorted((r["call_id"], r["state"]) for r in log) == [(i, "ANSWERED" if i < 30 else "DEFERRED") for i in range(40)]


def test_calls_of_earlier_passes_count_and_answers_are_kept(spark, tmp_path):
    asked = questions(spark, 20)
    log = judging.ask(asked, noting(tmp_path), Stages(spark, str(tmp_path / "a")), caps={"p": 12}, rounds=1)
    more = judging.ask(asked.unionByName(questions(spark, 5, 100)), noting(tmp_path), Stages(spark, str(tmp_path / "b")), log, caps={"p": 15}, rounds=2)
    states = {r["call_id"]: r["state"] for r in more.collect()}
    assert set(states) == {*range(12, 20), *range(100, 105)}
    assert [c for c, s in sorted(states.items()) if s == "ANSWERED"] == [12, 13, 14]
    given = judging.opinions(log, asked).collect()
    assert len(given) == 12 and given[0].asDict().keys() == {"run_id", "item_id", "seq", "flag", "reason", "provider"}


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (lambda b: pd.DataFrame({"call_id": [1, 2, 2], "flag": "RED", "reason": "x"}), ["ANSWERED", "INVALID", "MISSING"]),
        (lambda b: pd.DataFrame({"call_id": [1, 2, 3, 9], "flag": ["RED", "red", None, "RED"], "reason": "x"}), ["ANSWERED", "INVALID", "INVALID"]),
        (lambda b: pd.DataFrame({"call_id": [1, 2, 3], "flag": "GREEN", "reason": ["x", None, " "]}), ["ANSWERED", "INVALID", "INVALID"]),
        (lambda b: pd.DataFrame({"call_id": [1, 2, 3], "flag": "GREEN"}), ["INVALID"] * 3),
        (lambda b: pd.DataFrame({"call_id": [], "flag": [], "reason": []}), ["MISSING"] * 3),
        (lambda b: 1 / 0, ["FAILED"] * 3),
    ],
)
def test_every_question_ends_in_one_state(answer, want):
    asked = pd.DataFrame({"call_id": [1, 2, 3], "provider": "p", "ts": DAY, "text": ["a", None, "c"]})
    log = judging.check_batch(asked, answer)
    assert list(log["call_id"]) == [1, 2, 3] and list(log["state"]) == want
    assert all((f is None) == (s != "ANSWERED") and (e is None) == (s == "ANSWERED") for s, f, e in zip(log["state"], log["flag"], log["error"], strict=True))


def test_no_questions_no_rows(spark, tmp_path):
    assert judging.ask(questions(spark, 1).limit(0), noting(tmp_path), Stages(spark, str(tmp_path / "s"))).count() == 0
