"""Streams over batches, retries, faults and restarts; the stores behind them."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flagstone.catalog import load_all
from flagstone.operators import quota
from flagstone.operators.state import current_state
from flagstone.streaming import jobs
from flagstone.streaming.arrivals import ArrivalIndex
from flagstone.streaming.store import KeyedStore

WRITE = "run_id string, item_id long, seq long, flag string"
KEYS = ["run_id", "item_id"]


def writes(spark, rows):
    return spark.createDataFrame(rows, WRITE)


def plain(df):
    return sorted(((r["run_id"] or "", r["item_id"], r["seq"], r["flag"], r["attempts"]) for r in df.collect()), key=str)


def some_batches(n, seed=1):
    r = random.Random(seed)
    seq = 0
    out = []
    for _ in range(n):
        rows = []
        for _ in range(r.randint(0, 12)):
            seq += 1
            rows.append((r.choice(["a", "b", "c", None]), r.randint(0, 4), seq if r.random() < 0.8 else seq - 100, r.choice("GR")))
        out.append(rows)
    return out


@pytest.mark.parametrize("fanout", [2, 3, 100])
def test_store_equals_one_fold_of_the_log(spark, tmp_path, fanout):
    batches = some_batches(11)
    store = KeyedStore(spark, str(tmp_path / "store"), KEYS, ["seq", "flag"], fanout)
    for n, rows in enumerate(batches):
        store.append(writes(spark, rows), n)
        store.append(writes(spark, rows), n)  # a retried batch
    whole = current_state(writes(spark, [x for rows in batches for x in rows]), KEYS, ["seq", "flag"])
    assert plain(store.read()) == plain(whole)
    levels = store.manifest()["levels"]
    assert all(len(level) < fanout for level in levels) and (fanout == 100) == (len(levels) == 1)
    before = plain(store.read())
    assert store.vacuum(keep=1) and plain(store.read()) == before and not store.vacuum(keep=1)


def test_store_of_two_sources_and_none(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), KEYS, ["seq"])
    with pytest.raises(ValueError, match="nothing was written"):
        store.read()
    store.append(writes(spark, [("a", 1, 1, "G")]), 0, "x")
    store.append(writes(spark, [("a", 1, 2, "R")]), 0, "y")
    assert plain(store.read()) == [("a", 1, 2, "R", 2)]


@pytest.mark.parametrize("step", ["write", "commit", "merge", "merge commit"])
def test_a_crash_between_two_steps_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    rows = some_batches(4, 5)
    store = KeyedStore(spark, str(tmp_path / "store"), KEYS, ["seq", "flag"], fanout=3)
    for n in (0, 1):
        store.append(writes(spark, rows[n]), n)
    before = plain(store.read())
    calls = {"write": 0, "commit": 0}
    write, commit = store._write, store.manifests.commit

    def failing(kind, real, at):
        def run(*a):
            calls[kind] += 1
            if calls[kind] == at:
                raise OSError("lost")
            return real(*a)

        return run

    kind, at = {"write": ("write", 1), "commit": ("commit", 1), "merge": ("write", 2), "merge commit": ("commit", 2)}[step]
    with monkeypatch.context() as m:
        m.setattr(store if kind == "write" else store.manifests, "_write" if kind == "write" else "commit", failing(kind, write if kind == "write" else commit, at))
        with pytest.raises(OSError, match="lost"):
            store.append(writes(spark, rows[2]), 2)
    other = KeyedStore(spark, str(tmp_path / "store"), KEYS, ["seq", "flag"], fanout=3)
    whole = lambda n: plain(current_state(writes(spark, [x for b in rows[:n] for x in b]), KEYS, ["seq", "flag"]))
    assert plain(other.read()) == (before if step in ("write", "commit") else whole(3))
    other.append(writes(spark, rows[2]), 2)
    other.append(writes(spark, rows[3]), 3)
    assert plain(other.read()) == whole(4)


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), KEYS, ["seq"])
    store.append(writes(spark, [("a", 1, 1, "G")]), 0)
    old = store.manifest()
    store.append(writes(spark, [("a", 1, 2, "R")]), 1)
    with pytest.raises(Exception, match="exist"):
        store.manifests.commit(old)
    assert plain(store.read()) == [("a", 1, 2, "R", 2)]


def test_a_lookup_by_key_reaches_the_files(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), KEYS, ["seq"])
    store.append(writes(spark, [("a", n, n, "G") for n in range(20)]), 0)
    found = store.read().filter("item_id = 7")
    assert "EqualTo(item_id,7)" in found._jdf.queryExecution().toString().replace(" ", "") and found.count() == 1


def test_result_writes_over_restarts(spark, tmp_path):
    batches = [b for b in some_batches(7, 9) if b]
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = KeyedStore(spark, str(tmp_path / "store"), KEYS, ["seq", "flag"], fanout=2)
    for rows in batches:
        writes(spark, rows).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_upsert(spark.readStream.schema(WRITE).parquet(source), store, check).awaitTermination()
    assert plain(store.read()) == plain(current_state(writes(spark, [x for rows in batches for x in rows]), KEYS, ["seq", "flag"]))


# streaks


def test_segments_fold_to_the_streaks(spark):
    r = random.Random(4)
    for oks in ([], [True], [False], [False] * 5, [True, False, False, True, False], [r.random() < 0.4 for _ in range(40)]):
        n, opened, closed, first, last = jobs.segment(np.array(oks, bool))
        good = [i + 1 for i, ok in enumerate(oks) if ok]
        assert (n, first, last) == (len(oks), good[0] if good else None, good[-1] if good else None)
        runs = "".join("x" if ok else "f" for ok in oks).split("x")
        assert (opened or 0) == len(runs[0]) and closed == max(map(len, runs[1:]), default=0)


def streaks(df):
    return {r["key"]: (r["calls"], r["longest"], r["tail"]) for r in df.collect()}


CALL = "key string, call_id long, ts timestamp, ok boolean"


@pytest.mark.parametrize("piece", ["hour", "day"])
def test_streaks_with_late_tied_and_retried_calls(spark, tmp_path, piece, monkeypatch):
    """Batches out of order within the horizon, a batch that fails at its end and runs again, states that run out."""
    r = random.Random(11)
    t0 = dt.datetime(2024, 3, 1)
    rows = [(r.choice(["k", "j", None]), n, t0 + dt.timedelta(minutes=r.randint(0, 30) + 40 * n), r.random() < 0.3) for n in range(180)]
    batches = [rows[i : i + 30] for i in range(0, 180, 30)]
    batches[2], batches[3] = batches[3], batches[2]
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = jobs.streak_store(spark, str(tmp_path / "store"), fanout=3)
    append, failed = store.append, []

    def fails_once(batch, batch_id):
        append(batch, batch_id)
        if batch_id == 3 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after the commit")

    states = []
    for own in batches:
        spark.createDataFrame(own, CALL).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            monkeypatch.setattr(store, "append", fails_once)
            query = jobs.stream_streaks(spark.readStream.schema(CALL).parquet(source), store, check, piece, "2 days")
            try:
                query.awaitTermination()
                states += [p["stateOperators"][0]["numRowsTotal"] for p in map(jobs._plain, query.recentProgress) if p["stateOperators"]]
                break
            except Exception:
                assert failed == [3]
    assert failed == [3]
    want = streaks(quota.streak_summary(spark.createDataFrame(rows, CALL)))
    assert streaks(jobs.read_streaks(store)) == want
    # pieces that the watermark has passed are no longer held
    assert states[-1] < store.read().count()


def test_segments_of_many_keys_at_once():
    r = np.random.default_rng(5)
    parts = [r.random(n) < p for n, p in ((1, 0.0), (1, 1.0), (7, 0.0), (30, 0.3), (12, 0.9), (5, 1.0))]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    got = jobs.segments(starts, np.concatenate(parts))
    for k, part in enumerate(parts):
        assert tuple(None if v[k] < 0 else int(v[k]) for v in got.values()) == jobs.segment(part)


def test_states_of_a_stream_do_not_grow_with_its_keys(spark, tmp_path):
    """Many keys share a state: 300 keys in two batches of one day hold at most as many states as there are buckets."""
    t0 = dt.datetime(2024, 3, 1)
    rows = [(None if k == 7 else f"k{k}", 3 * k + n, t0 + dt.timedelta(minutes=n), n == 1) for k in range(300) for n in range(3)]
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = jobs.streak_store(spark, str(tmp_path / "store"))
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, CALL).coalesce(1).write.mode("append").parquet(source)
        query = jobs.stream_streaks(spark.readStream.schema(CALL).parquet(source), store, check, buckets=4)
        query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(jobs._plain, query.recentProgress) if p["stateOperators"]]
    assert max(held) <= 4
    assert streaks(jobs.read_streaks(store)) == streaks(quota.streak_summary(spark.createDataFrame(rows, CALL)))


# the end of a stream


def test_watermark_is_the_border_of_what_a_stream_gives_out(spark, tables, monkeypatch):
    """A stream that loses one closed group, or all of them, no longer agrees with its batch twin."""
    whole = load_all()["stream_usage_daily"].run(tables).count()
    real = jobs.start_table
    seen = []

    def watched(*a, **kw):
        query = real(*a, **kw)
        seen.append(query)
        return query

    from flagstone.catalog import streams

    monkeypatch.setattr(streams.J, "start_table", watched)
    out = streams._appended(tables, jobs.stream_usage_daily(streams._stream(tables, "events", streams.CALL)), "usage")
    rows, border = out
    assert border is not None and 0 < rows.count() < whole
    monkeypatch.setattr(streams, "_appended", lambda *a: (rows.limit(rows.count() - 1), border))
    assert load_all()["stream_usage_daily"].run(tables).count() == whole - 1
    monkeypatch.setattr(streams, "_appended", lambda *a: (rows.limit(0), border))
    assert load_all()["stream_usage_daily"].run(tables).count() == whole - rows.count()


# arrivals

DOC = "run_id string, doc_id string, text string, at date"


def test_copies_across_batches_and_days(spark, tmp_path):
    r = random.Random(2)
    day = lambda n: dt.date(2024, 5, 1) + dt.timedelta(days=n)
    index = ArrivalIndex(spark, str(tmp_path / "index"), horizon_days=10, partitions=4, fanout=3)
    batches = [[(r.choice("ab"), f"{n}-{k}", r.choice([f"text {r.randint(0, 60)}", "", None]), day(n // 2)) for k in range(40)] for n in range(12)]
    seen, want = set(), []
    for n, rows in enumerate(batches):
        index.append(spark.createDataFrame(rows, DOC), n, "at")
        index.append(spark.createDataFrame(rows, DOC), n, "at")
        fresh = {(run, text) for run, _, text, _ in rows if text} - seen
        seen |= fresh
        want += fresh
    got = index.firsts().collect()
    assert len(got) == len(want)
    from hashlib import sha256

    assert {(x["run_id"], x["content_hash"]) for x in got} == {(run, sha256(t.encode()).hexdigest()) for run, t in want}
    assert all(len(runs) < 3 for runs in index.manifest()["days"].values())
    # the first day is aged out: its texts count as new again, and its files can go
    index.append(spark.createDataFrame([("a", "z", batches[0][0][2] or "text 0", day(40)), ("a", "y", "never", day(40))], DOC), 12, "at")
    assert list(index.manifest()["days"]) == [day(40).isoformat()]
    assert index.vacuum() and not index.vacuum()
    index.append(spark.createDataFrame([("a", "x", "never", day(41)), ("b", "w", "never", day(41))], DOC), 13, "at")
    late = [x for x in index.firsts().collect() if x["day"] >= day(40)]
    assert sorted(x["doc_id"] for x in late) == ["w", "y", "z"]


def test_filters_have_no_false_negatives(spark, tmp_path):
    index = ArrivalIndex(spark, str(tmp_path / "index"), partitions=3)
    rows = spark.range(3000).select(F.lit("r").alias("run_id"), F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("2024-01-01").cast("date").alias("at"))
    index.append(rows, 0, "at")
    firsts = index.firsts()
    runs = [os.path.join(str(tmp_path / "index"), "filters", n) for own in index.manifest()["days"].values() for n in own]
    assert index._perhaps_seen(firsts, runs).count() == 3000
    other = firsts.withColumn("content_hash", F.sha2(F.concat("content_hash", F.lit("x")), 256))
    assert index._perhaps_seen(other, runs).count() < 60
