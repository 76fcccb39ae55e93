"""Provider usage: counters, daily admission and failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.operators.ordering import numbered


def usage_daily(calls: DataFrame) -> DataFrame:
    """Requests and tokens of each provider and UTC day."""
    return calls.groupBy("provider", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")
    )


def daily_cap(provider: Column, caps: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, cap in caps.items():
        out = F.when(provider == name, cap).otherwise(out)
    return out


def admit_daily(
    calls: DataFrame, caps: dict[str, int] = fixed.DAILY_CAPS, default: int = fixed.DEFAULT_DAILY_CAP, piece: str = "minute"
) -> DataFrame:
    """The nth call of a provider's day is SERVED up to the cap, else DEFERRED.

    A busy provider's day is cut into pieces of time (`piece`, a unit that date_trunc knows), so no
    task sees more than one piece of one provider; narrower pieces serve bursts.
    """
    daily = calls.withColumn("day", F.to_date("ts"))
    placed = numbered(daily, ["provider", "day"], F.date_trunc(piece, "ts"), ["ts", "call_id"], "nth")
    admitted = F.col("nth") <= daily_cap(F.col("provider"), caps, default)
    return placed.withColumn("admission", F.when(admitted, "SERVED").otherwise("DEFERRED"))


def failure_streaks(calls: DataFrame, retire_at: int = fixed.RETIRE_AFTER) -> DataFrame:
    """Longest run of consecutive failures of each key, and whether it retires the key."""
    longest = streak_summary(calls).select("key", "calls", F.col("longest").alias("longest_streak"))
    return longest.withColumn("retired", F.col("longest_streak") >= retire_at)


def streak_summary(calls: DataFrame, piece: str = "hour") -> DataFrame:
    """Per key: calls, leading failures (head), trailing failures (tail) and the longest run.

    Positions inside a piece of time are exact; the pieces, one row each, are folded afterwards, so no task
    sees more than one piece (an hour by default) of one key.
    """
    inside = Window.partitionBy("key", "_piece").orderBy("ts", "call_id")
    row = (
        calls.withColumn("_piece", F.date_trunc(piece, "ts"))
        .withColumn("_pos", F.row_number().over(inside))
        .withColumn("_last_ok", F.max(F.when(F.col("ok"), F.col("_pos"))).over(inside))
    )
    pieces = row.groupBy("key", "_piece").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_last_ok").isNull(), F.col("_pos"))).alias("_open"),
        F.max(F.when(~F.col("ok"), F.col("_pos") - F.col("_last_ok"))).alias("_closed"),
        F.min(F.when(F.col("ok"), F.col("_pos"))).alias("_first_ok"),
        F.max("_last_ok").alias("_ok_at"),
    )
    return fold_pieces(pieces)


def fold_pieces(pieces: DataFrame) -> DataFrame:
    """The streaks of each key from its pieces of time in order.

    A piece says how many calls it has (`_n`), where its first and last success stand (`_first_ok`, `_ok_at`), the
    failures before the first (`_open`) and the longest run behind a success (`_closed`). A run that began earlier is
    carried in from the pieces before.
    """
    before = Window.partitionBy("key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumns(
        {"_ok_first": F.col("_start") + F.col("_first_ok"), "_ok_last": F.col("_start") + F.col("_ok_at")}
    )
    carried = placed.withColumn("_carry", F.col("_start") - F.coalesce(F.max("_ok_last").over(before), F.lit(0)))
    length = F.greatest(
        F.coalesce("_closed", F.lit(0)),
        F.when(F.col("_open").isNotNull(), F.col("_carry") + F.col("_open")).otherwise(F.lit(0)),
    )
    total = F.sum("_n")
    return carried.groupBy("key").agg(
        total.alias("calls"),
        F.coalesce(F.min("_ok_first") - 1, total).alias("head"),
        (total - F.coalesce(F.max("_ok_last"), F.lit(0))).alias("tail"),
        F.max(length).cast("bigint").alias("longest"),
    )
