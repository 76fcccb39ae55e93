"""Order-dependent work that survives hot groups.

A window over one key puts the whole key in one task. Where the key may hold a third of all rows the
work is cut into pieces first: number or sum inside (key, piece), add the offset of the piece, which
is a window over a handful of rows per key. Top-k and latest-per-key need no such cut: row_number
under a constant limit is pruned before the exchange, and max_by combines on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each key. The constant limit lets Spark prune before shuffling."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order values of each key, by a map-side combined maximum."""
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the least order values of each key."""
    payload = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def numbered(
    df: DataFrame, keys: Sequence[str], piece: Column, order: Sequence[str], name: str = "position"
) -> DataFrame:
    """1-based position of each row in its key.

    `piece` must not decrease along the order (a time bucket, say), so positions inside a piece plus
    the rows of all earlier pieces give the position in the key. Null keys are a key like others and
    rows without a piece come first, so no row is lost.
    """
    cut = df.withColumn("_piece", piece)
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    placed = cut.withColumn("_in", F.row_number().over(inside))
    other = offsets.withColumnsRenamed({c: f"_o_{c}" for c in [*keys, "_piece"]})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*keys, "_piece"]])
    return (
        placed.join(other, same)
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_piece", "_in", "_before", *[f"_o_{c}" for c in [*keys, "_piece"]])
    )
