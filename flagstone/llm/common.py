"""What several operators of this package share: words, written steps, text columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.session import scratch_dir

#: White space that separates words; every other character belongs to a word.
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(column: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(column, GAP), lambda w: w != F.lit(""))


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut, and the planner knows the true size."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def ragged_starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets of runs laid one after the other, the total last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
