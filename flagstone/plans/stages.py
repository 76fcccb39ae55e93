"""Stages of a job kept as tables, so that a job that was stopped goes on behind its last whole stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flagstone.streaming.store import Folder


class Stages:
    """Named stages below one folder that every executor reaches.

    A stage is whole once Spark's commit has left its mark there; a stage without the mark is written again over
    whatever a stopped writer left. A folder belongs to one pass over one input: another pass takes another folder.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self._folder = spark, Folder(spark, root)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        at = f"{self._folder.root}/{name}"
        if not self.whole(name):
            build().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def whole(self, name: str) -> bool:
        return "_SUCCESS" in self._folder.names(name)
