"""Copies across arrivals: which texts of a run were there before, within a horizon of days.

Each arrival is told by its run and the hash of its text, which is worked out where the text is read; only run, hash,
day and the document's id travel. What has arrived is kept per day: a Bloom filter cut into partitions by
hash, and the exact hashes behind it. A batch asks the filters first, partition by partition; only what a
filter has perhaps seen is looked up among the exact hashes. Days that lie beyond the horizon leave the
manifest, so filters and hashes stay bounded by the arrivals of the horizon, and a copy that comes within the horizon
is never lost: a filter forgets nothing, and the exact hashes decide.

A batch is in the store when the manifest that names its files is renamed into place; a retried batch whose
number the manifest knows gives out nothing new.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.functions.text import fingerprint
from flagstone.streaming.store import Folder, Manifests

FIRSTS = "run_id string, content_hash string, doc_id string, day date"


def _places(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The bits of each hash, by double hashing of its two halves."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    step = (mixed >> np.uint64(33)) | np.uint64(1)
    return ((mixed[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) >> np.uint64(7)) % np.uint64(bits)


class ArrivalIndex:
    """First arrivals of texts. A filter has ``partitions`` parts of 16 bits or more a hash, asked at ``probes`` places; a
    day that has come in ``fanout`` runs is written anew as one."""

    def __init__(self, spark: SparkSession, root: str, horizon_days: int = 30, partitions: int = 64, probes: int = 5, fanout: int = 8) -> None:
        self.spark, self.horizon, self.partitions, self.probes, self.fanout = spark, horizon_days, partitions, probes, fanout
        self.folder = Folder(spark, root)
        self.manifests = Manifests(self.folder)

    def manifest(self) -> dict:
        return self.manifests.last({"batches": {}, "days": {}})

    def _folder(self, kind: str, name: str) -> str:
        return f"{self.folder.root}/{kind}/{name}"

    def _keyed(self, firsts: DataFrame) -> DataFrame:
        key = F.xxhash64("run_id", "content_hash")
        return firsts.withColumn("key", key).withColumn("part", F.pmod(key, F.lit(self.partitions)).cast("int"))

    def _perhaps_seen(self, firsts: DataFrame, filters: list[str]) -> DataFrame:
        """The rows of ``firsts`` that some day's filter holds."""
        probes = self.probes

        def ask(own: pa.Table, stored: pa.Table) -> pa.Table:
            seen = np.zeros(own.num_rows, bool)
            if own.num_rows and stored.num_rows:
                keys = own.column("key").to_numpy().view(np.uint64)
                for cell in stored.column("cells"):
                    flags = np.frombuffer(cell.as_buffer(), np.uint8)
                    at = _places(keys, 8 * len(flags), probes)
                    seen |= (flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1)
            return own.filter(pa.array(seen)).select(["run_id", "content_hash"])

        known = self.spark.read.schema("part int, cells binary").parquet(*filters)
        keyed = self._keyed(firsts).select("part", "key", "run_id", "content_hash")
        return keyed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(ask, "run_id string, content_hash string")

    def _filters_of(self, firsts: DataFrame) -> DataFrame:
        """A filter of each partition, built from all its hashes and sized by their number."""
        probes = self.probes

        def build(own: pa.Table) -> pa.Table:
            keys = own.column("key").to_numpy().view(np.uint64)
            flags = np.zeros(1 << max(10, (16 * len(keys)).bit_length()), bool)
            flags[_places(keys, len(flags), probes)] = True
            return pa.table({"part": pa.array([own.column("part")[0].as_py()], pa.int32()), "cells": [np.packbits(flags, bitorder="little").tobytes()]})

        return self._keyed(firsts).select("part", "key").groupBy("part").applyInArrow(build, "part int, cells binary")

    def _stored(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(FIRSTS).parquet(*[self._folder("hashes", r) for r in runs])

    def _write(self, firsts: DataFrame, run: str) -> str:
        firsts.write.parquet(self._folder("hashes", run))
        self._filters_of(self._stored([run])).write.parquet(self._folder("filters", run))
        return run

    def _within(self, days: dict[str, list[str]], newest: date | None) -> dict[str, list[str]]:
        """The days that lie within the horizon of the newest day, stored or just come."""
        known = [*map(date.fromisoformat, days), *([newest] if newest else [])]
        oldest = (max(known) - timedelta(days=self.horizon)).isoformat() if known else ""
        return {d: runs for d, runs in days.items() if d >= oldest}

    def append(self, batch: DataFrame, batch_id: int, day: str, source: str = "stream") -> None:
        """Arrivals with ``run_id``, ``doc_id``, ``text`` and the time column ``day``; empty texts are nobody's copies."""
        m = self.manifest()
        if batch_id <= m["batches"].get(source, -1):
            return
        text = F.col("text")
        hashed = batch.select(
            F.col("run_id").cast("string").alias("run_id"), F.when(text != "", fingerprint(text)).alias("content_hash"),
            F.col("doc_id").cast("string").alias("doc_id"), F.to_date(day).alias("day"),
        ).filter("content_hash is not null and day is not null")
        # one row for each text of a run, combined before it is sent
        firsts = hashed.groupBy("run_id", "content_hash").agg(F.min(F.struct("day", "doc_id")).alias("f"))
        firsts = firsts.select("run_id", "content_hash", "f.doc_id", "f.day")
        name = f"{batch_id:09d}-{uuid.uuid4().hex}"
        firsts.write.parquet(self._folder("asked", name))
        firsts = self.spark.read.schema(FIRSTS).parquet(self._folder("asked", name))
        days = self._within({k: list(v) for k, v in m["days"].items()}, firsts.agg(F.max("day")).first()[0])
        cells = [self._folder("filters", f) for own in days.values() for f in own]
        if cells:
            both = lambda a: F.col("run_id").eqNullSafe(F.col(f"{a}_run_id")) & (F.col("content_hash") == F.col(f"{a}_content_hash"))
            perhaps = self._perhaps_seen(firsts, cells).toDF("p_run_id", "p_content_hash")
            exact = self._stored([f for own in days.values() for f in own]).join(perhaps, both("p"), "left_semi")
            seen = exact.select("run_id", "content_hash").toDF("s_run_id", "s_content_hash")
            firsts = firsts.join(seen, both("s"), "left_anti")
        given = self._folder("given", f"{source}-{batch_id:09d}")
        firsts.write.mode("overwrite").partitionBy("day").parquet(given)
        new = self.spark.read.schema(FIRSTS).parquet(given)
        for d in sorted(r["day"].isoformat() for r in new.select("day").distinct().collect()):  # one row a day of the batch
            run = self._write(new.filter(F.col("day") == F.lit(d).cast("date")), f"{d}-{name}")
            days.setdefault(d, []).append(run)
            if len(days[d]) >= self.fanout:
                days[d] = [self._write(self._stored(days[d]), f"{d}-{uuid.uuid4().hex}")]
        self.manifests.commit({"version": m["version"], "batches": {**m["batches"], source: batch_id}, "days": days})

    def firsts(self) -> DataFrame:
        """All first arrivals given out: ``run_id``, ``content_hash``, ``doc_id``, ``day``."""
        names = self.folder.names("given")
        if not names:
            return self.spark.createDataFrame([], FIRSTS)
        rows = [self.spark.read.schema(FIRSTS).parquet(self._folder("given", n)) for n in names]
        return reduce(DataFrame.unionByName, rows)

    def vacuum(self) -> list[str]:
        """Remove filters and hashes that the manifest does not name, and what batches asked. Gives the names removed."""
        needed = {run for own in self.manifest()["days"].values() for run in own}
        gone = [f"{kind}/{n}" for kind in ("filters", "hashes", "asked") for n in self.folder.names(kind) if n not in needed]
        for name in gone:
            self.folder.remove(name)
        return gone
