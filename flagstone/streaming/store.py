"""A store of keyed rows that streams write to, as levels of sorted runs behind a manifest.

Every batch is folded to one row per key (the last write, and how many writes there were) and written as a run of
level 0. When a level holds ``fanout`` runs they are merged into one run of the next level, so a row is rewritten
once per level and a read meets fewer than ``fanout`` runs on each of a few levels. Which runs count is said by
the manifest alone: a numbered file, written under another name and renamed. Whatever stops a writer between two steps
leaves the manifest as it was, and runs that no manifest names are never read. A batch whose number the manifest
knows is not written again, so a retried batch changes nothing and the number of writes stays exact.

One writer at a time: a second one fails at the rename, as the next manifest is there already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.operators.state import current_state


class Folder:
    """Small files of a folder that only Spark's file systems may reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, content: str) -> None:
        """The file appears whole or not at all; one that is there already is an error."""
        hidden = self.path(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        final = self.path(name)
        self._fs.mkdirs(final.getParent())
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        context.rename(self._fs.makeQualified(hidden), self._fs.makeQualified(final), kinds)

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class Manifests:
    """Numbered manifests of a folder; the last one counts."""

    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def last(self, empty: dict) -> dict:
        names = self.folder.names("manifests")
        return json.loads(self.folder.read(f"manifests/{names[-1]}")) if names else {**empty, "version": -1}

    def commit(self, content: dict) -> dict:
        content = {**content, "version": content["version"] + 1}
        self.folder.create(f"manifests/{content['version']:012d}", json.dumps(content))
        return content


class KeyedStore:
    """The last write of each key. ``order`` says which write is later."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], fanout: int = 8) -> None:
        self.spark, self.keys, self.order, self.fanout = spark, list(keys), list(order), fanout
        self.folder = Folder(spark, root)
        self.manifests = Manifests(self.folder)

    def manifest(self) -> dict:
        return self.manifests.last({"batches": {}, "levels": [[]], "schema": None})

    def _runs(self, names: Sequence[str], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.folder.root}/runs/{n}" for n in names])

    def _folded(self, runs: DataFrame) -> DataFrame:
        payload = [c for c in runs.columns if c not in (*self.keys, "attempts")]
        last = F.max_by(F.struct(*payload), F.struct(*self.order)).alias("_row")
        return runs.groupBy(*self.keys).agg(last, F.sum("attempts").alias("attempts")).select(*self.keys, "_row.*", "attempts")

    def _write(self, df: DataFrame, level: int) -> str:
        name = f"L{level}-{uuid.uuid4().hex}"
        df.sortWithinPartitions(*self.keys).write.parquet(f"{self.folder.root}/runs/{name}")
        return name

    def append(self, batch: DataFrame, batch_id: int, source: str = "stream") -> None:
        """One batch of writes; a batch that is in the store already is passed over."""
        m = self.manifest()
        if batch_id <= m["batches"].get(source, -1):
            return
        folded = current_state(batch, self.keys, self.order)
        name = self._write(folded, 0)
        levels = [[*m["levels"][0], name], *m["levels"][1:]]
        schema = m["schema"] or T.StructType([T.StructField(f.name, f.dataType, True) for f in folded.schema]).json()
        self.manifests.commit({**m, "batches": {**m["batches"], source: batch_id}, "levels": levels, "schema": schema})
        self.compact()

    def compact(self) -> None:
        """Merge full levels; each merge is a step of its own, and the state is the same before and after it."""
        while True:
            m = self.manifest()
            full = next((k for k, runs in enumerate(m["levels"]) if len(runs) >= self.fanout), None)
            if full is None:
                return
            merged = self._folded(self._runs(m["levels"][full], m["schema"])).repartitionByRange(*self.keys)
            name = self._write(merged, full + 1)
            levels = [*m["levels"], []] if full + 1 == len(m["levels"]) else list(m["levels"])
            levels[full], levels[full + 1] = [], [*levels[full + 1], name]
            self.manifests.commit({**m, "levels": levels})

    def read(self) -> DataFrame:
        """Current rows with ``attempts``; filters on keys reach the files."""
        m = self.manifest()
        if m["schema"] is None:
            raise ValueError(f"nothing was written to {self.folder.root}")
        return self._folded(self._runs([n for level in m["levels"] for n in level], m["schema"]))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove runs that none of the last ``keep`` manifests names, and older manifests. Not while a read of an
        older state or a write is under way. Gives the names removed."""
        names = self.folder.names("manifests")
        last = [json.loads(self.folder.read(f"manifests/{n}")) for n in names[-keep:]]
        needed = {n for m in last for level in m["levels"] for n in level}
        gone = [f"runs/{n}" for n in self.folder.names("runs") if n not in needed] + [f"manifests/{n}" for n in names[:-keep]]
        for name in gone:
            self.folder.remove(name)
        return gone
