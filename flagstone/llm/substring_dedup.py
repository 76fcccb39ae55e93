"""Substring dedup: words inside a 13-word window that also starts in a document of smaller doc_id go.

Pass 1, a count-min sketch in shards: every block of texts sends each shard the cells its windows fall
into, in two rows; a shard merges the counters of all blocks (0, 1, 2 or more) and answers each block
which of its cells were hit twice. Estimates are never too low, so no repeated window is lost; the
sketch grows with the input (``CELLS`` per shard and row, shards by total size) and is never sent whole.
Pass 2, exact: only windows estimated repeated go to their shard again, as 96 bits with the least
doc_id of their block; the shard finds the least doc_id of all and tells a block which of its windows
start in a smaller document. Blocks then cut the covered words out.

Copies of a whole text are found first: all windows of a later copy start in the first one, so later
copies take no part in the passes (they lose every word if they have 13 or more).

Defined cases. A null text has no words. A null doc_id counts as the largest. Rows of one doc_id never
remove each other's words. Ties cannot occur. Empty tables give empty results. Extra columns travel in
one struct. Long texts are one block with what else falls there, and are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import packed, text_of, written
from flagstone.llm.hashing import hash_spans, window_starts, windows, word_spans
from flagstone.llm.near_duplicates import BROADCAST_KEYS, keys_of
from flagstone.llm.words import chunks

WIDTH = 13
BLOCK_BYTES = 4_000_000
#: Marks rows whose text is null, beside the table's own columns.
NO_TEXT = "__no_text"
CELL_BITS = 24
CELLS = 1 << CELL_BITS
LAST_ID = (1 << 63) - 1
_LONG = 0xFFFF


def pack_cells(cells: np.ndarray) -> bytes:
    """Ascending cells as 16-bit steps; 0xFFFF is a step of that size without a cell."""
    steps = np.diff(cells, prepend=0)
    longs = steps // _LONG
    out = np.full(len(steps) + int(longs.sum()), _LONG, np.uint16)
    out[np.arange(len(steps)) + np.cumsum(longs)] = steps % _LONG
    return packed(out)


def unpack_cells(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != _LONG]


def member(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted array, -1 where it does not."""
    if not len(ascending):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return np.where(ascending[at] == values, at, -1)


class Windows:
    """The windows of some texts: two hashes, shard, cells, document."""

    def __init__(self, texts: pa.Array, shards: int, every: bool = True) -> None:
        data, first, end, self.offsets = word_spans(texts)
        words = hash_spans(data, first, end)
        self.data, self.first, self.end = data, first, end
        self.at, self.starts = window_starts(self.offsets, WIDTH)
        self.one = windows(words, WIDTH)[self.at] if len(self.at) else np.empty(0, np.uint64)
        if every:
            self.two = windows(words, WIDTH, 1)[self.at] if len(self.at) else np.empty(0, np.uint64)
            self.shard = ((self.one >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
            mask = np.uint64(CELLS - 1)
            self.cells = ((self.one & mask).astype(np.int64), (self.two & mask).astype(np.int64))

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def by_shard(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Runs of arrays that are already ordered by shard."""
    cuts = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=bool(cuts)):
        yield int(shard[a]), *(x[a:b] for x in arrays)


def _own(table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def _once(values: np.ndarray, most: int) -> np.ndarray:
    """An ascending array with at most ``most`` (1 or 2) of each value."""
    if len(values) <= most:
        return values
    keep = np.ones(len(values), bool)
    keep[most:] = values[most:] != values[:-most]
    return values[keep]


def _hit_cells(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                for block in np.unique(_own(part, "block")):
                    rows = part.filter(pa.array((_own(part, "block") == block) & ~part.column("later").to_numpy(zero_copy_only=False)))
                    w = Windows(rows.column("text"), shards)
                    keys = [np.sort(w.shard << CELL_BITS | c) for c in w.cells]
                    keys = [_once(k, 2) for k in keys]
                    a, b = ({s: pack_cells(k & (CELLS - 1)) for s, k in by_shard(k >> CELL_BITS, k)} for k in keys)
                    if a:
                        yield pa.record_batch(
                            [pa.array([*a], pa.int32()), pa.array([block] * len(a), pa.int32()), pa.array([*a.values()], pa.binary()),
                             pa.array([b[s] for s in a], pa.binary())], names=["shard", "block", "a", "b"],
                        )

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """All rows of a shard, shard by shard, from batches sorted by shard."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["shard"] != held[0]["shard"]:
                yield held[0]["shard"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["shard"], held


def _repeated_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the counters of all blocks of a shard; give each block its cells with a count of two or more."""
    for shard, rows in _shards(batches):
        answers = []
        for name in ("a", "b"):
            seen, twice = np.zeros(CELLS, bool), np.zeros(CELLS, bool)
            own = []
            for row in rows:
                cells = unpack_cells(row[name])
                twice[cells[1:][cells[1:] == cells[:-1]]] = True
                cells = _once(cells, 1)
                twice[cells[seen[cells]]] = True
                seen[cells] = True
                own.append(cells)
            answers.append([pack_cells(c[twice[c]]) for c in own])
        on = [i for i, (a, b) in enumerate(zip(*answers, strict=True)) if a and b]
        if on:
            yield pa.record_batch(
                [pa.array([rows[i]["block"] for i in on], pa.int32()), pa.array([shard] * len(on), pa.int32()),
                 pa.array([answers[0][i] for i in on], pa.binary()), pa.array([answers[1][i] for i in on], pa.binary())],
                names=["block", "shard", "a", "b"],
            )


def _candidates(shards: int):
    """A block's windows estimated repeated, once each, with the least doc_id and whether another follows."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("d", pa.binary()), ("more", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block, left = left.column("block")[0].as_py(), left.filter(pa.array(~left.column("later").to_numpy()))
        if not left.num_rows:
            return schema.empty_table()
        w = Windows(left.column("text").combine_chunks(), shards)
        on = np.ones(len(w.at), bool)
        for name, cells in zip(("a", "b"), w.cells, strict=True):
            hit = np.sort(np.concatenate([unpack_cells(x) | s << CELL_BITS for s, x in zip(right["shard"].to_pylist(), right[name].to_pylist(), strict=True)]))
            some = np.flatnonzero(on)
            on[some] = member(hit, w.shard[some] << CELL_BITS | cells[some]) >= 0
        docs = _own(left, "did")[w.documents()[on]]
        one, two, shard = w.one[on], w.two[on].astype(np.uint32), w.shard[on]
        order = np.lexsort((docs, two, one))
        one, two, shard, docs = one[order], two[order], shard[order], docs[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(one)) - 1 if len(one) else first
        more = docs[last] > docs[first]
        out = [(s, packed(h), packed(g), packed(d), packed(m)) for s, h, g, d, m in by_shard(shard[first], one[first], two[first], docs[first], more)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(columns[0], pa.int32()), pa.array([block] * len(out), pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], schema=schema)

    return run


def _least_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact groups of a shard's windows. Each block learns which of its windows start in a smaller document
    elsewhere (``all``), and which start first in its own document ``limits`` but in others of it too (``some``)."""
    for _, rows in _shards(batches):
        one, two, docs, more = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("h", np.uint64), ("g", np.uint32), ("d", np.int64), ("more", bool)))
        order = np.lexsort((docs, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        least = np.empty_like(docs)
        least[order] = docs[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
        gone, partly = least < docs, (least == docs) & more
        ends = np.cumsum([len(r["more"]) for r in rows])
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            whole, part = gone[a:b], partly[a:b]
            if whole.any() or part.any():
                h = one[a:b]
                yield pa.record_batch(
                    [pa.array([rows[i]["block"]], pa.int32()),
                     *(pa.array([packed(x)], pa.binary()) for x in (h[whole], h[part], docs[a:b][part]))], names=["block", "all", "some", "limits"],
                )


def _joined(table: pa.Table, column: str, dtype: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in table[column].to_pylist()] or [np.empty(0, dtype)])


def _cut(with_text: bool):
    """A block's rows with their counts, the hash of the words left, and the text left."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").combine_chunks()
        w = Windows(texts, 1, every=False)
        ids = _own(left, "did")[w.documents()]
        gone = member(np.sort(_joined(right, "all", np.uint64)), w.one) >= 0
        some, limits = _joined(right, "some", np.uint64), _joined(right, "limits", np.int64)
        order = np.argsort(some)
        at = member(some[order], w.one)
        inside = at >= 0
        gone[inside] |= ids[inside] > limits[order][at[inside]]
        cover = np.zeros(len(w.first) + 1, np.int32)
        np.add.at(cover, w.at[gone], 1)
        np.add.at(cover, w.at[gone] + WIDTH, -1)
        removed = np.cumsum(cover[:-1]) > 0
        counts = np.diff(w.offsets)
        for i in np.flatnonzero(left.column("later").to_numpy() & (counts >= WIDTH)):
            removed[w.offsets[i] : w.offsets[i + 1]] = True
        lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[w.offsets])
        sums, kept = [], []
        for i, text in enumerate(texts.to_pylist()):
            a, b = w.offsets[i], w.offsets[i + 1]
            words = text.split() if text else []
            if lost[i]:
                words = list(compress(words, ~removed[a:b]))
            sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if with_text:
                kept.append(_without(text, w.first[a:b], removed[a:b]).encode() if lost[i] else text)
        out = [left.column("row"), pa.array(counts), pa.array(lost), pa.array(sums, pa.string())]
        return pa.table([*out, pa.array(kept, pa.binary())] if with_text else out, names=["row", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])

    return run


def _without(text: bytes, first: np.ndarray, removed: np.ndarray) -> str:
    """The text without the removed words and the white space after each of them."""
    begins = first - first[0] + (len(text) - len(text.lstrip(b" \t\n\v\f\r")))
    ends = [*begins[1:].tolist(), len(text)]
    parts = [text[: begins[0]], *(text[a:b] for a, b, gone in zip(begins.tolist(), ends, removed.tolist(), strict=True) if not gone)]
    return b"".join(parts).decode("utf-8", "replace").rstrip(" \t\n\v\f\r")


def deduplicated(docs: DataFrame, columns: list[str], with_text: bool = False) -> DataFrame:
    """``row`` (the given columns), ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``text`` (binary; empty for null)."""
    text = text_of(F.col("text"))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # with fewer blocks than shuffle partitions the planner would deal the texts out a second time
    blocks = max(ceil(size / BLOCK_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, ceil(size / BLOCK_BYTES / 2))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), did.alias("did"), *keys_of(text), text.cast("binary").alias("text"))
    copies = docs.select(did.alias("did"), *keys_of(text)).groupBy("k1", "k2").agg(F.min("did").alias("first"), F.max("did").alias("last"))
    copies = written(copies.filter("first < last").select("k1", "k2", "first"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_KEYS else copies
    own = own.join(copies, ["k1", "k2"], "left")
    block = F.pmod(F.xxhash64("did", "k1"), F.lit(blocks)).cast("int")
    later = F.coalesce(F.col("first") < F.col("did"), F.lit(False))
    own = own.select(block.alias("block"), "row", "did", later.alias("later"), "text").repartition(blocks, "block")

    def per_shard(df: DataFrame, run, schema: str) -> DataFrame:
        return df.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)

    def per_block(df: DataFrame, run, schema: str) -> DataFrame:
        return own.groupBy("block").cogroup(df.groupBy("block")).applyInArrow(run, schema)

    hits = own.mapInArrow(_hit_cells(shards), "shard int, block int, a binary, b binary")
    repeated = per_shard(hits, _repeated_cells, "block int, shard int, a binary, b binary")
    candidates = per_block(repeated, _candidates(shards), "shard int, block int, h binary, g binary, d binary, more binary")
    found = per_shard(candidates, _least_documents, "block int, all binary, some binary, limits binary")
    fields = own.schema["row"].dataType.simpleString()
    return per_block(found, _cut(with_text), f"row {fields}, n_words long, n_removed long, kept_sha256 string" + ", text binary" * with_text)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of every row."""
    out = deduplicated(docs.select("doc_id", "text"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the repeated words cut out of ``text`` (and ``n_chars`` counted again)."""
    # the text goes through the blocks once, by itself and not in its row; a null is told by a mark
    others = [c for c in docs.columns if c != "text"]
    out = deduplicated(docs.withColumn(NO_TEXT, F.when(F.col("text").isNull(), True)), [*others, NO_TEXT], with_text=True)
    text = F.when(F.col(f"row.`{NO_TEXT}`").isNull(), F.col("text").cast("string"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
