"""N-gram Jaccard join with Bayesian pruning: documents whose sets of five-word shingles reach 0.8.

1. Equal texts form a class; one of them stands for it. A class has 128 MinHash values.
2. Classes that agree in one of 20 bands of 3 values are candidates (a pair at 0.8 escapes all bands
   with a chance of 6e-7). Bands with the same members are looked at once.
3. A band's members are compared in tiles of bounded size. A pair belongs to the first band in which
   it agrees. MinHash values are compared 32 at a time; under a uniform prior the posterior for
   similarity s after m of n matches is Beta(m + 1, n - m + 1), and the pair is dropped once the chance
   of s >= 0.8 falls below ``TOLERANCE``.
4. The pairs left are verified exactly on their shingle sets, inside the tile: a tile gives out a row
   per member (links, and a root of its linked members), never a row per pair.
5. Connected components of the roots give the groups.

Shingles are runs of five words, unchanged; a text of one to four words has its whole run of words as
its only shingle. Defined cases. A text without words (null, empty, blank) is a group of its own
without links. Repeated rows are copies. A null doc_id counts after all others. Empty tables give
empty results. Extra columns travel in one struct and never clash. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import text_of, written
from flagstone.llm.components import label_components
from flagstone.llm.hashing import hashed_words, mix, whole, window_starts, windows
from flagstone.llm.words import chunks

SHINGLE, HASHES, STEP, BANDS, ROWS = 5, 128, 32, 20, 3
#: Similarity of at least 4 / 5, in whole numbers.
OVER, UNDER = 4, 5
TOLERANCE = 1e-9
#: Members and shingles of one part of a band key; a tile holds two parts at most.
TILE, TILE_SHINGLES = 512, 2_000_000
#: A broadcast of candidate keys is checked against this many rows (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 2_000_000

_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def least_matches(n: int, tolerance: float = TOLERANCE) -> int:
    """Fewest matches of n that leave a chance of at least ``tolerance`` that the similarity reaches the threshold."""
    t, chance = OVER / UNDER, 0.0
    for m in range(n + 1):
        chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if chance >= tolerance:
            return m
    return n


NEEDED = [least_matches(n) for n in range(STEP, HASHES + 1, STEP)]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of some texts, repeats included, and where each text's own start."""
    words, offsets = hashed_words(texts)
    at, starts = window_starts(offsets, SHINGLE)
    found = windows(words, SHINGLE)[at] if len(at) else np.empty(0, np.uint64)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        alone = np.array([whole(words[offsets[i] : offsets[i + 1]]) for i in short], np.uint64)
        found = np.insert(found, starts[short], alone)
        more = np.zeros(len(counts), np.int64)
        more[short] = 1
        starts = starts + np.concatenate([[0], np.cumsum(more)])
    return found, starts


def signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of MinHash values per text; texts without shingles get no use of theirs."""
    out = np.zeros((len(starts) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        low, begins = (found >> np.uint64(32)).astype(np.uint32), starts[some]
        values = np.empty_like(low)
        for j in range(HASHES):
            np.multiply(low, _A[j], out=values)
            values += _B[j]
            values ^= values >> np.uint32(15)
            values *= np.uint32(0x85EBCA6B)
            out[some, j] = np.minimum.reduceat(values, begins)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One key per text and band."""
    parts = sigs[:, : BANDS * ROWS].reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sigs), BANDS)).copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xD1342543DE82EF95) + parts[:, :, r] + np.uint64(r + 1))
    return keys.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text's key ``k1``, ``k2`` and its MinHash values; all but doc_id null for texts without words."""
    text = text_of(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), *keys_of(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found, starts = shingles(part.column(1))
                some = np.flatnonzero(np.diff(starts))
                sigs = signatures(found, starts)
                packed: list[bytes | None] = [None] * part.num_rows
                for i in some:
                    packed[i] = sigs[i].tobytes()
                blank = pa.array(np.diff(starts) == 0)
                k1, k2 = (pc.if_else(blank, pa.scalar(None, pa.int64()), part.column(c)) for c in (2, 3))
                yield pa.record_batch([part.column(0), k1, k2, np.diff(starts), pa.array(packed, pa.binary())], names=["doc_id", "k1", "k2", "size", "sig"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, size long, sig binary")


def keys_of(text: F.Column) -> list[F.Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(11), F.length(text), text).alias("k2")]


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
            at = np.repeat(np.arange(batch.num_rows), BANDS)
            k1, k2, size = (batch.column(i).to_numpy()[at] for i in (0, 1, 3))
            bands = np.tile(np.arange(BANDS, dtype=np.int32), len(sigs))
            yield pa.record_batch([band_keys(sigs).ravel(), bands, k1, k2, size], names=["key", "band", "k1", "k2", "size"])

    return classes.select("k1", "k2", "sig", "size").mapInArrow(run, "key long, band int, k1 long, k2 long, size long")


def _tiled(bands: DataFrame) -> DataFrame:
    """The members of every band key with two or more, dealt to tiles of bounded size."""
    total = F.sum("size").alias("total")
    keys = bands.groupBy("key", "band").agg(F.count("*").alias("n"), total, F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2")).filter("n > 1")
    # the first of all bands with the same members stands for the others
    once = keys.groupBy("n", "total", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("b")).select("b.key", "n", "total")
    members = bands.join(once, "key")
    parts = F.ceil(F.greatest(F.col("n") / TILE, F.col("total") / TILE_SHINGLES)).cast("int")
    members = members.select("key", "band", "k1", "k2", parts.alias("parts"), F.pmod(F.xxhash64("k2", "k1"), parts).cast("int").alias("part"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    members = members.select("key", "band", "k1", "k2", "part", other)
    return members.select("key", "band", F.least("part", "other").alias("ta"), F.greatest("part", "other").alias("tb"), "part", "k1", "k2")


TILE_KEY = ["key", "ta", "tb"]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles, one after the other, from batches sorted by tile."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in TILE_KEY], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def _survivors(tile: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later members it is still a candidate with, after ownership and Bayesian pruning."""
    sigs = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
    band, ta, tb = (tile.column(c)[0].as_py() for c in ("band", "ta", "tb"))
    keys, part = band_keys(sigs), tile.column("part").to_numpy()
    everyone = np.arange(len(sigs))
    for i in range(len(sigs) - 1):
        later = everyone[i + 1 :] if ta == tb else everyone[i + 1 :][part[i + 1 :] != part[i]]
        same = keys[later, : band + 1] == keys[i, : band + 1]
        later = later[same[:, band] & ~same[:, :band].any(1)]
        matches = np.zeros(len(later), np.int64)
        for s, needed in enumerate(NEEDED):
            if not len(later):
                break
            cut = slice(s * STEP, (s + 1) * STEP)
            matches = matches + (sigs[later, cut] == sigs[i, cut]).sum(1)
            later, matches = later[matches >= needed], matches[matches >= needed]
        if len(later):
            yield i, later


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each tile that still have a candidate there."""
    for tile in _tiles(batches):
        on = np.zeros(tile.num_rows, bool)
        for i, later in _survivors(tile):
            on[i] = True
            on[later] = True
        if on.any():
            yield from tile.filter(pa.array(on)).to_batches()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of a tile's candidates: links per member (in rows) and the root of its linked members."""
    for tile in _tiles(batches):
        found, starts = shingles(tile.column("text").combine_chunks())
        _, ids = np.unique(found, return_inverse=True)
        sets = [np.unique(ids[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        sizes = np.array([len(s) for s in sets])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        flat, mark = np.concatenate(sets), np.zeros(len(ids) + 1, bool)
        copies, links, root = tile.column("n_rows").to_numpy(), np.zeros(len(sets), np.int64), np.arange(len(sets))
        for i, later in _survivors(tile):
            mark[sets[i]] = True
            if 4 * len(later) > len(sets):
                shared = np.add.reduceat(mark[flat], begins[:-1], dtype=np.int64)[later]
            else:
                shared = np.array([np.count_nonzero(mark[sets[j]]) for j in later])
            mark[sets[i]] = False
            near = later[UNDER * shared >= OVER * (sizes[i] + sizes[later] - shared)]
            links[i] += copies[near].sum()
            links[near] += copies[i]
            for r in np.unique(root[near]):
                root[root == r] = root[i]
        k1, k2 = tile.column("k1").to_numpy(), tile.column("k2").to_numpy()
        on = links > 0
        if on.any():
            yield pa.record_batch([k1[on], k2[on], links[on], k1[root[on]], k2[root[on]]], names=["k1", "k2", "links", "r1", "r2"])


def _by_tile(df: DataFrame) -> DataFrame:
    return df.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "part", "k1", "k2")


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``links`` and ``r1``, ``r2``, one row for each tile in which a class has links."""
    tiled = _tiled(_bands(classes)).join(classes.select("k1", "k2", "sig", "n_rows"), ["k1", "k2"])
    tiled = tiled.select("key", "band", "ta", "tb", "part", "k1", "k2", "sig", "n_rows")
    schema = "key long, band int, ta int, tb int, part int, k1 long, k2 long, sig binary, n_rows long"
    candidates = written(_by_tile(tiled).mapInArrow(_pruned, schema), "candidates")
    keys = written(candidates.select("k1", "k2").distinct(), "candidate-keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    text = text_of(F.col("text"))
    texts = docs.select(*keys_of(text), text.cast("binary").alias("text")).join(keys, ["k1", "k2"], "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    ready = _by_tile(candidates.join(texts, ["k1", "k2"]))
    return written(ready.mapInArrow(_verified, "k1 long, k2 long, links long, r1 long, r2 long"), "links")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as ``doc_id``, ``k1``, ``k2``; and for each text its links, its copies, its group's least
    doc_id (``head``) and whether it is the text that stands for the group."""
    rows = written(_signed(docs), "signed")
    each = rows.filter("k1 is not null").groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    first = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"))
    classes = each.groupBy("k1", "k2").agg(F.min(first).alias("f"), F.sum("n").alias("n_rows"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = written(classes.select("k1", "k2", F.col("f.d").alias("first"), "n_rows", "size", "sig"), "classes")
    links = linked_classes(docs, classes)
    edges = links.select(F.struct("k1", "k2").alias("a"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("b"))
    labels = label_components(edges).select("node.k1", "node.k2", "label")
    counted = links.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    known = classes.select("k1", "k2", "first", "n_rows").join(labels, ["k1", "k2"], "left").join(counted, ["k1", "k2"], "left")
    known = known.withColumn("label", F.coalesce("label", F.struct("k1", "k2")))
    heads = known.groupBy("label").agg(F.min(F.struct("first", "k1", "k2")).alias("head"))
    known = known.join(heads, "label").select(
        "k1", "k2", F.coalesce("links", F.lit(0)).alias("links"), "n_rows", F.col("head.first").alias("head"),
        ((F.col("head.k1") == F.col("k1")) & (F.col("head.k2") == F.col("k2"))).alias("stands"),
    )
    return rows.select("doc_id", "k1", "k2"), known


def join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (least doc_id of the group), ``n_links`` (documents at 0.8 or more, copies included), ``n_copies``."""
    rows, known = grouped(docs)
    known = written(known, "groups")
    head = F.when(F.col("head") < (1 << 63) - 1, F.col("head"))
    return rows.join(known, ["k1", "k2"], "left").select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(head).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("n_rows", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("n_rows", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document left of each group: that of the least doc_id."""
    _, known = grouped(docs)
    go = written(known.filter(~F.col("stands") | (F.col("n_rows") > 1)), "going")
    text = text_of(F.col("text"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys_of(text))
    go = F.broadcast(go) if go.count() <= BROADCAST_KEYS else go
    own = own.join(go.select("k1", "k2", "stands", "head", "n_rows"), ["k1", "k2"], "left")
    this = F.coalesce(F.col("row.doc_id").cast("long"), F.lit((1 << 63) - 1)) == F.col("head")
    own = own.filter(F.col("stands").isNull() | (F.col("stands") & this))
    # only rows that repeat a doc_id with its text are still more than one
    alone = own.filter(F.col("stands").isNull()).select("row")
    several = own.filter(F.col("stands")).select("k1", "k2", "row", F.xxhash64("row").alias("order"))
    several = several.groupBy("k1", "k2").agg(F.min_by("row", "order").alias("row")).select("row")
    return alone.union(several).select("row.*")
