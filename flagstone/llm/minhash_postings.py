"""MinHash near-duplicates by an inverted join over signature coordinates.

1. A text's set holds its different shingles of three words, A-Z lower-cased. Texts of one set form a class. A
   class has ``COORDS`` MinHash values; each with its coordinate is a posting key.
2. Keys are counted over all classes. Two classes at the threshold agree in ``MATCHES`` keys or more (a pair at
   0.85 misses that with a chance below ``ESCAPE``), so with keys in one common order, rare ones first, they share
   one of the first COORDS - MATCHES + 1 of each. Keys of a single class come first and are skipped, so a class
   posts only the first (keys it shares - MATCHES + 1), and none if it shares too few.
3. Lists of postings are merged in tiles of bounded size: collisions are counted over the coordinates a dozen at
   a time, and a pair is skipped once it cannot reach MATCHES, when the sizes of its sets are too far apart,
   or when its classes already belong together.
4. First each class is posted under its rarest shared key only; the components found label the classes. Then all
   postings are merged, without the lists whose members have one label.
5. Pairs that reach MATCHES are confirmed on the full sets inside the tile, which gives out a row per member and
   its root, never a row per pair. Components of these links are the result.

Defined cases. A text of one or two words has its whole run of words as its only shingle; without words (null,
empty, blank) the set is empty, linked with nothing. Repeated rows are in one class. A null doc_id counts after
all others; a group of such rows alone has a null component_id. Empty tables give empty results. Only ``doc_id``
and ``text`` are read, so other columns never clash. Long texts are read whole, each handled alone. Shingles
are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import text_of, written
from flagstone.llm.components import label_components
from flagstone.llm.hashing import hash_spans, mix, whole, window_starts, windows, word_spans
from flagstone.llm.lexical_search import _groups as whole_groups
from flagstone.llm.words import chunks

SHINGLE, COORDS, STEP = 3, 48, 12
#: Similarity of at least 85 / 100, in whole numbers.
OVER, UNDER = 85, 100
ESCAPE = 1e-7
#: Members and shingles of one part of a list of postings; a tile holds two parts at most.
TILE, TILE_SHINGLES = 512, 2_000_000
#: A broadcast of text keys is checked against this many rows (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 2_000_000
LAST = (1 << 63) - 1

_ODD = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = mix(np.arange(3001, COORDS + 3001, dtype=np.uint64))


def matches_at(threshold: float, escape: float = ESCAPE) -> int:
    """The largest number of equal coordinates that a pair at the threshold misses with a chance of at most ``escape``."""
    chance = 0.0
    for m in range(COORDS + 1):
        chance += comb(COORDS, m) * threshold**m * (1 - threshold) ** (COORDS - m)
        if chance > escape:
            return m
    return COORDS


MATCHES = matches_at(OVER / UNDER)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The different shingle hashes of each text, in order."""
    data, first, end, offsets = word_spans(texts)
    capital = (data >= ord("A")) & (data <= ord("Z"))
    words = hash_spans(data + capital.astype(np.uint8) * np.uint8(32), first, end)
    at, starts = window_starts(offsets, SHINGLE)
    found = windows(words, SHINGLE)[at] if len(at) else np.empty(0, np.uint64)
    out = []
    for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
        if a < b:
            out.append(np.unique(found[a:b]))
        else:
            own = words[offsets[i] : offsets[i + 1]]
            out.append(np.array([whole(own)], np.uint64) if len(own) else own)
    return out


def posting_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of posting keys for each of some sets, none of them empty."""
    out = np.empty((len(starts), COORDS), np.uint64)
    values = np.empty_like(flat)
    for j in range(COORDS):
        np.multiply(flat, _ODD[j], out=values)
        out[:, j] = np.minimum.reduceat(values, starts)
    return mix(out ^ _SALT)


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.lit(23), text).alias("t1"), F.xxhash64(F.lit(29), F.length(text), text).alias("t2")]


def _signed(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, the text's key, ``size`` of its set, the set's key ``k1``, ``k2`` and its posting keys (null if empty)."""
    text = text_of(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(text), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column(3))
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                blank = pa.array(sizes == 0)
                k1, k2, at = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros(len(sets) + 1, np.int32)
                keys = np.empty(0, np.int64)
                if len(some):
                    flat = np.concatenate(sets)
                    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    keys = posting_keys(flat, starts).view(np.int64).ravel()
                    k1[some] = np.add.reduceat(mix(flat + np.uint64(1)), starts)
                    k2[some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
                    at[1:] = np.cumsum(sizes > 0) * COORDS
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys))
                k1, k2 = (pc.if_else(blank, pa.scalar(None, pa.int64()), pa.array(k.view(np.int64))) for k in (k1, k2))
                yield pa.record_batch([*[part.column(i) for i in range(3)], pa.array(sizes), k1, k2, lists], names=["doc_id", "t1", "t2", "size", "k1", "k2", "keys"])

    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, size long, k1 long, k2 long, keys array<long>")


def _prefixes(classes: DataFrame) -> DataFrame:
    """``cid``, ``size``, ``prefix``: the keys under which a class must be posted, rarest first; classes with none are left out."""
    postings = classes.select("cid", F.explode("keys").alias("key"))
    counts = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = postings.join(counts, "key").groupBy("cid").agg(F.collect_list(F.struct("n", "key")).alias("shared"))
    shared = shared.filter(F.size("shared") >= MATCHES)
    first = F.slice(F.sort_array("shared"), 1, F.size("shared") - (MATCHES - 1))
    return shared.select("cid", F.transform(first, lambda x: x["key"]).alias("prefix"))


TILE_KEY = ["key", "ta", "tb"]


def _tiled(members: DataFrame) -> DataFrame:
    """The members of each list with more than one label, dealt to tiles. From ``key``, ``cid``, ``size``, ``label``."""
    keys = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("cid")).alias("x1"), F.sum(F.col("cid").cast("decimal(38,0)")).alias("x2"),
    )
    # of lists with the same members one is merged
    once = keys.filter("low < high").groupBy("n", "total", "x1", "x2").agg(F.min("key").alias("key"))
    parts = F.ceil(F.greatest(F.col("n") / TILE, F.col("total") / TILE_SHINGLES)).cast("int")
    df = members.join(once.select("key", parts.alias("parts")), "key")
    df = df.select("key", "cid", "label", "parts", F.pmod(F.xxhash64("cid", "key"), F.col("parts")).cast("int").alias("part"))
    df = df.select("key", "cid", "label", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return df.select("key", F.least("part", "other").alias("ta"), F.greatest("part", "other").alias("tb"), "part", "cid", "label")


def _candidates(tile: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later members of another label that share MATCHES coordinates or more with it."""
    keys = np.frombuffer(tile.column("keys").combine_chunks().values.to_numpy(), np.int64).reshape(-1, COORDS)
    size, part, label = (tile.column(c).to_numpy() for c in ("size", "part", "label"))
    mixed = tile.column("ta")[0].as_py() != tile.column("tb")[0].as_py()
    for i in range(len(keys) - 1):
        on = (label[i + 1 :] != label[i]) & (UNDER * np.minimum(size[i + 1 :], size[i]) >= OVER * np.maximum(size[i + 1 :], size[i]))
        if mixed:
            on &= part[i + 1 :] != part[i]
        later = np.flatnonzero(on) + i + 1
        equal = np.zeros(len(later), np.int64)
        for a in range(0, COORDS, STEP):
            if not len(later):
                break
            equal = equal + (keys[later, a : a + STEP] == keys[i, a : a + STEP]).sum(1)
            able = equal + (COORDS - a - STEP) >= MATCHES
            later, equal = later[able], equal[able]
        if len(later):
            yield i, later


def _with_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each tile that are in a candidate pair there."""
    for tile in whole_groups(batches, TILE_KEY):
        on = np.zeros(tile.num_rows, bool)
        for i, later in _candidates(tile):
            on[i] = True
            on[later] = True
        if on.any():
            yield from tile.filter(pa.array(on)).to_batches()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a``, ``b``: each member with a link in its tile, and the root of the members linked with it."""
    for tile in whole_groups(batches, TILE_KEY):
        sets = shingle_sets(tile.column("text").combine_chunks())
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        mark, root, linked = np.zeros(len(ids) + 1, bool), np.arange(len(sets)), np.zeros(len(sets), bool)
        for i, later in _candidates(tile):
            later = later[root[later] != root[i]]
            if not len(later):
                continue
            mine = ids[begins[i] : begins[i + 1]]
            mark[mine] = True
            for j in later.tolist():
                if root[j] != root[i]:
                    shared = np.count_nonzero(mark[ids[begins[j] : begins[j + 1]]])
                    if UNDER * shared >= OVER * (sizes[i] + sizes[j] - shared):
                        root[root == root[j]] = root[i]
                        linked[i] = linked[j] = True
            mark[mine] = False
        if linked.any():
            cid = tile.column("cid").to_numpy()
            yield pa.record_batch([pa.array(cid[linked]), pa.array(cid[root[linked]])], names=["a", "b"])


def _by_tile(df: DataFrame) -> DataFrame:
    return df.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "part", "cid")


def _links(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Links between classes of different labels that share a list of postings: ``a``, ``b``."""
    tiled = _tiled(members).join(classes.select("cid", "t1", "t2", "size", "keys"), "cid")
    columns = ["key", "ta", "tb", "part", "cid", "label", "t1", "t2", "size", "keys"]
    schema = "key long, ta int, tb int, part int, cid long, label long, t1 long, t2 long, size long, keys array<long>"
    found = written(_by_tile(tiled.select(*columns)).mapInArrow(_with_candidates, schema), "candidates")
    asked = written(found.select("t1", "t2").distinct(), "candidate-texts")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    text = text_of(F.col("text"))
    texts = docs.select(*_text_keys(text), text.cast("binary").alias("text")).join(asked, ["t1", "t2"], "left_semi")
    texts = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    ready = found.join(texts, ["t1", "t2"]).select("key", "ta", "tb", "part", "cid", "label", "size", "keys", "text")
    return written(_by_tile(ready).mapInArrow(_confirmed, "a long, b long"), "links")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("node").alias("cid"), "label")
    return members.join(known, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``doc_id``, ``size``, ``k1``, ``k2``; and ``k1``, ``k2``, ``head`` (least doc_id of the group) of
    every class with several rows or a link."""
    rows = written(_signed(docs), "signed")
    some = rows.filter("size > 0").select("k1", "k2", "t1", "t2", "size", "keys", F.coalesce("doc_id", F.lit(LAST)).alias("first"))
    classes = some.groupBy("k1", "k2").agg(
        F.min("first").alias("first"), F.count("*").alias("n_rows"), F.min(F.struct("t1", "t2")).alias("t"), F.first("size").alias("size"), F.first("keys").alias("keys")
    )
    # the number is written with the class, so it stays the same whatever is worked out again
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "first", "n_rows", "t.*", "size", "keys"), "classes")
    posted = written(_prefixes(classes).join(classes.select("cid", "size"), "cid"), "prefixes")
    seeds = posted.select(F.get("prefix", F.lit(0)).alias("key"), "cid", "size", F.col("cid").alias("label"))
    labels = label_components(_links(docs, classes, seeds))
    members = written(_labelled(posted, labels), "labelled").select(F.explode("prefix").alias("key"), "cid", "size", "label")
    links = _links(docs, classes, members)
    over = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    between = links.join(over("a"), "a", "left").join(over("b"), "b", "left")
    between = between.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    outer = label_components(between).select(F.col("node").alias("label"), F.col("label").alias("above"))
    known = _labelled(classes.select("cid", "k1", "k2", "first", "n_rows"), labels).join(outer, "label", "left")
    known = written(known.withColumn("group", F.coalesce("above", "label")), "grouped")
    heads = known.groupBy("group").agg(F.min("first").alias("head"), F.sum("n_rows").alias("rows")).filter("rows > 1")
    return rows.select("doc_id", "size", "k1", "k2"), known.join(heads, "group").select("k1", "k2", "head")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least doc_id of the group), ``kept`` (it is the document's own)."""
    rows, heads = near_groups(docs)
    df = rows.join(heads, ["k1", "k2"], "left")
    head = F.when(F.col("head").isNull(), F.col("doc_id")).when(F.col("head") < LAST, F.col("head"))
    df = df.select("doc_id", F.col("size").alias("n_shingles"), head.alias("component_id"))
    return df.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
