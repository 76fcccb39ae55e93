"""Nearest neighbours by inner product as a block matrix join.

Queries and candidates are dealt into blocks; every query block meets every candidate block once (a
tile). Vectors are quantised to int8 with a scale of their own, and a tile's products come from one
matrix product of small whole numbers (exact in float32 up to 1,040 dimensions at a time). With
x = x' + e, |x.y - x'.y'| <= |x'||e_y| + |e_x||y|, so each product has a lower and an upper bound. Pairs
whose upper bound is under the query's k-th best lower bound cannot be among its k; the others are
recomputed in double precision, added in the order of dimensions. A task keeps a heap of k per query
over its tiles; the heaps' contents meet in a last ranking of at most k rows per query and task.

Vectors keep their component type on the way (floats stay floats, all other numbers are doubles) and are brought to
a largest component of 1 before anything is squared. A row is sent once for each block of QUERY_BLOCK queries, a
query once for each block of BLOCK rows: N rows with N / 20 queries make N * N / 164,000 copies of a row, 6 tables'
worth at a million rows and 610 at a hundred million; larger blocks lower that and take memory in proportion.

Results are exact. Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without vec_id; vectors of different dimensions never meet.
Repeated query rows are one query; other rows of the query's own vec_id are left out with it; repeated
candidate rows count each. Products beyond the range of doubles are infinite; pairs whose sum is no number take no
part. Ties go to the smaller vec_id. Empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, BLOCK = 8192, 8192
#: Candidates of a tile that meet the queries at once.
SLICE = 1024
#: Products of scales between this and its inverse neither overflow nor lose digits that the bounds need.
LEAST_SCALE = 1e-280
#: Dimensions whose int8 products still add up exactly in float32.
EXACT_DIMS = 1040
PAIRS_AT_ONCE = 500_000
#: Covers the rounding of the bounds themselves.
SLACK = 1e-5


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantised:
    """Vectors over their largest component, as int8 values in float32, and the norms that the bounds need."""

    def __init__(self, vectors: np.ndarray) -> None:
        exact = vectors.astype(np.float64)
        self.exact = np.ascontiguousarray(exact.T)
        self.scale = np.abs(exact).max(1)
        unit = exact / self.scale[:, None]
        codes = np.rint(unit * 127)
        self.codes = codes.astype(np.int8).astype(np.float32)
        near = codes / 127
        self.near, self.off, self.norm = (np.sqrt((x * x).sum(1)) for x in (near, unit - near, unit))

    def part(self, rows: slice) -> Quantised:
        out = object.__new__(Quantised)
        out.exact, out.codes = self.exact[:, rows], self.codes[rows]
        out.scale, out.near, out.off, out.norm = (x[rows] for x in (self.scale, self.near, self.off, self.norm))
        return out


def products(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products; without limits where doubles overflow or lose their digits."""
    total = np.zeros((len(a.scale), len(b.scale)))
    for k in range(0, a.codes.shape[1], EXACT_DIMS):
        total += a.codes[:, k : k + EXACT_DIMS] @ b.codes[:, k : k + EXACT_DIMS].T
    total /= 127 * 127
    bound = np.outer(a.near, b.off) + np.outer(a.off, b.norm) + SLACK * np.outer(a.norm, b.norm)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        scale = np.outer(a.scale, b.scale)
        low, high = (total - bound) * scale, (total + bound) * scale
    unsafe = ~((scale > LEAST_SCALE) & (scale < 1 / LEAST_SCALE))
    if unsafe.any():
        low[unsafe], high[unsafe] = -np.inf, np.inf
    return low, high


def exact_products(a: Quantised, b: Quantised, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for s in range(0, len(rows), PAIRS_AT_ONCE):
        r, c = rows[s : s + PAIRS_AT_ONCE], cols[s : s + PAIRS_AT_ONCE]
        total = np.zeros(len(r))
        with np.errstate(over="ignore", invalid="ignore"):
            for x, y in zip(a.exact, b.exact, strict=True):
                total += x[r] * y[c]
        out[s : s + PAIRS_AT_ONCE] = total
    return out


class Heaps:
    """The best k of each query of one block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.k, self.q = ids, k, Quantised(vectors)
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        other = Quantised(vectors)
        for a in range(0, len(ids), SLICE):
            self._meet(ids[a : a + SLICE], other.part(slice(a, a + SLICE)))

    def _meet(self, ids: np.ndarray, other: Quantised) -> None:
        low, high = products(self.q, other)
        own = self.ids[:, None] == ids
        low[own] = -np.inf
        floor = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.best])
        if len(ids) > self.k:
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, 1)[:, len(ids) - self.k])
        rows, cols = np.nonzero((high >= floor[:, None]) & ~own)
        scores = exact_products(self.q, other, rows, cols)
        for r, score, vec in zip(rows.tolist(), scores.tolist(), ids[cols].tolist(), strict=True):
            if score != score:  # infinities of both signs add up to no number
                continue
            heap, item = self.best[r], (score, -vec)
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    def rows(self) -> pa.RecordBatch:
        sizes = [len(h) for h in self.best]
        flat = [x for h in self.best for x in h]
        scores, ids = (np.array([x[i] for x in flat], t) for i, t in ((0, np.float64), (1, np.int64)))
        return pa.record_batch([np.repeat(self.ids, sizes), -ids, scores], names=["query_id", "vec_id", "score"])


def _side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = rows.column("v").combine_chunks()
    return rows.column("id").to_numpy(), vectors.flatten().to_numpy().reshape(rows.num_rows, -1)


def _tiles(k: int):
    """Works off tiles sorted by dimension, query block, candidate block; queries come first in a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: Heaps | None = None
        at: tuple | None = None
        for tile, table in _whole_tiles(batches):
            side = table.column("candidate").to_numpy()
            queries, candidates = (table.filter(pa.array(side == s)) for s in (False, True))
            if not queries.num_rows:
                continue
            if heaps is None or tile[:2] != at:
                if heaps is not None:
                    yield heaps.rows()
                heaps, at = Heaps(*_side(queries), k), tile[:2]
            if candidates.num_rows:
                heaps.meet(*_side(candidates))
        if heaps is not None:
            yield heaps.rows()

    return run


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("dim", "qb", "cb")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                key = tuple(keys[a].tolist())
                if held and key != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
    if held:
        yield last, pa.Table.from_batches(held)


def nearest(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k nearest rows for each row for which ``queries`` holds."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = rows.filter(queries).select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).dropDuplicates(["id", "v"])
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    total = max(1, ceil(rows.count() / BLOCK))
    wanted = max(1, ceil(asked.count() / QUERY_BLOCK))
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(n)).cast("int")
    dim = F.size("v").alias("dim")
    left = asked.select(dim, block(wanted, 1).alias("qb"), places(total).alias("cb"), F.lit(False).alias("candidate"), "id", "v")
    right = rows.select(dim, places(wanted).alias("qb"), block(total, 2).alias("cb"), F.lit(True).alias("candidate"), "id", "v")
    tiles = left.union(right).repartition("dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb", "candidate")
    best = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
