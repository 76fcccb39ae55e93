"""Ranked lexical search over an index grouped by document length.

A document's normaliser m = 100 - 25 + (25 n N) div L depends on its length alone, so all documents of one m,
a stratum, give a term found tf times the same impact (10^9 tf) div (1000 tf + 12 m).

1. Documents are cut into terms once; those that some query asks for are kept with their tf.
2. Documents of one m make a stratum, a large stratum several blocks of bounded size. A block lists, for each
   term and each tf from the largest down, the documents that hold the term so often. Impacts are worked out
   once for each tf of a block. Blocks are written; every document with a term asked for is in one.
3. The impact of the largest tf of each term bounds the scores of a block. Each query first visits the block of
   its highest bound. Its ``top``-th score there is a threshold for all other blocks.
4. Every block is then met by all queries: among the blocks at hand each query visits them by falling bound and
   stops at the first bound below its threshold, which rises with what it finds. Tasks give out their best, the
   best of these are the result. Scores are exact 64-bit integers.

Queries are taken in blocks of at most ``QUERY_TERMS`` different terms (more only for one longer query); a block
of queries travels to the tasks, so its size, not the number of queries, bounds what is sent.

Defined cases. Texts that are null or without terms never match and do not count in N. A query without terms
has no rows. Equal scores go by doc_id, null last; repeated rows of documents each take a rank, repeated rows of
queries each get a result. Empty tables give no rows. Only the id and text columns are read, so others never
clash. Terms are compared by 64-bit hashes. Long texts are read whole, each handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flagstone.llm.common import text_of, written
from flagstone.llm.hashing import hash_spans, word_spans
from flagstone.llm.words import chunks, gather_runs

#: Different terms of the queries that are answered in one pass over the documents.
QUERY_TERMS = 1_000_000
#: Documents and postings of one block of the index.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1 << 19

_SPLITS = np.zeros(256, bool)
_SPLITS[:0x80] = True
for _first, _last in ("09", "AZ", "az"):
    _SPLITS[ord(_first) : ord(_last) + 1] = False

HITS = "doc_id long, n long, n_hits long, terms binary, tfs binary"
BLOCK = "m long, part int, ids array<long>, terms binary, tfs binary, runs binary, places binary"


def hashed_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of some texts, A-Z lower-cased, and where each text's terms start."""
    data, first, end, offsets = word_spans(texts, _SPLITS)
    capital = (data >= ord("A")) & (data <= ord("Z"))
    return hash_spans(data + capital.astype(np.uint8) * np.uint8(32), first, end), offsets


def _queries(items: DataFrame, item_id: str) -> DataFrame:
    """``item_id`` and the query's different ``terms`` with their numbers ``counts``; queries without terms are left out."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), text_of(F.col("text")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, offsets = hashed_terms(part.column(1))
                own = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(offsets, offsets[1:], strict=False)]
                names = ["item_id", "terms", "counts", "size"]
                yield pa.record_batch(
                    [part.column(0), pa.array([t.tobytes() for t, _ in own], pa.binary()), pa.array([c.astype(np.int64).tobytes() for _, c in own], pa.binary()),
                     pa.array([len(t) for t, _ in own], pa.int64())], names=names,
                )

    return rows.mapInArrow(run, "item_id long, terms binary, counts binary, size long").filter("size > 0")


class QueryBlock:
    """Some queries as arrays: the terms they ask for, and per query the places of its terms among these and their numbers."""

    def __init__(self, rows: list) -> None:
        self.ids = [r["item_id"] for r in rows]
        terms = np.concatenate([np.frombuffer(r["terms"], np.uint64) for r in rows])
        self.vocabulary, self.term = np.unique(terms, return_inverse=True)
        self.times = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
        self.starts = np.concatenate([[0], np.cumsum([r["size"] for r in rows])])

    def weighted(self, weights: np.ndarray) -> None:
        self.weight = self.times * weights[self.term]


def _hits(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """A row for each document with terms: their number ``n`` and, for terms of the vocabulary, place and tf."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, offsets = hashed_terms(part.column(1))
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                here = np.flatnonzero(vocabulary[at] == hashes)
                doc = np.searchsorted(offsets, here, side="right") - 1
                pairs, tfs = np.unique(doc * len(vocabulary) + at[here], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(vocabulary)).tolist()
                terms, tfs = (pairs % len(vocabulary)).astype(np.uint32), tfs.astype(np.uint32)
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                packed = [[x[cuts[i] : cuts[i + 1]].tobytes() for i in some] for x in (terms, tfs)]
                yield pa.record_batch(
                    [part.column(0).take(pa.array(some)), pa.array(n[some]), pa.array(np.diff(cuts)[some], pa.int64()), *[pa.array(p, pa.binary()) for p in packed]],
                    names=["doc_id", "n", "n_hits", "terms", "tfs"],
                )

    return rows.mapInArrow(run, HITS)


def _document_frequencies(hits: DataFrame, size: int) -> DataFrame:
    """``term`` (its place), ``df``; a row for each term found, so never more than the queries' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), minlength=size)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["term", "df"])

    return hits.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups, one after the other, from batches sorted by key."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and tuple(values[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(values[a])
    if held:
        yield pa.Table.from_batches(held)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: per term and falling tf the places of its documents among ``ids``."""
    for group in _groups(batches, ["m", "part"]):
        terms = np.frombuffer(b"".join(group.column("terms").to_pylist()), np.uint32)
        tfs = np.frombuffer(b"".join(group.column("tfs").to_pylist()), np.uint32)
        places = np.repeat(np.arange(group.num_rows, dtype=np.uint32), group.column("n_hits").to_numpy())
        order = np.lexsort((places, ~tfs, terms))
        terms, tfs, places = terms[order], tfs[order], places[order]
        first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])))
        runs = np.diff(np.append(first, len(terms))).astype(np.uint32)
        ids = pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), group.column("doc_id").combine_chunks())
        m, part = group.column("m")[0].as_py(), group.column("part")[0].as_py()
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (terms[first], tfs[first], runs, places)]
        yield pa.record_batch(
            [pa.array([m], pa.int64()), pa.array([part], pa.int32()), ids, *packed], names=["m", "part", "ids", "terms", "tfs", "runs", "places"]
        )


def build_index(hits: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The blocks of all documents with a term asked for, written."""
    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    found = hits.filter("n_hits > 0").select("doc_id", m.alias("m"), "n_hits", "terms", "tfs")
    size = found.groupBy("m").agg(F.count("*").alias("docs"), F.sum("n_hits").alias("postings"))
    size = size.select("m", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("postings") / BLOCK_POSTINGS)).cast("int").alias("parts"))
    dealt = found.join(size, "m").withColumn("part", F.pmod(F.xxhash64("doc_id", "terms"), F.col("parts")).cast("int")).drop("parts")
    dealt = dealt.repartition("m", "part").sortWithinPartitions("m", "part", F.asc_nulls_last("doc_id"))
    return written(dealt.select("doc_id", "m", "part", "n_hits", "terms", "tfs").mapInArrow(_blocked, BLOCK), "index")


class Stratum:
    """One block, unpacked: for each term its postings by falling tf, with their impacts."""

    def __init__(self, m: int, terms: bytes, tfs: bytes) -> None:
        self.terms, tf = np.frombuffer(terms, np.uint32), np.frombuffer(tfs, np.uint32)
        values, which = np.unique(tf, return_inverse=True)
        values = values.astype(np.int64)
        self.impacts = ((1_000_000_000 * values) // (1000 * values + 12 * m))[which]
        self.first = np.flatnonzero(np.append(True, self.terms[1:] != self.terms[:-1]))

    def bounds(self, queries: QueryBlock) -> np.ndarray:
        """The highest score a document of this block can have, for each query."""
        best = np.zeros(len(queries.vocabulary), np.int64)
        best[self.terms[self.first]] = self.impacts[self.first]
        return np.add.reduceat(queries.weight * best[queries.term], queries.starts[:-1])

    def open(self, runs: bytes, places: bytes, ids: pa.Array) -> None:
        runs = np.frombuffer(runs, np.uint32)
        self.places, self.impact = np.frombuffer(places, np.uint32), np.repeat(self.impacts, runs)
        ends = np.cumsum(runs)
        last = np.append(self.first[1:], len(runs)) - 1
        self.stop, self.n = ends[last].astype(np.int64), len(ids)
        self.start = np.append(0, self.stop[:-1])
        self.own = self.terms[self.first]
        self.known = ~np.isnan(ids.to_numpy(zero_copy_only=False).astype(float)) if ids.null_count else None
        self.ids = ids.fill_null(0).to_numpy()

    def scores(self, queries: QueryBlock, q: int, bound: int) -> np.ndarray:
        part = slice(queries.starts[q], queries.starts[q + 1])
        at = np.minimum(np.searchsorted(self.own, queries.term[part]), len(self.own) - 1)
        on = self.own[at] == queries.term[part]
        at, weight = at[on], queries.weight[part][on]
        lengths = self.stop[at] - self.start[at]
        places = gather_runs(self.places, self.start[at], lengths)
        parts = gather_runs(self.impact, self.start[at], lengths) * np.repeat(weight, lengths)
        if bound < 1 << 53:  # sums of doubles are exact
            return np.bincount(places, parts, self.n).astype(np.int64)
        out = np.zeros(self.n, np.int64)
        np.add.at(out, places, parts)
        return out


class Best:
    """The best documents a query has met: rows of (score, id, id is null), best first."""

    def __init__(self, top: int, least: int = 1) -> None:
        self.top, self.least = top, max(least, 1)
        self.score, self.id, self.null = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

    def add(self, scores: np.ndarray, stratum: Stratum) -> None:
        good = np.flatnonzero(scores >= self.least)
        if not len(good):
            return
        null = ~stratum.known[good] if stratum.known is not None else np.zeros(len(good), bool)
        score, ids, null = np.append(self.score, scores[good]), np.append(self.id, stratum.ids[good]), np.append(self.null, null)
        order = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.id, self.null = score[order], ids[order], null[order]
        if len(self.score) == self.top:
            self.least = max(self.least, int(self.score[-1]))

    def rows(self, q: int) -> Iterator[tuple]:
        for s, i, null in zip(self.score.tolist(), self.id.tolist(), self.null.tolist(), strict=True):
            yield q, None if null else i, s


def _first_blocks(index: DataFrame, queries: QueryBlock) -> DataFrame:
    """``q``, ``m``, ``part``: the block with the highest bound of each query that can match at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.zeros(len(queries.ids), np.int64), np.zeros((len(queries.ids), 2), np.int64)
        for batch in batches:
            for m, part, terms, tfs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                bounds = Stratum(m, terms, tfs).bounds(queries)
                more = bounds > best
                best[more], where[more] = bounds[more], (m, part)
        q = np.flatnonzero(best)
        yield pa.record_batch([pa.array(x) for x in (q, best[q], where[q, 0], where[q, 1])], names=["q", "bound", "m", "part"])

    found = index.select("m", "part", "terms", "tfs").mapInArrow(run, "q long, bound long, m long, part long")
    return found.groupBy("q").agg(F.max(F.struct("bound", "m", "part")).alias("b")).select("q", "b.m", "b.part")


def _visits(index: DataFrame, queries: QueryBlock, top: int, least: np.ndarray, only: dict[tuple[int, int], list[int]] | None) -> DataFrame:
    """``q``, ``doc_id``, ``score``: the best of each task. ``least`` has each query's threshold so far, ``only`` the
    queries that visit a block (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            at = [k for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if only is None or key in only]
            cell = lambda name, k: batch.column(batch.schema.get_field_index(name))[k]  # noqa: B023, E731
            strata = [Stratum(cell("m", k).as_py(), cell("terms", k).as_py(), cell("tfs", k).as_py()) for k in at]
            if not strata:
                continue
            bounds = np.stack([s.bounds(queries) for s in strata])
            if only is not None:
                for row, k in zip(bounds, at, strict=True):
                    others = np.ones(len(row), bool)
                    others[only[cell("m", k).as_py(), cell("part", k).as_py()]] = False
                    row[others] = 0
            for s, k in zip(strata, at, strict=True):
                s.open(cell("runs", k).as_py(), cell("places", k).as_py(), cell("ids", k).values)
            for q in np.flatnonzero((bounds >= least).any(0)).tolist():
                mine = best.setdefault(q, Best(top, int(least[q])))
                for k in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[k, q] < mine.least:
                        break
                    mine.add(strata[k].scores(queries, q, int(bounds[k, q])), strata[k])
        rows = [r for q, b in best.items() for r in b.rows(q)]
        q, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(x, pa.int64()) for x in (q, ids, scores)], names=["q", "doc_id", "score"])

    return index.mapInArrow(run, "q long, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)


def _answer(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """``q``, ``rank``, ``doc_id``, ``score`` of one block of queries."""
    queries = QueryBlock(rows)
    hits = written(_hits(docs, queries.vocabulary), "hits")
    n_docs, n_terms = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_frequencies(hits, len(queries.vocabulary))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(queries.vocabulary), np.int64)
    for r in df.select("term", weight.alias("w")).collect():  # no more rows than the block of queries has terms
        weights[r["term"]] = r["w"]
    queries.weighted(weights)
    index = build_index(hits, n_docs, max(n_terms, 1))
    only: dict[tuple[int, int], list[int]] = {}
    for r in _first_blocks(index, queries).collect():  # one row a query
        only.setdefault((r["m"], r["part"]), []).append(r["q"])
    least = np.ones(len(queries.ids), np.int64)
    first = _ranked(_visits(index, queries, top, least, only), top).filter(F.col("rank") == top)
    for r in first.select("q", "score").collect():
        least[r["q"]] = r["score"]
    names = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), "q long, item_id long")
    return _ranked(_visits(index, queries, top, least, None), top).join(names, "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20, item_id: str = "item_id") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` best documents of every query with a score above 0."""
    queries = written(_queries(items, item_id), "queries")
    blocks = max(1, -(-(queries.agg(F.sum("size")).first()[0] or 0) // QUERY_TERMS))
    out = []
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).collect()
        if rows:
            out.append(_answer(docs, rows, top))
    result = out[0] if out else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for more in out[1:]:
        result = result.unionByName(more)
    return result
