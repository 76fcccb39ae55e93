"""Periodic runs in the words of a text, found with suffix trees.

A run is a stretch of words with smallest period q and at least ``max(MIN_LENGTH, 2 q)`` words that no
neighbouring word extends. Per text:

1. In a run at least ``GRAM`` words in a row equal the words q later, and these stretches cover the run.
   So only words covered by a repeated ``GRAM``-word window are looked at, in stretches of at least
   ``MIN_LENGTH``; the windows are counted again inside the stretches until few words go. Counting by
   hash slots can keep a word too many and never loses one.
2. The stretches, each closed by a symbol of its own, go into one suffix tree, built by Ukkonen's
   algorithm, and reversed into a second one. The depths met on the Euler tour between two leaves answer
   the longest common extension of two places in constant time (sparse table of least depths).
3. Every run has a Lyndon root that is the longest Lyndon word at its place under the order of symbols or
   under the reversed order. These words end at the next smaller (greater) suffix. Each of them, two
   a place, is extended to the right and, by the reversed tree, to the left; what is long enough is a run.

Defined cases. A null or blank text has no words and no runs, and its text left is empty. Repeated rows each
give a row. Runs are listed by start, then period; equal ones cannot occur. No input rows, no output
rows. Of other columns only ``doc_id`` and ``text`` are read. Words are compared by 64-bit hashes. Whole
texts are read; a tree holds about 60,000 words of many texts, or one longer stretch of a single text
(some 500 bytes a word that lies in repeated windows, while that text is worked on).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import text_of
from flagstone.llm.hashing import hashed_words, mix, window_starts, windows
from flagstone.llm.words import chunks, gather_runs

MIN_LENGTH = 12
#: A run of period q has max(MIN_LENGTH - q, q) >= MIN_LENGTH / 2 words in a row that equal the words q later.
GRAM = MIN_LENGTH // 2
#: Words that share a suffix tree.
TREE_WORDS = 60_000

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def _suffix_tree(s: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Ukkonen's tree of ``s``, whose last symbol occurs once: children by ``node * width + symbol``, and where each
    node's edge label starts and ends in ``s``. Node 0 is the root; the leaf of suffix j is the j-th leaf made."""
    n, width = len(s), max(s) + 1
    child: dict[int, int] = {}
    first, end, link = [0], [0], [0]
    node = at = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        made = 0
        while waiting:
            if not length:
                at = i
            key = node * width + s[at]
            to = child.get(key)
            if to is None:
                child[key] = len(first)
                first.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                span = end[to] - first[to]
                if length >= span:
                    node, at, length = to, at + span, length - span
                    continue
                if s[first[to] + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(first)
                child[key] = inner
                first += (first[to], i)
                end += (first[to] + length, n)
                link += (0, 0)
                child[inner * width + c] = inner + 1
                first[to] += length
                child[inner * width + s[first[to]]] = to
                if made:
                    link[made] = inner
                made = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    return child, first, end, width


def _tour(s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For the Euler tour of the suffix tree, children by symbol: the rank of each suffix among the leaves, and the
    least depth passed between each leaf and the one before."""
    child, first, end, width = _suffix_tree(s)
    nodes = len(first)
    keys = np.fromiter(child.keys(), np.int64, len(child))
    to = np.fromiter(child.values(), np.int64, len(child))
    del child
    order = np.argsort(keys)
    parent, to = (keys // width)[order], to[order]
    begins = np.searchsorted(parent, np.arange(nodes + 1)).tolist()
    spans = (np.array(end) - np.array(first)).tolist()
    children = to.tolist()
    depth = [0] * nodes
    leaves, lows, low = [], [], 0
    # a node's children go onto the stack last first; all but the first child mark a turn at their parent
    stack, turns = [0], [-1]
    while stack:
        node, turn = stack.pop(), turns.pop()
        if turn >= 0:
            low = turn
        a, b = begins[node], begins[node + 1]
        if a == b:
            leaves.append(node)
            lows.append(low)
            continue
        d = depth[node]
        for k in range(b - 1, a - 1, -1):
            x = children[k]
            depth[x] = d + spans[x]
            stack.append(x)
            turns.append(d if k > a else -1)
    # leaves are made in the order of their suffixes
    ranks = np.empty(len(s), np.int64)
    ranks[np.argsort(np.argsort(np.array(leaves)))] = np.arange(len(s))
    return ranks, np.array(lows, np.int32)


class Extensions:
    """Longest common extensions of pairs of places of ``s``."""

    def __init__(self, s: list[int]) -> None:
        self.ranks, lows = _tour(s)
        self.levels = [lows]
        step = 1
        while 2 * step <= len(lows):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places ``a`` differ from places ``b``."""
        x, y = self.ranks[a], self.ranks[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            on = np.flatnonzero(level == k)
            table = self.levels[k]
            out[on] = np.minimum(table[low[on]], table[high[on] - (1 << k) + 1])
        return out


def _next_smaller(values: list[int]) -> np.ndarray:
    """The next place with a smaller value, or the length."""
    n = len(values)
    out, stack = [n] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start and period. The first and last symbol occur nowhere else."""
    s = symbols.tolist()
    n = len(s)
    ahead = Extensions(s)
    ranks = ahead.ranks
    at, to, right = [], [], []
    for order in (ranks, -ranks):
        end = _next_smaller(order.tolist())
        i = np.flatnonzero((end < n) & (np.arange(n) > 0))
        at.append(i)
        to.append(end[i])
        right.append(ahead(i, end[i]))
    i, j, right = (np.concatenate(x) for x in (at, to, right))
    del ahead
    # a root whose right end cannot lie in a run of two periods together with the longest left part is dropped later
    left = Extensions(s[::-1])(n - i, n - j)
    period, start, stop = j - i, i - left, j + right
    on = stop - start >= np.maximum(min_length, 2 * period)
    found = np.unique(np.stack([start[on], period[on], (stop - start)[on]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def repeated_stretches(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words that can hold runs; ``offsets`` says where texts start."""
    at, bounds = np.arange(len(hashes)), offsets
    while True:
        inside, starts = window_starts(bounds, GRAM)
        if not len(inside):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(starts))
        keys = mix(windows(hashes[at], GRAM)[inside] + mix(own + np.uint64(1)))
        slots = (keys >> np.uint64(64 - max(12, int(len(keys)).bit_length() + 2))).astype(np.int64)
        again = inside[np.bincount(slots)[slots] > 1]
        change = np.zeros(len(at) + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + GRAM, -1)
        covered = np.cumsum(change[:-1]) > 0
        covered[:1] &= len(at) > 0
        begin = covered.copy()
        begin[1:] &= ~covered[:-1]
        edges = bounds[(bounds > 0) & (bounds < len(at))]
        begin[edges] = covered[edges]
        first = np.flatnonzero(begin)
        # a stretch ends where covered words end or the next stretch begins
        closes = np.flatnonzero(covered & np.append(~covered[1:] | begin[1:], True)) + 1
        long = closes - first >= MIN_LENGTH
        first, closes = first[long], closes[long]
        lengths = closes - first
        before = len(at)
        if lengths.sum() > 0.9 * before:
            return at[first], at[closes - 1] + 1
        at = gather_runs(at, first, lengths)
        bounds = np.concatenate([[0], np.cumsum(lengths)])


def found_runs(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of some texts laid one after the other, by start and period."""
    first, end = repeated_stretches(hashes, offsets)
    out = []
    k = 0
    while k < len(first):
        m = int(np.searchsorted(np.cumsum(end[k:] - first[k:]), TREE_WORDS, side="right"))
        part = slice(k, k + max(m, 1))
        k = part.stop
        lengths = end[part] - first[part]
        words = gather_runs(hashes, first[part], lengths)
        values, ids = np.unique(words, return_inverse=True)
        # closing symbols lie between the stretches: place x of stretch j stands at x + j + 1
        stops = np.cumsum(lengths) + np.arange(len(lengths)) + 1
        symbols = np.empty(len(words) + len(lengths) + 1, np.int64)
        closing = np.zeros(len(symbols), bool)
        closing[0], closing[stops] = True, True
        symbols[closing] = len(values) + np.arange(len(lengths) + 1)
        symbols[~closing] = ids
        start, length, period = runs_of(symbols)
        j = np.searchsorted(stops, start)
        opens = np.concatenate([[0], stops[:-1]]) + 1
        out.append((start - opens[j] + first[part][j], length, period))
    if not out:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    return start, length, period


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def find_runs(docs: DataFrame, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``text``, the words left, joined by one space.

    ``order``, if given, says for a doc_id and its number of words which word stands at each place (None: as
    they are); the operator then works on the words so arranged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).cast("binary").alias("text"))

    def arranged(ids: list[int | None], offsets: np.ndarray) -> dict[int, np.ndarray]:
        moved = {}
        for i, (doc_id, n) in enumerate(zip(ids, np.diff(offsets).tolist(), strict=True)):
            places = order(doc_id, n) if order and n else None
            if places is not None:
                moved[i] = places
        return moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, offsets = hashed_words(part.column(1))
                moved = arranged(part.column(0).to_pylist(), offsets)
                for i, places in moved.items():
                    hashes[offsets[i] : offsets[i + 1]] = hashes[offsets[i] + places]
                start, length, period = found_runs(hashes, offsets)
                which = np.searchsorted(start, offsets)
                start = start - offsets[np.searchsorted(offsets, start, side="right") - 1]
                left = []
                for i, text in enumerate(part.column(1)):
                    words = text.as_py().split()
                    a, b = which[i], which[i + 1]
                    if i in moved:
                        words = [words[k] for k in moved[i].tolist()]
                    if a < b:
                        words = [words[k] for k in _kept(len(words), start[a:b], length[a:b], period[a:b]).tolist()]
                    left.append(b" ".join(words))
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.record_batch(
                    [part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(which, pa.int32()), runs), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "text"],
                )

    return rows.mapInArrow(run, SCHEMA)
