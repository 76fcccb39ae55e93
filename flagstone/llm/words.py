"""Words of Arrow batches, and tables of the words one worker has met."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flagstone.llm.common import ragged_starts
from flagstone.llm.hashing import hash_spans

#: Text handled at once inside a task; a longer single text is handled alone.
CHUNK_BYTES = 4_000_000
#: Values that ``Growing.keep`` moves at once; a longer single run is moved alone.
KEPT_AT_ONCE = 200_000


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most ``most`` bytes of text, or single longer rows."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + int(n) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def split_texts(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of some UTF-8 texts, and where each text's words start. ``bytes.split`` splits at ASCII white space."""
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split() if text else []
        counts[i] = len(own)
        words += own
    return words, ragged_starts(counts)


class WordTable:
    """Numbers for the words a worker has met; ``add`` works out what new ones stand for.

    Beyond ``limit`` words ``forget`` makes room, so memory stays bounded.
    """

    def __init__(self, limit: int = 800_000) -> None:
        self.limit = limit
        self.slot: dict[bytes, int] = {}

    def reset(self) -> None:
        """Forget what ``add`` has stored."""

    def forget(self) -> None:
        """Make room: everything is forgotten and met again."""
        self.slot.clear()
        self.reset()

    def add(self, words: list[bytes]) -> None:
        """Store results for new words, numbered on from those stored."""

    def index(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.slot)
        if new:
            if len(self.slot) + len(new) > self.limit and self.slot:
                self.forget()
                new = set(words).difference(self.slot)
            fresh = list(new)
            base = len(self.slot)
            self.add(fresh)
            self.slot.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))


def _all_equal(data: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the bytes of word ``other``: its length, first and last eight bytes, and all of a longer one."""
    size = end - first
    if (size != size[other]).any():
        return False
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    # the bytes of a short word stand at the high end of the eight that end with it
    short = np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64))
    tail, head = eight[end] >> short, eight[first + 8] << short
    if (tail != tail[other]).any() or (head != head[other]).any():
        return False
    long = np.flatnonzero((size > 16) & (other != np.arange(len(other))))
    mine, theirs = (gather_runs(data, first[x], size[x]) for x in (long, other[long]))
    return np.array_equal(mine, theirs)


class SpanTable:
    """Numbers for the words a worker has met, found by the hashes of their bytes; Python strings are made of new words only.

    A hash that is known counts as a hit only if the bytes agree too. Beyond ``limit`` words those not met since the
    last time are forgotten (all, if more than half were met), so memory stays bounded and common words stay.
    """

    def __init__(self, limit: int = 1_500_000) -> None:
        self.limit = limit
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bytes, self.begin, self.width, self.met = Growing(np.uint8), Growing(np.int64), Growing(np.int64), Growing(np.bool_)

    def add(self, words: list[bytes]) -> None:
        """Store results for new words, numbered on from those stored."""

    def keep(self, slots: np.ndarray) -> None:
        """Forget all results but those of ``slots``, which are numbered anew in this order."""

    def _forget(self) -> None:
        stay = np.flatnonzero(self.met.data[: self.met.size])
        if 2 * len(stay) > self.limit:
            stay = stay[:0]
        order = np.full(self.met.size, -1)
        order[stay] = np.arange(len(stay))
        on = order[self.slots] >= 0
        self.hashes, self.slots = self.hashes[on], order[self.slots[on]]
        begin, size = self.begin.data[stay], self.width.data[stay]
        data = gather_runs(self.bytes.data, begin, size)
        self.bytes, self.begin, self.width, self.met = Growing(np.uint8), Growing(np.int64), Growing(np.int64), Growing(np.bool_)
        self._store(data, size)
        self.met.data[: len(stay)] = False
        self.keep(stay)

    def _store(self, data: np.ndarray, size: np.ndarray) -> None:
        self.begin.extend(self.bytes.size + np.cumsum(size) - size)
        self.bytes.extend(data)
        self.width.extend(size)
        self.met.extend(np.ones(len(size), np.bool_))

    def index(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, words being spans of ``data``."""
        if not len(first):
            return np.empty(0, np.int64)
        hashes = hash_spans(data, first, end)
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])
        own = order[fresh]  # a word of each hash
        which = np.empty(len(hashes), np.int64)
        which[order] = np.cumsum(fresh) - 1
        distinct, begin, size = ranked[fresh], first[own], (end - first)[own]
        at = np.searchsorted(self.hashes, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        hit[inside] = self.hashes[at[inside]] == distinct[inside]
        if self.met.size + len(hit) - hit.sum() > self.limit and self.met.size:
            self._forget()
            at = np.searchsorted(self.hashes, distinct)
            inside, hit = at < len(self.hashes), np.zeros(len(distinct), bool)
            hit[inside] = self.hashes[at[inside]] == distinct[inside]
        slots = np.empty(len(distinct), np.int64)
        known = self.slots[at[hit]]
        slots[hit] = known
        self.met.data[known] = True
        mine = gather_runs(data, begin[hit], size[hit])
        same = self.width.data[known] == size[hit]
        alike = same.all() and np.array_equal(gather_runs(self.bytes.data, self.begin.data[known], size[hit]), mine)
        if not alike or not _all_equal(data, first, end, own[which]):
            return self._one_by_one(data, first, end)
        new = np.flatnonzero(~hit)
        if len(new):
            flat = data.tobytes()
            words = [flat[a:b] for a, b in zip(begin[new].tolist(), (begin[new] + size[new]).tolist(), strict=True)]
            slots[new] = self.met.size + np.arange(len(new))
            self.add(words)
            self._store(gather_runs(data, begin[new], size[new]), size[new])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.slots = np.insert(self.slots, at[new], slots[new])
        return slots[which]

    def _one_by_one(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words of which two have one hash: each gets a number of its own, which no later word is told by."""
        flat = data.tobytes()
        words = [flat[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        places = {w: i for i, w in enumerate(dict.fromkeys(words))}
        base = self.met.size
        self.add(list(places))
        self._store(np.frombuffer(b"".join(places), np.uint8), np.fromiter(map(len, places), np.int64, len(places)))
        return base + np.fromiter(map(places.__getitem__, words), np.int64, len(words))


class Growing:
    """A numpy array that is appended to. Up to ``reserve`` values nothing is copied to make room; what is reserved takes no memory before it is filled."""

    def __init__(self, dtype: type, reserve: int = 1024) -> None:
        self.data, self.size, self.reserve = np.empty(reserve, dtype), 0, reserve

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(need - len(self.data), len(self.data) // 4), self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need

    def keep(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Keep only the runs ``data[start : start + length]``, given in ascending order, and move them up in place, some at a time."""
        ends = ragged_starts(lengths)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], KEPT_AT_ONCE)), len(lengths))).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.data[ends[a] : ends[b]] = gather_runs(self.data, starts[a:b], lengths[a:b])
        self.size = int(ends[-1])
        if len(self.data) > self.reserve >= self.size:
            own, self.data = self.data, np.empty(self.reserve, self.data.dtype)
            self.data[: self.size] = own[: self.size]


def gather_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``data[start : start + length]`` laid one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return data[:0]
    return data[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]
