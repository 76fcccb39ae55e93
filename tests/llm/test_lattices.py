"""Lattices kept between runs of text."""

import tracemalloc

import numpy as np

from flagstone.llm import pieces as P
from flagstone.llm import words as W


def lattice(table, word):
    slot = table.slot[word]
    base, last = table.base.data[slot], table.last.data[slot]
    begin, end = int(table.first.data[base]), int(table.first.data[last])
    first = table.first.data[base : last + 1].astype(np.int64) - begin
    return (
        first.tolist(), table.degree.data[base : last + 1].tolist(), table.length.data[begin:end].tolist(), table.piece.data[begin:end].tolist(),
        table.logp.data[begin:end].round(4).tolist(), np.minimum(table.upto.data[begin:end], 9).round(4).tolist(),
    )


def test_common_words_stay_when_the_table_is_full():
    path = P.default_model()
    common = [b"the", b"weather", b"", "größe".encode(), b" two", "日本語".encode(), b"\xff\xfe", b"of"]
    table = P.Lattices(path, limit=40)
    added = []
    add = table.add
    table.add = lambda words: (added.extend(words), add(words))
    for n in range(12):
        table.index([*common, *[b"rare%d-%d" % (n, i) for i in range(9)], *common])
        assert len(table.slot) <= 40
        assert table.base.size == table.last.size == table.met.size == len(table.slot)
        assert list(table.slot.values()) == list(range(len(table.slot)))
    assert all(added.count(w) == 1 for w in common)
    fresh = P.Lattices(path)
    fresh.index(list(table.slot))
    assert all(lattice(table, w) == lattice(fresh, w) for w in table.slot)
    assert lattice(table, b"\xff\xfe")[0][-1] > 0


def test_long_words_never_fill_the_table(monkeypatch):
    monkeypatch.setattr(P, "EDGES", 2000)
    table = P.Lattices(P.default_model(), limit=1000)
    for n in range(6):
        slots = table.index([b"many different pieces in one %d" % n * 20, b"the"])
        assert table.length.size <= 2000 + 2 * 1900 and (slots < table.base.size).all()
    fresh = P.Lattices(P.default_model())
    fresh.index([b"the"])
    assert lattice(table, b"the") == lattice(fresh, b"the")


def test_a_full_table_makes_room_in_place(monkeypatch):
    """Beside the lattices kept, the memory that making room takes does not grow with their edges."""
    monkeypatch.setattr(W, "KEPT_AT_ONCE", 5_000)
    table = P.Lattices(P.default_model(), limit=4000)
    words = [b"weather-%d-station" % i * 6 for i in range(2000)]
    for _ in range(3):
        table.index(words)
    edges = table.length.size
    assert edges > 150_000
    tracemalloc.start()
    table.forget()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert table.length.size == edges
    assert peak < 3_000_000
    fresh = P.Lattices(P.default_model())
    fresh.index(words[::100])
    assert all(lattice(table, w) == lattice(fresh, w) for w in words[::100])


def test_runs_kept_in_place(monkeypatch):
    monkeypatch.setattr(W, "KEPT_AT_ONCE", 7)
    rng = np.random.default_rng(4)
    for n in (0, 1, 60):
        store = W.Growing(np.int32, 100)
        store.extend(rng.integers(0, 1000, 500))
        lengths = rng.integers(0, 15, n)
        starts = np.cumsum(rng.integers(0, 3, n) + lengths) - lengths
        starts, lengths = starts[starts + lengths <= 500], lengths[starts + lengths <= 500]
        want = [x for a, m in zip(starts, lengths, strict=True) for x in store.data[a : a + m].tolist()]
        store.keep(starts, lengths)
        assert store.data[: store.size].tolist() == want
        assert store.size > 100 or len(store.data) == 100


def test_children_are_found_by_hash():
    v = P.vocabulary(P.default_model())
    on = np.flatnonzero(v.keys >= 0)
    assert (v.child(v.keys[on]) == v.children[on]).all() and len(on) == len(v.inner) - 1
    absent = np.setdiff1d(np.arange(-1, 200_000), v.keys[on])
    assert (v.child(absent) == -1).all()
