"""Periodic runs, ranked search and MinHash postings, against plain versions and SQL."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import WORD
from compare import difference
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import DATA, ITEMS, edges, empty, prose, write  # noqa: F401
from test_operators import oracle

from flagstone.llm import lexical_search, minhash_postings, periodic_runs
from flagstone.llm.queries import QUERIES, SQL, planted_period

# 13: periodic runs


def plain_runs(words, least=12):
    """Starts, periods and lengths of all runs, period by period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            smaller = (d for d in range(1, q) if all(words[x] == words[x + d] for x in range(i, j + q - d)))
            if size >= max(least, 2 * q) and next(smaller, None) is None:
                out.append((i, q, size))
            i = j + 1
    return sorted(out)


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=50), st.integers(0, 49), st.integers(1, 9)), max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs(texts):
    texts = [[w[a + (i - a) % p] if i >= a and a + p <= len(w) else x for i, x in enumerate(w)] for w, a, p in texts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    hashes = periodic_runs.mix(np.array([x + 7 for w in texts for x in w], np.uint64))
    start, length, period = periodic_runs.found_runs(hashes, offsets)
    want = [(s + o, q, n) for w, o in zip(texts, offsets.tolist(), strict=False) for s, q, n in plain_runs(w)]
    assert list(zip(start.tolist(), period.tolist(), length.tolist(), strict=True)) == want


def test_suffix_trees():
    """Extensions by the tour of the tree against comparing symbol by symbol."""
    r = random.Random(3)
    s = [r.randrange(3) for _ in range(300)] + [9]
    a, b = (np.array(x) for x in zip(*[r.sample(range(300), 2) for _ in range(500)], strict=True))
    plain = [next(k for k in range(301) if s[x + k] != s[y + k]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    extensions = periodic_runs.Extensions(s)
    assert extensions(a, b).tolist() == plain
    assert np.argsort(extensions.ranks).tolist() == sorted(range(301), key=lambda i: s[i:])


def plain_run_row(doc_id, text):
    words = WORD.findall(text or "")
    order = planted_period(doc_id, len(words)) if words else None
    words = [words[k] for k in order] if order is not None else words
    runs = plain_runs(words)
    gone = {k for s, q, n in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda x: (-x[2], x[0], x[1]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("where", ["edges", "planted"])
def test_periodic_runs(where, spark, edges, tmp_path):
    if where == "planted":
        r = random.Random(5)
        rows = [(d, "\n".join(" ".join(r.choices("ab cd efg h".split(), k=r.randint(0, 9))) for _ in range(r.randint(0, 25)))) for d in range(150)]
        rows += [(200 + d, prose(d, 300)) for d in range(60)]
        edges = write(str(tmp_path), [(d, t, "en", "s", len(t), "r", 1, "z", 3, 9) for d, t in rows])
    rows = pq.read_table(f"{edges}/documents.parquet").to_pylist()
    key = lambda x: tuple(map(str, x))
    # the plain version takes a minute for each 1,000 words more, so the longest texts of the edge cases are left to the next test
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, edges).collect()), key=key)
    small = [r for r in rows if len(r["text"] or "") < 10_000]
    want = sorted((plain_run_row(r["doc_id"], r["text"]) for r in small), key=key)
    assert len(got) == len(rows)
    assert [g for g in got if g[0] not in (9, 10)] == [w for w in want if w[0] not in (9, 10)] if where == "edges" else got == want
    if where == "planted":
        assert any(g[1] for g in got if zlib.crc32(str(g[0]).encode()) % 10 == 0)


def test_long_runs():
    """Half a million words: a unary text, and a long period between prose that repeats nothing."""
    for words, want in (
        (np.ones(300_000, np.uint64), (0, 300_000, 1)),
        (np.concatenate([np.arange(1, 50_001), np.tile(np.arange(60_000, 130_000), 3), np.arange(200_000, 250_000)]).astype(np.uint64), (50_000, 210_000, 70_000)),
    ):
        found = periodic_runs.found_runs(periodic_runs.mix(words), np.array([0, len(words)]))
        assert [x.tolist() for x in found] == [[x] for x in want]


# 12: ranked search


@pytest.mark.parametrize("bounds", [(16_384, 1 << 19, 1_000_000), (3, 40, 1_000_000), (16_384, 1 << 19, 100)])
def test_search_blocks(bounds, spark, edges, monkeypatch):
    """Strata cut into small blocks and queries in several blocks give the same rows."""
    for name, value in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "QUERY_TERMS"), bounds, strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    assert difference(QUERIES["op12_lexical_search"](spark, edges), oracle(edges), SQL["op12_lexical_search"]) is None


def test_search_ties_and_thresholds(spark, tmp_path):
    """Many equal texts: ties go by id, null last, and the threshold of the first block loses none of them."""
    texts = ["alpha beta gamma", "alpha beta delta", "alpha alpha beta", "beta x y z " * 9, "alpha 1 2 3 4 5 6 7 8"]
    rows = [(None if i % 17 == 0 else i // 2 - 40, texts[i % 5], "en", "s", 1, "r", 1, "z", 3, 9) for i in range(300)]
    folder = write(str(tmp_path), rows, None, [(1, "alpha", 1, "r"), (2, "beta beta gamma", 1, "r"), (3, "alpha beta gamma delta x", 1, "r")])
    assert difference(QUERIES["op12_lexical_search"](spark, folder), oracle(folder), SQL["op12_lexical_search"]) is None


def test_large_scores_stay_exact():
    stratum = lexical_search.Stratum(75, np.array([0, 1], np.uint32).tobytes(), np.array([3, 1], np.uint32).tobytes())
    stratum.open(np.array([2, 1], np.uint32).tobytes(), np.array([0, 1, 1], np.uint32).tobytes(), lexical_search.pa.array([5, 6]))
    queries = lexical_search.QueryBlock([{"item_id": 1, "terms": np.array([3, 8], np.uint64).tobytes(), "counts": np.array([1, 10**8 + 1], np.int64).tobytes(), "size": 2}])
    queries.weighted(np.array([25_000, 24_999]))
    impacts = [10**9 * tf // (1000 * tf + 12 * 75) for tf in (3, 1)]
    want = [25_000 * impacts[0], 25_000 * impacts[0] + 24_999 * (10**8 + 1) * impacts[1]]
    bound = int(stratum.bounds(queries)[0])
    assert bound == want[1] > 1 << 53
    assert stratum.scores(queries, 0, bound).tolist() == want


# 11: MinHash postings


def test_matches_needed():
    """The chance that a pair at the threshold is missed, summed directly."""
    from math import comb

    t, k = minhash_postings.OVER / minhash_postings.UNDER, minhash_postings.COORDS
    chance = lambda m: sum(comb(k, i) * t**i * (1 - t) ** (k - i) for i in range(m))
    assert chance(minhash_postings.MATCHES) <= minhash_postings.ESCAPE < chance(minhash_postings.MATCHES + 1)


@pytest.mark.parametrize("tile", [512, 16])
def test_large_groups(tile, spark, tmp_path, monkeypatch):
    """A large group of near copies, a chain, a passage that many unlike texts share, and pairs just below the limit."""
    monkeypatch.setattr(minhash_postings, "TILE", tile)
    r = random.Random(8)
    base = prose(20, 120).split()
    rows = []
    for _ in range(150):
        words = list(base)
        for k in r.sample(range(120), 2):
            words[k] = f"w{r.randrange(10**6)}"
        rows.append(" ".join(words))
    chain = prose(21, 100).split()
    for k in range(40):
        chain[(k * 7) % 100] = f"c{k}"
        rows.append(" ".join(chain).upper() if k % 3 else " ".join(chain))
    rows += [f"{prose(22, 60)} {prose(100 + k, 25)}" for k in range(80)]
    rows += [f"{prose(23, 85)} {' '.join(f'{x}{k}' for x in range(n))}" for k in range(4) for n in (13, 14, 15, 16)]
    r.shuffle(rows)
    folder = write(str(tmp_path), [(None if i == 7 else 1000 - i, t, "en", "s", 1, "r", 1, "z", 3, 9) for i, t in enumerate(rows)])
    assert difference(QUERIES["op11_minhash_postings"](spark, folder), oracle(folder), SQL["op11_minhash_postings"]) is None
