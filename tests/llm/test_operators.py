"""Each operator on edge cases and small tables, against SQL, the libraries or plain versions."""

import itertools
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute import jaccard_groups
from compare import connect, difference
from hypothesis import example, given, settings
from hypothesis import strategies as st
from llm_data import DATA, edges, empty, write  # noqa: F401
from pyspark.sql import functions as F

from flagstone.llm import licences, mixing, near_duplicates, neighbours, pieces, quality_model, quality_rules, substring_dedup, token_counts, token_files
from flagstone.llm.queries import QUERIES, SQL

DOC_QUERIES = [q for q in QUERIES if q != "op2_neighbours"]


def table(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


def oracle(folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark):
    assert difference(QUERIES[name](spark, DATA), connect(DATA), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op2_neighbours"}))
def test_edges_against_sql(name, spark, edges):
    assert difference(QUERIES[name](spark, edges), oracle(edges), SQL[name]) is None


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_empty_table(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == 0


# 1 and 4: the library is the measure


def library_ids(text):
    return token_files.load(token_files.default_tokenizer()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("where", ["edges", "data"])
def test_token_files(where, spark, edges):
    folder = edges if where == "edges" else DATA
    got = [tuple(r) for r in QUERIES["op1_token_files"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want = Counter()
    for row in table(folder):
        ids = [*library_ids(row["text"]), token_files.END]
        want[row["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((d, n, c) for d, _, n, c in got) == want
    at = 0
    for doc_id, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    ids = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_coding_round_trip(ranks):
    control, data = token_files.encode_ranks(np.array(ranks, np.uint32))
    assert len(control) == (len(ranks) + 3) // 4
    assert token_files.decode_ranks(control, data, len(ranks)).tolist() == ranks


@given(st.lists(st.text(st.one_of(st.sampled_from("aAbé'Σςİſı sdlmtrev<|>09 \n\t!#.,’½"), st.characters(codec="utf-8")), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
@example(["Â\U00018d09", "ᲀ\U0001e4d0 x\u0308'll"])
def test_tokenizers_agree(texts):
    want = [library_ids(t) for t in texts]
    ids, at = token_files.encoded_words(token_files.default_tokenizer()).encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == want
    assert token_counts.counted_words(token_counts.default_tokenizer()).count([t.encode() for t in texts]).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("where", ["edges", "data"])
def test_token_counts(where, spark, edges):
    folder = edges if where == "edges" else DATA
    got = Counter(tuple(r) for r in QUERIES["op4_token_counts"](spark, folder).collect())
    want = Counter()
    for row in table(folder):
        n = len(library_ids(row["text"]))
        want[row["doc_id"], len((row["text"] or "").encode()), n, n > 2048] += 1
    assert got == want


def test_overlapping_pairs_merge_from_the_left():
    merges = token_counts.counted_words(token_counts.default_tokenizer()).merges
    words = [b"a" * n for n in range(1, 40)] + [b"haha" * 9, b"\xff\xfe"]
    want = [len(library_ids("a" * n)) for n in range(1, 40)] + [len(library_ids("haha" * 9))]
    assert merges.survivors(words).tolist()[:-1] == want


# 2


def test_neighbours_edges(spark):
    vectors = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5, -1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
               (7, [float("inf"), 1.0]), (8, [1.0, None]), (9, [3.0, 1.0, 2.0]), (None, [1.0, 1.0]), (40, [2.0, 1.0, 1.0]), (2, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted(tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 3).collect())
    assert got == [
        (0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 2, 5.0), (20, 1, 0, -1.5), (20, 2, 0, -1.5), (20, 3, 1, -1.5), (40, 1, 9, 9.0)
    ]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_against_plain_search(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:900] = x[100]
    heaps = neighbours.Heaps(np.arange(50), x[:50], 7)
    for s in range(0, 3000, 700):
        heaps.meet(np.arange(s, min(s + 700, 3000)), x[s : s + 700])
    scores = sum(x[:50, k, None].astype(float) * x[None, :, k] for k in range(24))
    for q, heap in enumerate(heaps.best):
        order = sorted((-scores[q, j], j) for j in range(3000) if j != q)[:7]
        assert sorted((-s, -i) for s, i in heap) == order


# 3


@pytest.mark.parametrize("where", ["edges", "data"])
def test_mixing_meets_targets(where, spark, edges):
    rows = QUERIES["op3_mixing"](spark, edges if where == "edges" else DATA).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        s[1] = max(s[1], r.size)
    assert all(abs(taken - target) <= largest for (_, target), (taken, largest) in by.items())
    total = sum(r.size for r in rows)
    assert math.isclose(sum(t for _, t in {(r.source_size, r.target) for r in rows}), 1.5 * total, rel_tol=0.2) or where == "edges"


def test_mix_keeps_columns_and_copies(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    planned = mixing.plan(docs).agg(F.sum(F.when(F.col("size") > 0, F.col("copies")))).first()[0]
    assert mixed.filter(F.size(F.split(F.trim("text"), " ")) > 0).filter("length(trim(text)) > 0").count() >= planned - 2
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed.collect()))


@pytest.mark.parametrize("n", [2, 40])
def test_mixing_of_equal_sizes(n, spark, tmp_path):
    """What is missing is met exactly by some document, so at the edge of a bin."""
    folder = write(str(tmp_path / "equal"), [(i, "one two three four five six seven eight nine ten", "en", "s", 48, "r", 1, "z", 3, 9) for i in range(n)])
    assert difference(QUERIES["op3_mixing"](spark, folder), oracle(folder), SQL["op3_mixing"]) is None
    assert QUERIES["op3_mixing"](spark, folder).agg(F.sum("taken")).first()[0] == 15 * n


# 5


def test_samples_follow_the_distribution():
    table, n, k = pieces.Lattices(pieces.default_model()), 6000, 3
    v = table.vocabulary
    ids = {}
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.default_model())
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            ids[model.id_to_piece(i)] = i

    def ways(s):
        if not s:
            yield (), 0.0
        for m in range(1, len(s) + 1):
            if (i := ids.get(s[:m])) is not None:
                yield from (((i, *rest), w + v.weights[i]) for rest, w in ways(s[m:]))
            elif m == 1:
                own = v.bytes_at[list(s[0].encode())].tolist()
                yield from (((*own, *rest), w + len(own) * v.weights[own[0]]) for rest, w in ways(s[m:]))

    every = {a + b: x + y for (a, x), (b, y) in itertools.product(ways("▁cat"), ways("▁is\n"))}
    total = math.log(sum(map(math.exp, every.values())))
    p = {s: math.exp(w - total) for s, w in every.items()}
    for opened in (pieces.OPEN, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(pieces, "OPEN", opened)
            search = pieces.Search(table, [b"cat is\n"] * n, np.arange(n, dtype=np.uint64) * np.uint64(977), k)
        got = []
        for s in range(k):
            flat, at = search.pieces(s)
            got.append([tuple(flat[a:b].tolist()) for a, b in itertools.pairwise(at)])
            assert all(math.isclose(search.paths[s].whole[i], math.log(p[got[s][i]]), abs_tol=1e-4) for i in range(0, n, 97))
        assert all(len({g[i] for g in got}) == k for i in range(n))
        top = sorted(p, key=p.get, reverse=True)[:4]
        first, second = Counter(got[0]), Counter(got[1])
        for s in top:
            assert abs(first[s] / n - p[s]) < 0.03
            assert abs(second[s] / n - sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)) < 0.03
        weights = Counter()
        for s in range(k):
            chance = np.exp(pieces.log_inclusion(search.paths[s].whole, search.threshold()))
            for i in range(n):
                weights[got[s][i]] += p[got[s][i]] / chance[i] / n
        assert all(abs(weights[s] - p[s]) < 0.03 for s in top)


@pytest.mark.parametrize("text", ["if\n   y", "  a▁ b  "])
def test_samples_follow_the_distribution_over_runs_of_blanks(text):
    from sentencepiece import SentencePieceProcessor

    table, n = pieces.Lattices(pieces.default_model()), 6000
    v, model = table.vocabulary, SentencePieceProcessor(model_file=pieces.default_model())
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    def ways(s):
        if not s:
            yield (), 0.0
        for m in range(1, len(s) + 1):
            if (i := ids.get(s[:m])) is not None:
                yield from (((i, *rest), w + v.weights[i]) for rest, w in ways(s[m:]))
            elif m == 1:
                own = v.bytes_at[list(s[0].encode())].tolist()
                yield from (((*own, *rest), w + len(own) * v.weights[own[0]]) for rest, w in ways(s[m:]))

    every = dict(ways("▁" + text.replace(" ", "▁")))
    total = math.log(sum(map(math.exp, every.values())))
    p = {s: math.exp(w - total) for s, w in every.items()}
    assert tuple(model.encode(text)) in p
    search = pieces.Search(table, [text.encode()] * n, np.arange(n, dtype=np.uint64) * np.uint64(977), 2)
    got = []
    for s in range(2):
        flat, at = search.pieces(s)
        got.append([tuple(flat[a:b].tolist()) for a, b in itertools.pairwise(at)])
        assert all(math.isclose(search.paths[s].whole[i], math.log(p[got[s][i]]), abs_tol=1e-4) for i in range(0, n, 97))
    first, second = Counter(got[0]), Counter(got[1])
    for s in sorted(p, key=p.get, reverse=True)[:4]:
        assert abs(first[s] / n - p[s]) < 0.03
        assert abs(second[s] / n - sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)) < 0.03


def test_runs_of_blanks_hold_the_models_own_pieces():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.default_model())
    table = pieces.Lattices(pieces.default_model())
    for text in ("if x:\n    return  y   ", " " * 40 + "z", "   ", "a ▁ b"):
        at, want, node, seen = 0, model.encode(text), [], []
        for word in pieces.words_of_text(text.encode()):
            slot = table.index([word])[0]
            node, last = table.base.data[slot], table.last.data[slot]
            while node != last:
                first = table.first.data[node]
                edge = [e for e in range(first, first + table.degree.data[node]) if table.piece.data[e] == want[at] or (table.piece.data[e] < 0 and model.is_byte(want[at]))]
                assert len(edge) == 1
                seen.append(want[at])
                at, node = at + 1, node + table.length.data[edge[0]]
        assert seen == want


def test_lattices_stay_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "EDGES", 1000)
    table = pieces.Lattices(pieces.default_model())
    for i in range(6):
        table.index([b" " * 100 + b"w%d" % i])
        assert table.length.size < 3000 and len(table.slot) < 4


def test_pieces_decode_and_repeat(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    rows = pieces.sample_pieces(docs, k=3).collect()
    assert all(r.decoded for r in rows)
    texts = {r["doc_id"]: r["text"] for r in table(edges)}
    for r in rows:
        if r.doc_id is not None and texts[r.doc_id] in (None, ""):
            assert (r.sample, r.ids, r.log_inclusion) == (1, [], 0.0)
    by = Counter((r.doc_id, tuple(r.ids)) for r in rows if r.doc_id not in (1, None, 17))
    assert max(by.values()) == 1
    again = pieces.sample_pieces(docs.repartition(7), k=3).collect()
    assert Counter((r.doc_id, r.sample, tuple(r.ids)) for r in again) == Counter((r.doc_id, r.sample, tuple(r.ids)) for r in rows)


# 6


def test_boilerplate_lines_reject_depleted_documents(spark):
    line = "this line stands in very many documents of the host"
    rows = [(i, f"{line}\n{line.upper()}  \nand only few words {i}", "h") for i in range(30)] + [(50, line + "\n" + " ".join(f"w{j}" for j in range(40)), "h")]
    rows += [(60 + i, line + "\nsome other words are here too for once", "other") for i in range(5)] + [(80 + i, "one text that was copied again and again\nwith two lines of words", "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.row.doc_id: r.kept for r in quality_rules.rate(df, max_docs=10).collect()}
    assert not any(kept[i] for i in range(30))
    assert kept[50] and all(kept[60 + i] for i in range(5)) and all(kept[80 + i] for i in range(40))
    assert {r.doc_id for r in quality_rules.keep_good(df, max_docs=10).collect()} == {i for i, k in kept.items() if k}


def test_keep_good_keeps_columns(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns
    assert Counter(map(str, good.collect())) == Counter(str(r.row) for r in quality_rules.rate(docs).collect() if r.kept)


def test_boilerplate_lines_are_removed(spark):
    line = "this line stands in very many documents of the host"
    own = [f"{' '.join(f'w{i}x{j}' for j in range(30))}" for i in range(60)]
    rows = [(i, f"first {own[i]}\n\n\t{line.upper()} \x0b\n  last Line {i}\n{line}", "h", None, -1, "r") for i in range(30)]
    rows += [(i, f"{line}\n{own[i]}", None, None, -1, "r") for i in range(30, 36)] + [(40, f"{line}\n{line}\nonly a few words here", "h", None, -1, "r"), (41, None, "h", None, None, "r")]
    rows += [(0, *rows[0][1:])] * 3 + [(50, f"{line}\n{own[50]}\nx", "h", None, -1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 string, n_chars int, row string")

    def clean(text, host):
        return "\n".join(x for x in text.split("\n") if host != "h" or " ".join(x.lower().split()) != line)

    want = Counter()
    for i, text, host, *_ in rows:
        new = None if text is None else clean(text, host)
        want[i, new, host, None, (None if text is None else -1) if new == text else len(new), "r"] += 1
    cleaned = quality_rules.without_boilerplate(df, max_docs=10)
    assert cleaned.dtypes == df.dtypes
    assert Counter(map(tuple, cleaned.collect())) == want
    # lines looked up in the rows, and joined by shuffle
    for most in (20_000, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(quality_rules, "FREQUENT_LINES", most)
            good = quality_rules.keep_clean(df, max_docs=10)
            assert good.dtypes == df.dtypes
            assert Counter(map(tuple, good.collect())) == Counter({k: n for k, n in want.items() if k[0] not in (40, 41)})
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in quality_rules.keep_good(df, max_docs=10).collect())


def test_first_stage_removes_boilerplate(spark):
    import corpus_pipeline

    line = "share this page with all of your many friends"
    rows = [(i, f"{line}\n" + " ".join(f"w{i}x{j}" for j in range(30)), "h") for i in range(101)]
    out = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(i, t.split("\n")[1]) for i, t, _ in rows]


# 7


def test_license_spans(spark):
    mit = licences.TEMPLATES[2][1]
    edited = mit.replace("free of charge", "at no charge").replace("copies or substantial", "or substantial")
    rows = [(1, f"Some code here.\n{edited}\nEnd."), (2, "licensed UNDER the apache license version 2.0 and some words in between that belong to none of both, then Licensed under the Apache License, Version 2.0."), (3, None), (4, ""),
            (5, "the license of the version is under the public"), (None, "Licensed under CC BY-NC 4.0."), (6, "x " * 3000 + "Licensed under CC BY-SA 4.0.")]
    got = licences.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "cc-by-nc-4.0"), (1, "mit"), (2, "apache-2.0"), (2, "apache-2.0"), (6, "cc-by-sa-4.0")]
    for r in got:
        text = dict(rows)[r.doc_id].encode()
        assert text[r.start_byte : r.end_byte].decode().lower().startswith(("permission", "licensed"))
    assert all(0.9 < r.coverage < 1 for r in got if r.license == "mit")


NOTICES = [
    ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("This work is licensed under the GNU General Public License, version 9.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["agpl-3.0"]),
    ("Licensed under CC BY 4.0.", ["cc-by-4.0"]), ("Licensed under CC BY-ND 4.0.", ["cc-by-nd-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0"]),
    ("Licensed under CC BY-NC-ND 4.0.", ["cc-by-nc-nd-4.0"]), ("Licensed under CC BY-XX 4.0.", []), ("Licensed under CC BY 3.0.", []), ("Licensed under CC0 1.0.", ["cc0-1.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["cc-by-sa-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", []),
    ("Licensed under the Apache License, Version 1.1.", []), ("Released under the BSD License.", []),
]


def test_deciding_words(spark):
    wordings = {name: text for name, text, _ in sorted(licences.TEMPLATES, key=lambda t: len(t[1]))}
    notices = NOTICES + [(t, [n]) for n, t, _ in licences.TEMPLATES]
    notices += [(wordings["bsd-3-clause"].replace("the copyright holder", "Some Company Inc."), ["bsd-3-clause"]), (wordings["gpl-2.0"].replace("version 2 ", "version 7 "), [])]
    rows = [(i, f"Some words go before it. {t} And some go after it.") for i, (t, _) in enumerate(notices)]
    got = {}
    for r in licences.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert [(t, got.get(i, [])) for i, (t, _) in enumerate(notices)] == notices
    with pytest.raises(ValueError, match="not in its template"):
        licences.Index((("x", "some words", ("other words",)),))


def test_short_notices_do_not_hang_on_a_hash(spark):
    """One changed word anywhere outside the deciding words, or anywhere without any, leaves a score of 0.8 and more."""
    deciding = [(n, licences.plain_words(pa.array([t.encode()])), t, d) for n, t, d in licences.TEMPLATES]
    rows, want, plain = [], [], [(f"n{n}", " ".join(f"q{n}w{i}" for i in range(n))) for n in range(5, 12)]
    for name, (hashes, first, end, _), text, runs in deciding:
        fixed = {i for a, b in (licences.run_in(hashes, x) for x in runs) for i in range(a, b)}
        for i in range(len(first) if len(first) < licences.SHORT else 0):
            if i not in fixed:
                rows.append(text[: first[i]] + "other" + text[end[i] :])
                want.append(name)
    docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licences.scan_licenses(docs).collect()}
    assert [got.get(i) for i in range(len(rows))] == want
    changed = [(n, " ".join("other" if j == i else w for j, w in enumerate(t.split()))) for n, t in plain for i in range(len(t.split()))]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, (_, t) in enumerate(changed)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licences.scan_licenses(docs, templates=plain).collect()}
    assert [got.get(i) for i in range(len(changed))] == [n for n, _ in changed]


def test_alignment_against_full_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        template = rng.integers(0, 6, 12).astype(np.uint64)
        text = np.insert(np.delete(template, rng.integers(0, 12)), rng.integers(0, 11), np.uint64(9))
        text = np.concatenate([np.full(5, 8, np.uint64), text, np.full(4, 7, np.uint64)])
        cost = np.zeros((13, len(text) + 1))
        for i in range(1, 13):
            cost[i, 0] = i
            for j in range(1, len(text) + 1):
                cost[i, j] = min(cost[i - 1, j - 1] + (template[i - 1] != text[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
        matched, first, last = licences.align(template, text, 5)
        assert matched >= 12 - cost[12].min() and 0 <= first <= last < len(text)


# 8


@pytest.mark.parametrize(("tile", "shingles"), [(512, 2_000_000), (3, 2_000_000), (512, 700)])
def test_jaccard_groups(tile, shingles, spark, edges, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    monkeypatch.setattr(near_duplicates, "TILE_SHINGLES", shingles)
    for folder in (edges, DATA):
        rows = [(r["doc_id"], r["text"]) for r in table(folder)]
        got = near_duplicates.join(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "class_id", "n_links").collect()
        assert Counter(map(tuple, got)) == Counter(jaccard_groups(rows))


def test_one_of_each_group_stays(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    left = near_duplicates.keep_one(docs)
    assert left.columns == docs.columns
    rows = jaccard_groups([(r["doc_id"], r["text"]) for r in table(edges)])
    alone = sum(1 for r in table(edges) if not (r["text"] or "").strip(" \n\t\x0b"))
    groups = {g for (_, g, n), r in zip(rows, table(edges), strict=True) if n}
    single = sum(1 for (_, _, n), r in zip(rows, table(edges), strict=True) if not n and (r["text"] or "").strip(" \n\t\x0b"))
    assert left.count() == alone + len(groups) + single


def test_pruning_keeps_likely_pairs():
    assert near_duplicates.NEEDED == sorted(near_duplicates.NEEDED)
    from math import comb

    for n, m in zip(range(32, 129, 32), near_duplicates.NEEDED, strict=True):
        below = sum(comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m))
        assert below < 1e-7 and m > n // 4


# 9


def test_cut_text_keeps_its_layout(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect())
    import hashlib

    from brute import WORD

    assert Counter((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in out.collect()) == kept
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_texts_go_through_the_blocks_once(spark, edges, monkeypatch):
    docs, seen, whole = spark.read.parquet(f"{edges}/documents.parquet"), [], substring_dedup.deduplicated
    monkeypatch.setattr(substring_dedup, "deduplicated", lambda df, columns, **k: seen.append(columns) or whole(df, columns, **k))
    out = substring_dedup.without_repeats(docs)
    assert len(seen) == 1 and "text" not in seen[0]
    nulls = docs.filter("text is null").count()
    assert nulls and out.filter("text is null and n_chars is null").count() == nulls and out.count() == docs.count()


@given(st.lists(st.integers(0, substring_dedup.CELLS - 1), max_size=40))
@settings(max_examples=60, deadline=None)
def test_cells_round_trip(cells):
    ordered = np.sort(np.array(cells, np.int64))
    assert substring_dedup.unpack_cells(substring_dedup.pack_cells(ordered)).tolist() == ordered.tolist()


# 10


def test_classifier_on_held_out_rows(spark):
    folder = DATA.replace("0.001", "0.01")
    scores = QUERIES["op10_quality_classifier"](spark, folder).filter("held_out").select("doc_id", "score", "predicted")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality is not null")
    rows = scores.join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_classifier_edges(spark, edges):
    rows = QUERIES["op10_quality_classifier"](spark, edges).collect()
    assert len(rows) == len(table(edges)) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    one = quality_model.fit({1: (3.0, np.ones(2), np.eye(2))}, 2)
    assert one.score(np.zeros((2, 2))).tolist() == [1.0, 1.0]
    assert quality_model.statistics(pa.array([None, b""], pa.binary())).shape == (2, len(quality_model.STATISTICS))
