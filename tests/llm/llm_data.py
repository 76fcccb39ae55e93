"""Small tables for the tests of this folder, as fixtures to import."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
                  ("row", pa.string()), ("k1", pa.int64()), ("size", pa.string()), ("block", pa.int32()), ("copies", pa.int64())])


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 7))) for _ in range(n)]
    return " ".join(w + ("\n" if r.random() < 0.05 else "") for w in words)


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, copies, near copies, shared passages, repeated rows."""
    base, long, shared = prose(1, 60), prose(2, 9000), prose(3, 30)
    near = base.split(" ")
    near[5] = "changed"
    texts = [
        (1, base, "s1"), (1, base, "s1"), (2, base, "s1"), (None, base, None), (3, None, "s1"), (4, "", "s2"), (5, " \n\t\x0b ", None), (6, "one two three", "s2"),
        (7, "one two three", "s2"), (8, " ".join(near), "s2"), (9, long, "s3"), (10, long.replace("a", "b", 3), "s3"), (11, f"start here {shared} end", "s1"),
        (12, f"{shared}\nother words follow {prose(4, 20)}", "s1"), (13, "Été ÇA ßıΣς <|endoftext|> don't ’s 12½ ##!!  x ́ 日本語", "s4"), (14, "x", "s4"),
        (None, None, None), (15, "!!! ### ||| $$$ " * 12, "s1"), (16, "word " * 50, "s1"), (17, prose(5, 40), "s1"), (17, prose(6, 40), "s1"), (-3, prose(7, 25), "ä"),
        (18, "line one is here and long\n" * 3 + prose(8, 15), "s2"), (19, "a" * 3000, "s2"), (20, f"{prose(9, 14)} Licensed under CC BY-NC 4.0. {shared}", "s5"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "r", 1, "z", 3, 9) for i, t, s in texts]


ITEMS = [
    (1, "one two THREE word word", 5, "r"), (1, "one two THREE word word", 5, "r"), (2, None, 5, "r"), (3, " ?! \n", 5, "r"), (None, "ÇA été 日本語 don't 12", 5, "r"),
    (4, prose(1, 60), 5, "r"), (5, prose(2, 900), 5, "r"), (6, "nowherefound", 5, "r"),
]


def write(folder: str, rows: list[tuple], labels: list[tuple] | None = None, items: list[tuple] | None = None) -> str:
    os.makedirs(folder, exist_ok=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in DOCS]
    pq.write_table(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, DOCS, strict=True)], schema=DOCS), f"{folder}/documents.parquet")
    ids, quality = zip(*labels, strict=True) if labels else ([], [])
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int64())}), f"{folder}/labels.parquet")
    columns = list(zip(*items, strict=True)) if items else [[]] * 4
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
    columns = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
    pq.write_table(pa.table(columns, names=["item_id", "text", "doc_id", "row"]), f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="session")
def edges(tmp_path_factory):
    return write(str(tmp_path_factory.mktemp("edges")), edge_rows(), [(1, 1), (2, 0), (3, 1), (6, None), (9, 1), (16, 0), (16, 0), (99, 1)], ITEMS)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(str(tmp_path_factory.mktemp("empty")), [])
