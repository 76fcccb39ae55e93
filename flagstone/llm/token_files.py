"""Token ids in files: frequency-ranked ids, byte-aligned variable length, control bytes kept apart.

Ids are counted over all documents and ranked (most frequent first, ties to the smaller id). A rank
takes one to four bytes; two control bits say how many, four ranks share a control byte, and control
bytes stand in a column of their own. Reading looks lengths and masks up in small numpy tables.

Layout of a folder: ``blocks`` (Parquet rows: shard, block, ids before it in its shard, doc_ids,
lengths, control, data) and ``ranks`` (the id of each rank). Shards follow each other in ascending
doc_id, and so do the blocks and documents inside. Each document ends with ``END``.

Defined cases. A null text is an empty one and yields the end id alone. Null doc_ids sort first.
Documents of one doc_id are ordered by length, then by ids; equal ones are interchangeable. An empty
table gives files without blocks. Other columns are not read. A long text is one block of its own.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flagstone.llm.common import packed, written
from flagstone.llm.hashing import word_spans
from flagstone.llm.words import Growing, SpanTable, chunks, gather_runs

END = 1
BLOCK_IDS = 1 << 18
#: Letters that lower case and normal form map one to one, then a run of marks that stays together.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]*)([.,!|#$%&*:;]*)")


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class EncodedWords(SpanTable):
    """The library's ids of each word. White space always ends a pre-token, so a text's ids are its words' ids."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values(), default=0) + 1
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.ids, self.starts, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def keep(self, slots: np.ndarray) -> None:
        lengths = self.lengths.data[slots]
        ids = gather_runs(self.ids.data, self.starts.data[slots], lengths)
        self.ids, self.starts, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int64)
        self.ids.extend(ids)
        self.starts.extend(np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)

    def add(self, words: list[bytes]) -> None:
        """Plain words are encoded many at once and told apart by their word-end ids, others one by one."""
        texts = [w.decode("utf-8", "replace") for w in words]
        parts = np.zeros(len(words), np.int64)
        for i, text in enumerate(texts):
            if m := PLAIN.fullmatch(text):
                parts[i] = bool(m[1]) + bool(m[2])
        plain, odd = np.flatnonzero(parts), np.flatnonzero(parts == 0)
        lines = [" ".join([texts[i] for i in plain[k : k + 500]]) for k in range(0, len(plain), 500)]
        runs = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        together = np.concatenate(runs) if runs else np.empty(0, np.uint32)
        ends = np.flatnonzero(self.ends_word[together])[np.cumsum(parts[plain]) - 1] + 1 if len(plain) else plain
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)]
        base, starts, lengths = self.ids.size, np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        lengths[plain] = np.diff(ends, prepend=0)
        starts[plain] = base + ends - lengths[plain]
        lengths[odd] = [len(x) for x in alone]
        starts[odd] = base + len(together) + np.cumsum(lengths[odd]) - lengths[odd]
        self.ids.extend(together)
        self.ids.extend(np.fromiter((i for x in alone for i in x), np.uint32))
        self.starts.extend(starts)
        self.lengths.extend(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some UTF-8 texts (null: none), and where each text's ids start."""
        data, first, end, offsets = word_spans(texts)
        slots = self.index(data, first, end)
        lengths = self.lengths.data[slots]
        ids = gather_runs(self.ids.data, self.starts.data[slots], lengths)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[offsets]


@functools.lru_cache(maxsize=1)
def encoded_words(path: str) -> EncodedWords:
    return EncodedWords(path)


def _squeeze(ids: np.ndarray, kind: str, squeezer) -> bytes:
    """Low bytes first, then high bytes, compressed: only a step on the way."""
    return squeezer.compress(ids.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes())


def _spread(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
     ("lengths", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())]
)


def tokens(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """A row of squeezed ids for each document, and for each task one row of counts (n is -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeezer = encoded_words(path), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(table.size, np.int64)
        for batch in batches:
            for rows in chunks(batch):
                ids, at = table.encode(rows.column(1))
                ids = np.insert(ids, at[1:], END)
                at = at + np.arange(len(at))
                counts += np.bincount(ids, minlength=table.size)
                own = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch(
                    [rows.column(0), np.diff(at), pa.array([zlib.crc32(packed(x.astype("<u4"))) for x in own], pa.int64()),
                     pa.array([_squeeze(x, kind, squeezer) for x in own], pa.binary())], schema=TOKENS,
                )
        if counts.any():
            yield pa.record_batch([[None], [-1], [0], [squeezer.compress(packed(counts))]], schema=TOKENS)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n long, crc long, ids binary")


def ranked_ids(tokens: DataFrame) -> DataFrame:
    """``rank``, ``id`` by falling frequency, from the counts of all tasks; as many rows as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                more = np.frombuffer(zstandard.decompress(x), np.int64)
                total = more + np.pad(total, (0, len(more) - len(total)))
        used = np.flatnonzero(total)
        if len(used):
            yield pa.record_batch([used, total[used]], names=["id", "n"])

    counts = tokens.filter("n = -1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1
    return counts.select(rank.cast("int").alias("rank"), F.col("id").cast("int").alias("id"))


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]]
    four = np.pad(code, (0, -len(code) % 4)).reshape(-1, 4)
    return packed(four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6), packed(data)


_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
_LENGTHS = (_CODES + 1).astype(np.uint8)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again: lengths and masks come from tables, bytes from four shifted looks at the data."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    flat = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    return (flat[at] | flat[at + 1] << 8 | flat[at + 2] << 16 | flat[at + 3] << 24) & _MASKS[lengths - 1]


def write_files(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode all documents into ``folder``."""
    path = path or default_tokenizer()
    size = max(load(path).get_vocab().values(), default=0) + 1
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = written(tokens(docs, path, kind), "tokens", compression="none")
    ranked_ids(rows).coalesce(1).write.parquet(f"{folder}/ranks")
    ids = [r.id for r in docs.sparkSession.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]  # the vocabulary at most
    rank_of = np.zeros(size, np.uint32)
    rank_of[ids] = np.arange(len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, held, doc_ids, lengths = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            ranks = rank_of[np.concatenate(held)]
            out = [[shard], [block], [before], [len(ranks)], [list(doc_ids)], [list(lengths)], *([x] for x in encode_ranks(ranks))]
            block, before = block + 1, before + len(ranks)
            for kept in (held, doc_ids, lengths):
                kept.clear()
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(out, BLOCKS, strict=True)], schema=BLOCKS)

        for batch in batches:
            for doc_id, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(_spread(data, kind))
                doc_ids.append(doc_id)
                lengths.append(n)
                if sum(lengths) >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    spread = rows.filter("n >= 0").repartitionByRange("doc_id", "n", "crc").sortWithinPartitions("doc_id", "n", "crc", "ids")
    blocks = spread.select("doc_id", "n", "ids").mapInArrow(
        run, "shard int, block int, before long, n_ids long, doc_ids array<long>, lengths array<int>, control binary, data binary"
    )
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """From the files alone: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document."""
    id_of = np.array([r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[decode_ranks(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - row["lengths"]
                sums = [zlib.crc32(packed(ids[a:b])) for a, b in zip(starts, ends, strict=True)]
                yield pa.record_batch(
                    [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), starts + row["before"],
                     ends - starts, pa.array(sums, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = blocks.mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("first"))
    return rows.join(shards, "shard").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
