"""Token counts by rank-synchronous merging over ragged numpy arrays.

Distinct words are brought to the vocabulary's form (composed, lower case), cut into pre-tokens and
their bytes laid out as one flat array of symbols. In each round every sequence finds the lowest
merge rank among its neighbours and applies that pair wherever it stands, all sequences at once;
sequences without a pair left retire. What counts is how many symbols survive.

Defined cases. A null text is an empty one: 0 bytes, 0 tokens. Special strings inside a text count
one token each. Repeated rows each get a row; ties cannot occur; an empty table gives no rows; only
doc_id and text are read. A long word without white space is one long sequence among the others.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import ragged_starts
from flagstone.llm.token_files import PLAIN, load
from flagstone.llm.words import Growing, WordTable, chunks, split_texts

#: The vocabulary's mark of a word's end.
WORD_END = "</w>"
NONE = np.uint32(0xFFFFFFFF)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one of those from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Merges:
    """A vocabulary's merges as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocabulary = content["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.uint64)
        self.product = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.uint32)
        signs = byte_signs()
        self.inner = np.array([vocabulary[s] for s in signs], np.int64)
        self.last = np.array([vocabulary[s + WORD_END] for s in signs], np.int64)
        self.byte_of = {s: b for b, s in enumerate(signs)}
        specials = [t["content"] for t in content["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.library = load(path)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where the vocabulary has no such merge."""
        keys = (left << 32 | right).astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def pre_tokens(self, word: str) -> tuple[int, list[bytes]]:
        """How many special strings stand in a word, and the pre-tokens of the rest.

        Plain words are letters and a run of marks. Others are brought to form and cut by the
        vocabulary's own rules, since which characters are letters depends on their version.
        """
        if m := PLAIN.fullmatch(word):
            return 0, [x.encode() for x in (m[1].lower(), m[2]) if x]
        parts = self.specials.split(word) if self.specials else [word]
        found: list[bytes] = []
        for part in parts:
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
            found += [bytes([self.byte_of[c] for c in piece]) for piece, _ in cut]
        return len(parts) - 1, found

    def survivors(self, sequences: list[bytes]) -> np.ndarray:
        """How many symbols are left of each sequence of bytes when no merge applies any more."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = sizes.copy()
        data = np.frombuffer(b"".join(sequences), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.inner[data]
        symbols[ends] = self.last[data[ends]]
        last = np.zeros(len(data), bool)
        last[ends] = True
        ranks = np.full(len(data), NONE)
        inside = np.flatnonzero(~last)
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        rows = np.arange(len(sequences))
        while len(rows):
            starts = ragged_starts(sizes)[:-1]
            lowest = np.minimum.reduceat(ranks, starts)
            on = lowest != NONE
            if not on.all():
                out[rows[~on]] = sizes[~on]
                stay = np.repeat(on, sizes)
                symbols, last, ranks = symbols[stay], last[stay], ranks[stay]
                rows, sizes, lowest = rows[on], sizes[on], lowest[on]
                continue
            owner = np.repeat(np.arange(len(rows)), sizes)
            at = np.flatnonzero(ranks == lowest[owner])
            # of a run of equal pairs (aaa) every second one applies, from the left, within its sequence
            fresh = np.ones(len(at), bool)
            fresh[1:] = (np.diff(at) != 1) | (np.diff(owner[at]) != 0)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.product[ranks[at]]
            last[at] = last[at + 1]
            sizes = sizes - np.bincount(owner[at], minlength=len(rows))
            left = np.ones(len(symbols), bool)
            left[at + 1] = False
            moved = at - np.arange(len(at))  # one symbol vanished for each pair before it
            symbols, last, ranks = symbols[left], last[left], ranks[left]
            touched = np.concatenate([moved, moved[moved > 0] - 1])
            inside = touched[~last[touched]]
            ranks[touched] = NONE
            ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return out


class CountedWords(WordTable):
    """The token count of each word; pre-tokens are merged once per worker."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.merges = Merges(path)
        self.reset()

    def reset(self) -> None:
        self.counts = Growing(np.int64)
        self.known: dict[bytes, int] = {}

    def add(self, words: list[bytes]) -> None:
        cut = [self.merges.pre_tokens(w.decode("utf-8", "replace")) for w in words]
        new = list({p for _, found in cut for p in found}.difference(self.known))
        if new:
            self.known.update(zip(new, self.merges.survivors(new).tolist(), strict=True))
        known = self.known
        self.counts.extend(np.fromiter((n + sum([known[p] for p in found]) for n, found in cut), np.int64, len(words)))

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        words, offsets = split_texts(texts)
        slots = self.index(words)
        total = np.concatenate([[0], np.cumsum(self.counts.data[slots])])
        return np.diff(total[offsets])


@functools.lru_cache(maxsize=1)
def counted_words(path: str) -> CountedWords:
    return CountedWords(path)


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch):
                texts = rows.column(1).to_pylist()
                sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
                counts = counted_words(path).count(texts)
                yield pa.record_batch([rows.column(0), sizes, counts, counts > limit], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
