"""Quality scores by regularised quadratic discriminants.

Statistics of each whole text (shares of capitals, marks, symbols, repeats and so on) are brought to
similar spreads by roots and logarithms. Each class is a normal density of them: the covariance is
shrunk towards a multiple of the identity (after scaling by the spread of all training rows) by the
oracle-approximating estimate, and its Cholesky factor is computed once. The score is the logistic of
the difference of the two log densities (Mahalanobis distances and determinants) plus the log odds of
the classes. All labelled rows outside the held-out third train; their counts, sums and products are
added up per task and then by Spark, so the driver sees a few hundred numbers at any size.

Defined cases. A null or empty text has the statistics of no words and a score like any other. A null
doc_id is not held out and never trains. Labels of null quality are left out; repeated rows and labels
count each. Without labels of both classes every score is the share of label 1 (1/2 if there are none).
An empty table gives no rows. Only doc_id, text, labels.doc_id and labels.quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import written
from flagstone.llm.hashing import hash_spans, word_spans
from flagstone.llm.words import chunks

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?",
          "bang": b"!", "bar": b"|", "symbol": b"#*$%&<>@^~+=_\\{}[]", "line": b"\n", "blank": b" \t\r\v\f"}
_ORDER = [*_KINDS, "more", "lead", "rest"]
_CODE = np.full(256, _ORDER.index("rest"), np.int64)
for _i, _kind in enumerate(_KINDS.values()):
    _CODE[list(_kind)] = _i
_CODE[0x80:0xC0] = _ORDER.index("more")
_CODE[0xC0:] = _ORDER.index("lead")

STATISTICS = ["words", "length", "spread", "upper", "first_upper", "bang", "bar", "symbol", "digit", "stop", "again", "distinct", "commonest", "lines", "foreign"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    data, first, end, offsets = word_spans(texts)
    n_docs, n_words = len(texts), np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), n_words)
    sizes = np.zeros(n_docs, np.int64)
    raw = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n_docs + 1].astype(np.int64)) if n_docs else sizes
    sizes[:] = np.where(np.array(texts.is_valid()), raw, 0)
    counts = np.bincount(np.repeat(np.arange(n_docs) * len(_ORDER), sizes) + _CODE[data], minlength=n_docs * len(_ORDER))
    c = dict(zip(_ORDER, counts.reshape(n_docs, -1).T.astype(float), strict=True))
    per_doc = lambda x: np.bincount(doc, x, n_docs)
    w = np.maximum(n_words, 1)
    lengths = (end - first).astype(float)
    mean = per_doc(lengths) / w
    spread = np.sqrt(np.maximum(per_doc(lengths * lengths) / w - mean * mean, 0))
    hashes = hash_spans(data, first, end)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    runs = np.flatnonzero(new)
    repeats = np.diff(np.append(runs, len(order)))
    commonest = np.zeros(n_docs)
    np.maximum.at(commonest, doc[order[runs]], repeats)
    distinct = np.bincount(doc[order[runs]], minlength=n_docs)
    capital = _CODE[data[first]] == _ORDER.index("upper")
    letters = c["upper"] + c["lower"] + 1
    columns = [
        np.log1p(n_words), np.log1p(mean), np.log1p(spread), np.sqrt(c["upper"] / letters), np.sqrt(per_doc(capital) / w),
        *(np.sqrt(c[k] / w) for k in ("bang", "bar", "symbol", "digit", "stop")), np.sqrt(per_doc(again) / w),
        np.log((distinct + 1) / (n_words + 1)), np.sqrt(commonest / w), np.sqrt(c["line"] / w), np.sqrt(c["lead"] / (letters + c["lead"])),
    ]
    return np.stack(columns, 1)


def shrunk(scatter: np.ndarray, n: float) -> np.ndarray:
    """A covariance shrunk towards a multiple of the identity by the oracle-approximating estimate."""
    d = len(scatter)
    trace, square = np.trace(scatter), (scatter * scatter).sum()
    below = (n + 1 - 2 / d) * (square - trace * trace / d)
    rho = min(1.0, ((1 - 2 / d) * square + trace * trace) / below) if below > 0 else 1.0
    rho = max(rho, 1e-3)
    return (1 - rho) * scatter + rho * max(trace / d, 1e-9) * np.eye(d)


@dataclass(frozen=True)
class Model:
    """Scaling, and for each class its mean, the inverse of its Cholesky factor and the constant of its log density."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]
    fallback: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fallback is not None:
            return np.full(len(x), self.fallback)
        x = (x - self.centre) / self.scale
        bad, good = (k - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, k in zip(self.means, self.whiten, self.constants, strict=True))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], d: int) -> Model:
    """From each class's row count, sum and sum of outer products."""
    total = sum(s[0] for s in sums.values())
    if len(sums) < 2:
        share = sums[1][0] / total if 1 in sums else 0.5 if not total else 0.0
        zero = np.zeros(d)
        return Model(zero, zero, (zero, zero), (np.eye(d), np.eye(d)), (0.0, 0.0), share)
    centre = sum(s[1] for s in sums.values()) / total
    second = sum(s[2] for s in sums.values()) / total
    scale = np.sqrt(np.maximum(np.diag(second) - centre * centre, 1e-12))
    means, whiten, constants = [], [], []
    for label in (0, 1):
        n, one, two = sums[label]
        mean = one / n
        scatter = (two / n - np.outer(mean, mean)) / np.outer(scale, scale)
        factor = np.linalg.cholesky(shrunk(scatter, n))
        means.append((mean - centre) / scale)
        whiten.append(np.linalg.inv(factor))
        constants.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
    return Model(centre, scale, tuple(means), tuple(whiten), tuple(constants))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x = statistics(part.column(1))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([part.column(0), values], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy().reshape(len(values), -1)


def train(stats: DataFrame, labels: DataFrame) -> Model:
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(1)), batch.column(0).to_numpy()
                for label in (0, 1):
                    own = x[y == label]
                    total[label] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        places = np.arange(total.shape[1], dtype=np.int32)
        for label in (0, 1):
            yield pa.record_batch([pa.array([label] * len(places), pa.int32()), places, total[label]], names=["label", "place", "value"])

    known = labels.filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    rows = stats.join(known, "doc_id").select("y", "x")
    parts = rows.mapInArrow(run, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    sums: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    found = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():  # two rows of a few hundred numbers
        found[r.label, r.place] = r.value
    for label in (0, 1):
        if found[label, 0]:
            sums[label] = (found[label, 0], found[label, 1 : d + 1], found[label, d + 1 :].reshape(d, d))
    return fit(sums, d)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""
    stats = written(document_statistics(docs), "statistics")
    model = train(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), model.score(_matrix(batch.column(1)))], names=["doc_id", "score"])

    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
