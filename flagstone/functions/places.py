"""Many terms in one pass over a text: an automaton of all terms yields every place where one of them ends.

The cost grows with the text and with what is found, not with the number of terms. Texts come lower-cased as Spark
does it, so places count the same characters as Spark's own functions. An occurrence counts if it does not overlap the
last one counted of the same term; different terms may overlap.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from flagstone import fixed


@functools.lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(term, i)
    found.make_automaton()
    return found


def occurrences(text: str, terms: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """(term, end) of every occurrence, in the order of their ends; those of one term do not overlap."""
    last: dict[int, int] = {}
    for at, i in automaton(terms).iter(text):
        if at + 1 - len(terms[i]) >= last.get(i, 0):
            last[i] = at + 1
            yield i, at + 1


def _mapped(texts: pa.Array, terms: tuple[str, ...], of_text, kind: pa.DataType) -> pa.Array:
    """A map from term to number for each text; null for null."""
    offsets, keys, values = [], [], []
    for text in texts.to_pylist():
        offsets.append(None if text is None else len(keys))
        for i, v in of_text(text).items() if text else ():
            keys.append(terms[i])
            values.append(v)
    return pa.MapArray.from_arrays(pa.array([*offsets, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(values, kind))


def _once(run, kind: str):
    """A function of Arrow arrays that filters on its result do not work out a second time."""
    return F.arrow_udf(run, kind).asNondeterministic()


def term_counts(low: Column, terms: Sequence[str]) -> Column:
    """Map from each term found in a lower-cased text to its number of occurrences; empty terms are never found."""
    wanted = tuple(dict.fromkeys(t for t in terms if t))
    if not wanted:
        return F.expr("cast(map() as map<string,bigint>)")

    def count(text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, _ in occurrences(text, wanted):
            out[i] = out.get(i, 0) + 1
        return out

    def run(texts: pa.Array) -> pa.Array:
        return _mapped(texts, wanted, count, pa.int64())

    return _once(run, "map<string,bigint>")(low)


def digits_before(text: str) -> np.ndarray:
    """How many of 0-9 stand before each place of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum((codes >= ord("0")) & (codes <= ord("9")), out=out[1:])
    return out


def heading_places(low: Column, headings: Sequence[str], window: int = fixed.HEADING_DIGIT_WINDOW) -> Column:
    """Map from each heading found in a lower-cased text to the 0-based place of its best occurrence.

    A contents line is followed by few digits, the note itself by many: the occurrence with the most digits in the
    ``window`` behind it is the best, the first of several."""
    wanted = tuple(dict.fromkeys(h for h in headings if h))
    if not wanted:
        return F.expr("cast(map() as map<string,int>)")

    def best(text: str) -> dict[int, int]:
        found = list(occurrences(text, wanted))
        if not found:
            return {}
        before = digits_before(text)
        out: dict[int, tuple[int, int]] = {}
        for i, end in found:
            digits = int(before[min(end + window, len(text))] - before[end])
            if i not in out or digits > out[i][0]:
                out[i] = (digits, end - len(wanted[i]))
        return {i: at for i, (_, at) in out.items()}

    def run(texts: pa.Array) -> pa.Array:
        return _mapped(texts, wanted, best, pa.int32())

    return _once(run, "map<string,int>")(low)
