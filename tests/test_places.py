"""All terms in one pass against counting and looking for each term alone."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flagstone import strategies
from flagstone.functions import places as P

TERMS = ("a", "aa", "aba", "ab", "b1", "1", "é😀", "😀", "note 1", "e\u0301")


def plain_best(text, heading, window):
    found = [m.start() for m in re.finditer(re.escape(heading), text)]
    digits = [sum(c in "0123456789" for c in text[x + len(heading) : x + len(heading) + window]) for x in found]
    return found[digits.index(max(digits))] if found else None


@given(st.text(st.sampled_from("ab1é😀 not\u0301e9"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_occurrences(text):
    got: dict[str, list[int]] = {}
    for i, end in P.occurrences(text, TERMS):
        got.setdefault(TERMS[i], []).append(end)
    assert got == {t: [m.end() for m in re.finditer(re.escape(t), text)] for t in TERMS if t in text}
    before = P.digits_before(text)
    assert [int(before[i]) for i in range(len(text) + 1)] == [sum(c in "0123456789" for c in text[:i]) for i in range(len(text) + 1)]


def test_columns(spark):
    texts = ["aabaab1 note 1 😀é😀 11", "", None, "zzz", "note 1 note 1 2024 note 1 2024", "x" * 50_000 + "note 1 7"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, low string").repartition(3)
    rows = df.select("id", P.term_counts(F.col("low"), [*TERMS, "", "a"]).alias("n"), P.heading_places(F.col("low"), TERMS, 5).alias("at")).collect()
    for r in rows:
        text = texts[r["id"]]
        if text is None:
            assert r["n"] is None and r["at"] is None
        else:
            assert r["n"] == {t: text.count(t) for t in TERMS if t in text}
            assert r["at"] == {t: plain_best(text, t, 5) for t in TERMS if t in text}


def test_every_strategy_at_once(spark):
    """All keywords and headings of the strategies over one table, against counting each alone."""
    known = [s for table in (strategies.BY_ITEM, strategies.BY_SECTION) for s in table.values() if isinstance(s, strategies.Strategy)]
    terms = sorted({k.lower() for s in known for k in (*s.keywords, *s.headings)})
    assert len(terms) > 100
    texts = [" ".join(terms[k::7]) + f" {k} " + "".join(terms[k::5]) for k in range(7)]
    df = spark.createDataFrame([(t,) for t in texts], "low string")
    for r in df.select("low", P.term_counts(F.col("low"), terms).alias("n")).collect():
        assert r["n"] == {t: r["low"].count(t) for t in terms if t in r["low"]}


def test_texts_are_read_once(spark, tables):
    """The automaton runs once over a chunk, whatever uses its result."""
    from flagstone.catalog import load_all

    plan = load_all()["keyword_score"].run(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
