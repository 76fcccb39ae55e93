"""Quality rules, with DataFrame functions only.

Rules on one document: too few words, too large a share of words inside repeated five-word windows.
Rule across documents: lines are normalised (lower case, white space runs to one blank, ends trimmed)
and hashed together with the host; a line found in more than ``max_docs`` different documents of one
host is boilerplate; a document whose boilerplate lines hold more than ``max_lost`` of the words of
its distinct lines is depleted.

Different documents means different texts: a thousand copies of one text count once, so a group of
copies is never taken for boilerplate (that is the work of the copy operators).

Boilerplate lines are removed: ``without_boilerplate`` and ``keep_clean`` give the text without them, the
lines left in their order and ``n_chars`` counted again; other rows stay as they are. All verdicts are
judged on the input text, before lines are removed.

Defined cases. A null text is an empty one: no words, ``base_failed``. A null host is a host of its
own. Repeated rows each get a row with the same result. Ties cannot occur. No input rows, no output
rows. Extra columns never clash: the input row travels in one struct. Windows, lines and texts are
compared by 64-bit hashes (windows within one text, lines within one host) or 128 bits (texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import text_of, words_of, written

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
#: Hashes of frequent lines that are sent to the rows (8 bytes each).
FREQUENT_LINES = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _window_hashes(word_hashes: Column) -> Column:
    """One hash for each run of five words; none for shorter texts."""
    starts = F.slice(word_hashes, 1, F.greatest(F.size(word_hashes) - (WINDOW - 1), F.lit(0)))
    return F.transform(
        starts, lambda h, i: F.xxhash64(h, *[F.get(word_hashes, i + k) for k in range(1, WINDOW)])
    )


def _covered(sorted_windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from (hash, position) structs in order."""
    same = F.filter(
        sorted_windows,
        lambda w, i: (F.get(sorted_windows, i + 1)["h"] == w["h"]) | (F.get(sorted_windows, i - 1)["h"] == w["h"]),
    )
    starts = F.sort_array(F.transform(same, lambda w: w["i"]))
    nothing = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        starts,
        nothing,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def with_base_counts(docs: DataFrame, min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """``row`` (the input row), the counts, ``base_failed`` and the text's key ``k1``, ``k2``."""
    text = text_of(F.col("row.text"))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.select("row", text.alias("t"), words_of(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("row", "t", "w", lines.alias("l"), F.transform("w", lambda w: F.xxhash64(w)).alias("wh"))
    df = df.select("row", "t", "w", "l", _window_hashes(F.col("wh")).alias("g"))
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    windows = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("row", "t", "w", "l", F.when(repeats, windows).alias("s"))
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), F.lit(0)).otherwise(_covered(F.col("s"))).cast("long").alias("n_repeat_words"),
        *text_key(F.col("row.source"), F.col("t")),
    )
    # a generator of one row: a filter on the counts stays above it, instead of being worked out again for every use
    df = df.select("row", F.explode(F.array(counts)).alias("c")).select("row", "c.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def text_key(host: Column, text: Column) -> list[Column]:
    """128 bits that stand for a text of one host."""
    return [F.xxhash64(host, text).alias("k1"), F.xxhash64(F.lit(7), F.length(text), text, host).alias("k2")]


def _text_lines(docs: DataFrame) -> DataFrame:
    """``host``, ``k1``, ``k2`` and the normalised ``lines`` of each row, not yet trimmed, empty ones too."""
    host, text = F.col("source").cast("string"), text_of(F.col("text"))
    plain = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    return docs.select(host.alias("host"), *text_key(host, text), F.split(plain, "\n").alias("lines"))


def line_documents(docs: DataFrame) -> DataFrame:
    """A row for each distinct line of each different text: ``line``, ``k1``, ``k2``, its words, the text's words."""
    df = _text_lines(docs)
    line = lambda x: F.struct(
        F.xxhash64(F.col("host"), x).alias("line"),
        (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"),
    )
    lines = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != F.lit(""))
    df = df.select("k1", "k2", F.array_distinct(F.transform(lines, line)).alias("lines"))
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"])
    # an outer explode: for the plain one the planner filters on the size of the lines first, working them out twice
    df = df.select("k1", "k2", total.alias("total"), F.explode_outer("lines").alias("x")).filter("x is not null").select("k1", "k2", "total", "x.*")
    return df.groupBy("line", "k1", "k2").agg(F.max("n").alias("n"), F.max("total").alias("total"))


def frequent_lines(pairs: DataFrame, max_docs: int) -> DataFrame:
    """``line``: those of ``line_documents`` found in more than ``max_docs`` texts."""
    # asking for the words here too keeps both uses of the pairs alike, so that they are worked out and shuffled once
    frequent = pairs.groupBy("line").agg(F.count("*").alias("docs"), F.max("n").alias("most"), F.max("total").alias("largest"))
    return frequent.filter((F.col("docs") > max_docs) & (F.col("most") > 0) & (F.col("largest") > 0)).select("line")


def boilerplate(docs: DataFrame, max_docs: int = 100) -> DataFrame:
    """The rows of ``line_documents`` that are boilerplate; the large side is never collected."""
    pairs = line_documents(docs)
    return pairs.join(frequent_lines(pairs, max_docs), "line")


def _lost(hits: DataFrame) -> DataFrame:
    return hits.groupBy("k1", "k2").agg(F.sum("n").alias("lost"), F.max("total").alias("total"))


def lost_words(docs: DataFrame, max_docs: int = 100) -> DataFrame:
    """``k1``, ``k2``, ``lost``, ``total`` for each text with boilerplate lines."""
    return _lost(boilerplate(docs, max_docs))


def line_places(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``gone``: where the boilerplate lines of each text with any stand, from 0."""
    df = _text_lines(docs)
    hashes = F.transform("lines", lambda x: F.xxhash64(F.col("host"), F.trim(x)))
    df = df.select("k1", "k2", F.posexplode_outer(hashes).alias("place", "line"))
    # rows of one text have the same places: each counts once, before they are gathered
    df = df.join(written(hits.select("line").distinct(), "lines"), "line").select("k1", "k2", "place").distinct()
    return df.groupBy("k1", "k2").agg(F.collect_list("place").alias("gone"))


def _without_places(df: DataFrame, columns: list[str]) -> DataFrame:
    """The input rows in ``row``, their texts without the lines at ``gone`` (null: as they are)."""
    lines = F.when(F.col("gone").isNotNull(), F.split("row.text", "\n"))
    df = df.select("row", "gone", lines.alias("lines"))
    # the difference of two arrays goes by hash, so the work grows with the lines of a text and no faster
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.transform(left, lambda i: F.get("lines", i))
    df = df.select("row", F.when(F.col("lines").isNotNull(), F.array_join(kept, "\n")).alias("t"))
    new = {"text": F.coalesce("t", "row.text")}
    if "n_chars" in columns:
        kind = df.schema["row"].dataType["n_chars"].dataType
        new["n_chars"] = F.when(F.col("t").isNotNull(), F.length("t").cast(kind)).otherwise(F.col("row.n_chars"))
    return df.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns])


def without_boilerplate(docs: DataFrame, max_docs: int = 100) -> DataFrame:
    """Every row, the boilerplate lines removed from its text and ``n_chars`` counted again."""
    gone = written(line_places(docs, written(boilerplate(docs, max_docs), "boilerplate")), "places")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.select("row", *text_key(F.col("row.source").cast("string"), text_of(F.col("row.text"))))
    return _without_places(df.join(gone, ["k1", "k2"], "left"), docs.columns)


def rate(docs: DataFrame, max_docs: int = 100, max_lost: float = 0.5) -> DataFrame:
    """Every row with its counts and verdicts: ``row``, counts, ``base_failed``, ``lost_share``, ``kept``."""
    lost = lost_words(docs, max_docs).select("k1", "k2", (F.col("lost") / F.col("total")).alias("lost_share"))
    df = with_base_counts(docs).join(lost, ["k1", "k2"], "left")
    share = F.coalesce("lost_share", F.lit(0.0))
    return df.select(
        "row", *COUNTS, "base_failed", share.alias("lost_share"), (~F.col("base_failed") & (share <= max_lost)).alias("kept")
    )


def keep_good(docs: DataFrame, max_docs: int = 100, max_lost: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass. Only keys of depleted texts meet the texts, so these are not shuffled for it."""
    lost = lost_words(docs, max_docs).filter(F.col("lost") > max_lost * F.col("total")).select("k1", "k2")
    good = with_base_counts(docs).filter(~F.col("base_failed"))
    return good.join(written(lost, "depleted"), ["k1", "k2"], "left_anti").select("row.*")


def _once(columns: dict[str, Column]) -> Column:
    """Columns worked out once, whatever is built on them: a generator of one row keeps projections from being merged."""
    return F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _with_places(df: DataFrame, frequent: list[int]) -> DataFrame:
    """``row`` with ``gone``, the places of its frequent lines (hashes, looked up in a set), and ``lost`` of ``total`` words of its different lines."""
    host, text = F.col("row.source").cast("string"), text_of(F.col("row.text"))
    plain = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    df = df.select("row", _once({"lines": F.transform(F.split(plain, "\n"), lambda x: F.trim(x))}).alias("x"))
    line = lambda x, i: F.struct(
        F.xxhash64(host, x).alias("line"),
        F.when(x != F.lit(""), F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).otherwise(0).alias("n"),
        i.alias("i"),
    )
    df = df.select("row", _once({"lines": F.transform("x.lines", line)}).alias("x"))
    hits = F.filter("x.lines", lambda x: (x["n"] > 0) & x["line"].isin(frequent))
    df = df.select("row", _once({"lines": F.col("x.lines"), "hits": hits}).alias("x"))
    words = lambda own: F.aggregate(
        F.array_distinct(F.transform(own, lambda x: F.struct(x["line"], x["n"]))), F.lit(0), lambda a, x: a + x["n"]
    )
    some = F.size("x.hits") > 0
    return df.select(
        "row", F.when(some, F.transform("x.hits", lambda x: x["i"])).alias("gone"),
        F.when(some, words(F.col("x.hits"))).otherwise(0).alias("lost"), F.when(some, words(F.col("x.lines"))).alias("total"),
    )


def keep_clean(docs: DataFrame, max_docs: int = 100, max_lost: float = 0.5) -> DataFrame:
    """The rows that ``keep_good`` keeps, judged on the input, without the boilerplate lines of their texts.

    Lines are counted first; the hashes of frequent ones, counted against ``FREQUENT_LINES``, then come to the rows,
    so no text is shuffled. Beyond that many, the places of the lines are joined to the texts by shuffle."""
    frequent = written(frequent_lines(line_documents(docs), max_docs), "frequent-lines")
    good = with_base_counts(docs).filter(~F.col("base_failed")).select("row", "k1", "k2")
    if frequent.count() <= FREQUENT_LINES:
        df = _with_places(good.select("row"), [r["line"] for r in frequent.collect()])
        return _without_places(df.filter(F.col("gone").isNull() | (F.col("lost") <= max_lost * F.col("total"))), docs.columns)
    hits = written(boilerplate(docs, max_docs), "boilerplate")
    gone = line_places(docs, hits).join(_lost(hits), ["k1", "k2"])
    df = good.join(written(gone, "places"), ["k1", "k2"], "left")
    df = df.filter(F.col("lost").isNull() | (F.col("lost") <= max_lost * F.col("total")))
    return _without_places(df, docs.columns)
