"""Mixing sources to target weights by Pareto order sampling.

Sources share ``share`` times all words by weight; no source is taken beyond ``most`` times its own
words, and the excess is shared again by weight until none is above. With ratio r = target / size
every document gets floor(r) whole copies for certain. What is then missing of the target is drawn with unequal
chances: a document's inclusion chance p grows with its measure, the whole square root of its words (a long
document stands for more different text than its number, and for less than its length), p = min(1, c * measure)
with c such that the expected words, the sum of p * size, are those missing; documents that reach 1 are certain and
c is worked out for the others again. Documents are ranked by odds(u) / odds(p), u being a hash of seed, doc_id and
text, certain ones first, and taken in that order up to the words still missing; the document that crosses the mark
is taken if that comes nearer. c needs the words of each measure only, so a source is a few hundred rows for it.

The cut in a source's order is found by halves of the rank: words per coarse bin, words per fine bin
inside the bin that crosses, then the few documents of that fine bin. So no source is ever ordered in
one task, and a document needs only its source's cut to know its copies.

Defined cases. A null text has size 0 and takes 0. A null source is a source of its own, the last. A
source without words has target 0. A very long text counts whole and may exceed what is missing: it is then
taken or left, whichever comes nearer. Rows alike in doc_id and text share one rank and one fate. An empty
table gives no rows. Extra columns are kept by ``mix`` and never clash (they travel in one struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagstone.llm.common import text_of, words_of, written

WEIGHTS = (3, 1, 2)
BINS = 4096
SEED = "mix-1"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``row``, its ``source``, ``size`` in words, random ``u`` in (0, 1) and ``measure``."""
    text = text_of(F.col("text"))
    ident = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    bits = F.conv(F.substring(F.md5(ident.cast("binary")), 1, 13), 16, 10).cast("long")
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        ((bits + 0.5) / float(1 << 52)).alias("u"),
    )
    return df.withColumn("measure", F.floor(F.sqrt("size")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``certain``, ``missing``: one row per source."""
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    df = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    df = df.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), place % len(weights)).alias("weight"))
    cap = F.col("source_size") * F.lit(most)
    df = df.select(
        "*", cap.alias("cap"), (F.sum("source_size").over(everything) * F.lit(share)).alias("all"), F.sum("weight").over(everything).alias("all_w")
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    given, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.select("*", ((F.col("all") - given) / (F.col("all_w") - used)).alias("unit"))
    df = df.select("*", (F.col("weight") * F.col("unit") > F.col("cap")).alias("full"))
    # units only fall while sources are full and then rise no more above the first free one
    free = F.min_by(F.when(~F.col("full"), F.col("unit")), F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "source"))).over(everything)
    df = df.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * free).alias("target"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    df = df.select("*", F.floor(ratio).alias("certain"))
    return df.select("*", (F.col("target") - F.col("certain") * F.col("source_size")).alias("missing"))


def with_chances(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``c``: a document of the source is included with the chance min(1, c * measure)."""
    measures = sizes.groupBy("source", "measure").agg(F.sum("size").alias("words")).filter("words > 0")
    df = _with_targets(measures, targets).filter("missing > 0")
    larger = Window.partitionBy("source").orderBy(F.desc("measure")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy(F.desc("measure")).rowsBetween(0, Window.unboundedFollowing)
    # whole numbers in doubles: the sums are exact, whatever their order
    left = F.col("missing") - F.coalesce(F.sum(F.col("words").cast("double")).over(larger), F.lit(0.0))
    df = df.select("source", "measure", (left / F.sum((F.col("measure") * F.col("words")).cast("double")).over(others)).alias("c"))
    # the largest measure that stays under 1 when all larger ones are certain
    found = df.filter(F.col("c") * F.col("measure") < 1).groupBy("source").agg(F.max_by("c", "measure").alias("c"))
    return targets.join(found.withColumnRenamed("source", "source_f"), F.col("source").eqNullSafe(F.col("source_f")), "left").drop("source_f")


def rank_of() -> Column:
    """Random odds over inclusion odds, brought to [0, 1); certain documents have rank 0."""
    p = F.col("c") * F.col("measure")
    odds = F.col("u") / (1 - F.col("u")) * ((1 - p) / p)
    return F.when((F.col("size") == 0) | F.col("c").isNull(), F.col("u")).when(p >= 1, F.lit(0.0)).otherwise(odds / (1 + odds))


def _crossing(bins: DataFrame, by: str, missing: str) -> DataFrame:
    """The bin of each source in which its words reach ``missing``, and what is missing before it."""
    total = F.sum("size").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    df = bins.select("*", total.alias("total"))
    left = F.col(missing) - (F.col("total") - F.col("size"))
    return df.filter((F.col("total") >= F.col(missing)) & (left > 0)).select("source", by, left.alias("left"))


def cuts(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``cut``: documents ranked up to it get one more copy; sources that take none are left out."""
    ranked = _with_targets(slim, targets).filter("missing > 0 AND size > 0").select("source", "size", "missing", rank_of().alias("v"))
    high, low = F.floor(F.col("v") * BINS).cast("int"), F.floor(F.col("v") * BINS * BINS % BINS).cast("int")
    ranked = ranked.select("*", high.alias("high"), low.alias("low"))
    coarse = _crossing(ranked.groupBy("source", "missing", "high").agg(F.sum("size").alias("size")), "high", "missing")
    coarse = written(coarse, "coarse").withColumnsRenamed({"source": "s", "high": "h", "left": "l"})
    inside = ranked.join(coarse, F.col("source").eqNullSafe(F.col("s")) & (F.col("high") == F.col("h")))
    fine = _crossing(inside.groupBy("source", "l", "low").agg(F.sum("size").alias("size")), "low", "l")
    fine = written(fine, "fine").withColumnsRenamed({"source": "s2", "low": "b", "left": "missing2"})
    last = inside.join(fine, F.col("source").eqNullSafe(F.col("s2")) & (F.col("low") == F.col("b")))
    last = last.groupBy("source", "missing2", "high", "low", "v").agg(F.sum("size").alias("size"))
    total = F.sum("size").over(Window.partitionBy("source").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    last = last.select("*", total.alias("total"))
    nearer = (F.col("total") - F.col("missing2")) < (F.col("missing2") - (F.col("total") - F.col("size")))
    taken = last.filter((F.col("total") <= F.col("missing2")) | nearer)
    found = taken.groupBy("source").agg(F.max("v").alias("cut"))
    # nothing of the last fine bin is taken: the cut lies at the bin's lower edge
    edges = fine.join(coarse, F.col("s2").eqNullSafe(F.col("s"))).select(
        F.col("s2").alias("source"), ((F.col("h") + F.col("b") / BINS) / BINS).alias("edge")
    )
    edges = edges.withColumnRenamed("source", "s3")
    every = targets.filter("missing > 0").select(F.col("source").alias("s4"))
    df = every.join(found, F.col("s4").eqNullSafe(F.col("source")), "left").join(edges, F.col("s4").eqNullSafe(F.col("s3")), "left")
    # less is missing than a source has, so some bin reaches it
    without = F.raise_error(F.concat(F.lit("no cut for source "), F.coalesce("s4", F.lit("null")))).cast("double")
    return df.select(F.col("s4").alias("source"), F.coalesce("cut", "edge", without).alias("cut"))


def _with_targets(df: DataFrame, targets: DataFrame) -> DataFrame:
    other = targets.withColumnRenamed("source", "source_")
    return df.join(other, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def plan(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Each row with ``size``, ``source_size``, ``target`` and ``copies``."""
    rows = sized(docs, seed)
    slim = written(rows.select("source", "size", "u", "measure"), "sizes")
    targets = written(with_chances(slim, source_targets(slim, **options)), "targets")
    cut = cuts(slim, targets).withColumnRenamed("source", "source_c")
    known = targets.join(cut, F.col("source").eqNullSafe(F.col("source_c")), "left").drop("source_c")
    df = _with_targets(rows, written(known, "cuts"))
    extra = F.coalesce(rank_of() <= F.col("cut"), F.lit(False)).cast("long")
    return df.select("row", "size", "source_size", "target", (F.col("certain") + extra).alias("copies"))


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    return plan(docs, seed, **options).select("row", F.explode(F.expr("array_repeat(0, int(copies))"))).select("row.*")
