"""Passages from long text: pages, headings, keywords, top-k under a character budget."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions import text as X
from flagstone.functions.places import heading_places, term_counts
from flagstone.operators.ordering import top_k


@dataclass(frozen=True)
class Search:
    """What to look for on behalf of one item."""

    item_id: str
    doc_types: tuple[str, ...]
    keywords: tuple[str, ...] = ()
    headings: tuple[str, ...] = ()
    note_mode: bool = False

    @property
    def terms(self) -> list[str]:
        return [k.lower() for k in self.keywords if k]


def split_pages(documents: DataFrame, size: int = fixed.CHUNK_CHARS) -> DataFrame:
    """Documents to chunks: one per page marker, else pieces of `size` characters without a page.

    A row expansion: long texts are cut before anything is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(fixed.PAGE_MARKER), 1)
    pieces = F.split(text, fixed.PAGE_MARKER)
    paged = F.transform(
        F.arrays_zip(numbers.alias("n"), F.slice(pieces, F.lit(2), F.greatest(F.size(numbers), F.lit(1))).alias("t")),
        lambda x: F.struct(x["n"].try_cast("int").alias("page"), X.trim_all(x["t"]).alias("chunk")),
    )
    count = F.ceil(F.length(text) / F.lit(size)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            F.lit(None).cast("int").alias("page"),
            F.substring(text, i * F.lit(size) + 1, F.lit(size)).alias("chunk"),
        ),
    )
    chunks = F.when(F.size(numbers) > 0, paged).when(count > 0, cut)
    others = [c for c in documents.columns if c != "text"]
    return documents.select(*others, F.posexplode(chunks).alias("chunk_idx", "_c")).select(
        *others, "chunk_idx", "_c.page", "_c.chunk"
    )


def score_chunks(chunks: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """(chunk, item) pairs with a keyword score above zero.

    All terms are counted in one pass over a chunk; items then add up their own terms. Nothing is
    paired up or shuffled to be thrown away.
    """
    terms = sorted({t for s in searches for t in s.terms})
    wanted = F.array(
        *[
            F.struct(
                F.lit(s.item_id).alias("item_id"),
                F.array(*[F.lit(t) for t in s.doc_types]).alias("doc_types"),
                F.array(*[F.lit(t) for t in s.terms]).cast("array<string>").alias("terms"),
            )
            for s in searches
            if s.terms
        ]
    ).cast("array<struct<item_id:string,doc_types:array<string>,terms:array<string>>>")
    scored = F.filter(
        F.transform(
            wanted,
            lambda s: F.struct(
                s["item_id"].alias("item_id"),
                s["terms"].alias("terms"),
                F.when(
                    readable(s["doc_types"]),
                    F.aggregate(
                        s["terms"],
                        F.lit(0).cast("bigint"),
                        lambda acc, t: acc + F.coalesce(F.try_element_at(F.col("_hits"), t), F.lit(0).cast("bigint")),
                    ),
                ).alias("score"),
            ),
        ),
        lambda s: s["score"] > 0,
    )
    return (
        chunks.withColumn("_low", F.lower("chunk"))
        .withColumn("_hits", term_counts(F.col("_low"), terms))
        .filter(F.size("_hits") > 0)
        .select(*chunks.columns, F.explode(scored).alias("_s"))
        .select(*chunks.columns, "_s.item_id", "_s.terms", "_s.score")
    )


def readable(doc_types: Column) -> Column:
    """An unlisted run reads whatever it has, others the item's document types."""
    return F.col("unlisted") | F.array_contains(doc_types, F.col("doc_type"))


def top_passages(chunks: DataFrame, searches: Sequence[Search], k: int = fixed.PASSAGES_KEPT) -> DataFrame:
    """The k best chunks of each run and item as excerpts; ties keep document and page order."""
    scored = score_chunks(chunks, searches).withColumn("passage", X.excerpt(F.col("chunk"), F.col("terms")))
    light = scored.drop("chunk", "terms").filter(F.length(X.trim_all(F.col("passage"))) > 0)
    return top_k(light, ["run_id", "item_id"], [F.desc("score"), F.asc("doc_order"), F.asc("chunk_idx")], k)


def apply_budget(passages: DataFrame, budget: Column) -> DataFrame:
    """Keep passages in rank order while characters are left; clip the last one."""
    before = Window.partitionBy("run_id", "item_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("passage")).over(before), F.lit(0))
    return (
        passages.withColumn("_left", budget - used)
        .filter(F.col("_left") > 0)
        .withColumn("passage", F.substring(F.col("passage"), F.lit(1), F.col("_left").cast("int")))
        .drop("_left")
    )


def page_at(text: Column, offset: Column) -> Column:
    """Number of the last page marker before an offset."""
    numbers = F.regexp_extract_all(F.substring(text, F.lit(1), offset), F.lit(fixed.PAGE_MARKER), 1)
    return F.try_element_at(numbers, F.lit(-1)).try_cast("int")


def heading_sections(documents: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """Every located heading with the text window behind it, one row per document, item and heading."""
    headings = sorted({h.lower() for s in searches for h in s.headings})
    wanted = F.array(
        *[
            F.struct(
                F.lit(s.item_id).alias("item_id"),
                F.array(*[F.lit(t) for t in s.doc_types]).alias("doc_types"),
                F.lit(i).alias("heading_idx"),
                F.lit(h.lower()).alias("heading"),
                F.lit(fixed.NOTE_WINDOW if s.note_mode else fixed.SECTION_WINDOW).alias("window"),
                F.lit(fixed.NOTE_BUDGET if s.note_mode else fixed.PASSAGE_BUDGET).alias("budget"),
            )
            for s in searches
            for i, h in enumerate(s.headings)
        ]
    ).cast("array<struct<item_id:string,doc_types:array<string>,heading_idx:int,heading:string,window:int,budget:int>>")
    hit = F.filter(
        wanted,
        lambda w: readable(w["doc_types"]) & F.map_contains_key(F.col("_places"), w["heading"]),
    )
    others = [c for c in documents.columns if c != "text"]
    found = (
        documents.withColumn("_low", F.lower("text"))
        .withColumn("_places", heading_places(F.col("_low"), headings))
        .filter(F.size("_places") > 0)
        .select(*others, "text", "_places", F.explode(hit).alias("_h"))
        .select(*others, "text", "_h.*", F.element_at(F.col("_places"), F.col("_h.heading")).alias("at"))
    )
    body = X.trim_all(F.substring(F.col("text"), F.col("at") + 1, F.col("window")))
    return (
        found.withColumn("page", page_at(F.col("text"), F.col("at")))
        .withColumn("passage", body)
        .drop("text", "doc_types")
        .filter(F.length("passage") > 0)
    )


def heading_passages(documents: DataFrame, searches: Sequence[Search], k: int = fixed.PASSAGES_KEPT) -> DataFrame:
    """The first k located sections of each run and item within its budget."""
    kept = top_k(
        heading_sections(documents, searches), ["run_id", "item_id"], [F.asc("doc_order"), F.asc("heading_idx")], k
    )
    return apply_budget(kept, F.col("budget"))


def document_evidence(documents: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """Passages of each run and item: by heading where one is found, else by keyword.

    Needs run_id, doc_id, doc_order, doc_type, unlisted and text; fetch_status is heeded and url carried if there.
    """
    documents = with_text(documents)
    by_heading = heading_passages(documents, [s for s in searches if s.headings])
    columns = ["run_id", "item_id", "rn", "doc_id", "page", "passage", *(["url"] if "url" in documents.columns else [])]
    by_keyword = apply_budget(top_passages(split_pages(documents), searches), F.lit(fixed.PASSAGE_BUDGET))
    both = by_heading.select(*columns, F.lit("heading").alias("found_by")).unionByName(
        by_keyword.select(*columns, F.lit("keyword").alias("found_by"))
    )
    # a key has at most twice the passages kept, so looking both ways at once is cheaper than locating headings twice
    any_heading = F.max(F.col("found_by") == "heading").over(Window.partitionBy("run_id", "item_id"))
    return both.withColumn("_any", any_heading).filter((F.col("found_by") == "heading") | ~F.col("_any")).drop("_any")


def dedup_by_hash(documents: DataFrame, keys: Sequence[str] = ("run_id",), order: str = "doc_order") -> DataFrame:
    """The first of equal texts keeps its text, the others only name it.

    Empty texts and documents that were not fetched have no hash and are nobody's copies. Only texts
    that occur twice are looked up; the lookup side has one row per text, so a text with
    very many copies is split by the adaptive skew join rather than gathered in one window.
    """
    hashed = documents.withColumn("content_hash", F.when((F.col("text") != "") & _fetched(documents), X.fingerprint(F.col("text"))))
    on = [*keys, "content_hash"]
    copies = (
        hashed.groupBy(*on)
        .agg(F.min_by("url", order).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > 1) & F.col("content_hash").isNotNull())
        .drop("_n")
    )
    joined = hashed.join(copies, on, "left")
    copy = F.col("_first").isNotNull() & (F.col("_first") != F.col("url"))
    return (
        joined.withColumn("note", F.when(copy, F.concat(F.lit(fixed.DUPLICATE_PREFIX), F.col("_first"))))
        .withColumn("text", F.when(~copy, F.col("text")))
        .drop("_first")
    )


def with_text(documents: DataFrame) -> DataFrame:
    """Documents with text; where a fetch status is known it must be OK."""
    some = F.col("text").isNotNull() & (F.col("text") != "")
    return documents.filter(some & _fetched(documents))


def _fetched(documents: DataFrame) -> Column:
    return F.col("fetch_status") == "OK" if "fetch_status" in documents.columns else F.lit(True)


def plan_refetch(links: DataFrame, documents: DataFrame) -> DataFrame:
    """What to do about each link: reuse a stored document, or fetch it (again)."""
    stored = documents.select(
        "run_id", "url", "fetch_status", F.col("text").isNotNull().alias("has_text"),
        F.coalesce(F.col("note").startswith(fixed.DUPLICATE_PREFIX), F.lit(False)).alias("is_copy"),
    )
    usable = (F.col("fetch_status") == "OK") & (F.col("has_text") | F.col("is_copy"))
    return links.join(stored, ["run_id", "url"], "left").withColumn(
        "action",
        F.when(F.col("fetch_status").isNull(), "fetch")
        .when(usable, "reuse")
        .when(F.col("fetch_status") == "OK", "refetch_pruned")
        .otherwise("refetch_failed"),
    )


def select_feed(documents: DataFrame, max_chars: int = fixed.FEED_CHARS, pieces: int = 64) -> DataFrame:
    """Documents to read for a run's statements, in order until the characters are used up.

    Only documents that were fetched and have text are read; statement-like names alone when there
    are any. Each of them uses up its heading, some thirty characters, so more documents than
    max_chars/30 can never fit: an exact bound, applied per piece of a run first, keeps a run with
    very many documents out of one task.
    """
    head, tail = "\n===== DOCUMENT: ", " =====\n"
    size = F.length(F.concat(F.lit(head), F.coalesce("name", F.lit("financials")), F.lit(tail))) + F.length("text") + 1
    bound = max_chars // (len(head) + len(tail) + 1) + 1
    named = with_text(documents).withColumn("is_statement", F.coalesce(F.col("name").rlike(fixed.STATEMENT_NAME), F.lit(False)))
    some = named.filter("is_statement").select("run_id").distinct().withColumn("_some", F.lit(True))
    fed = named.join(some, "run_id", "left").filter(F.col("_some").isNull() | F.col("is_statement")).drop("_some")
    fed = fed.withColumn("chars", size).drop("text").withColumn("_piece", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))
    cut = top_k(fed, ["run_id", "_piece"], [F.asc("doc_order")], bound, "_rn").drop("_rn", "_piece")
    before = Window.partitionBy("run_id").orderBy("doc_order").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("chars_before", F.coalesce(F.sum("chars").over(before), F.lit(0))).filter(
        F.col("chars_before") < max_chars
    )
