"""Which source answers which item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone import strategies as ST
from flagstone.functions.predicates import item_kind
from flagstone.functions.text import keywords_from

_NONE = "cast(array() as array<string>)"


def _words(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr(_NONE)


def _strategy(s: ST.Strategy) -> Column:
    return F.struct(
        F.lit(s.source).alias("source"), F.lit(s.metric).cast("string").alias("metric"), _words(s.doc_types).alias("doc_types"),
        _words(s.headings).alias("headings"), _words(s.keywords).alias("keywords"), F.lit(s.note_mode).alias("note_mode"),
        F.lit(s.web_topic).cast("string").alias("web_topic"),
    )


def _lookup(key: Column, table: dict[str, Column]) -> Column:
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])
    return F.try_element_at(entries, key)


def route_items(items: DataFrame) -> DataFrame:
    """Adds source, metric, doc_types, headings, keywords, note_mode, web_topic and expected_na.

    An item's own strategy comes first, then its section's profile, then its kind's default; items
    that live in outside research get the research topic on top. The tables are configuration and
    travel as literals. Needs item_id, section_code, item, output_format and source_hint.
    """
    own = _lookup(F.col("item_id"), {i: _strategy(s) for i, s in ST.BY_ITEM.items()})
    profile = _lookup(F.col("section_code"), {c: _strategy(s) for c, s in ST.BY_SECTION.items()})
    doc_types = F.coalesce(
        _lookup(F.col("section_code"), {c: _words(t) for c, t in ST.SECTION_DOC_TYPES.items()}), _words(["ANNUAL_REPORT"])
    )
    words = keywords_from(F.col("item"), F.col("source_hint"))
    longest = F.get(
        F.array_sort(
            F.filter(F.split(F.lower("item"), "[^a-z0-9]+"), lambda w: w != ""),
            lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0),
        ),
        F.lit(0),
    )
    from_section = F.when(
        profile.isNotNull(),
        F.struct(
            F.lit("document").alias("source"), F.lit(None).cast("string").alias("metric"),
            F.when(F.size(profile["doc_types"]) > 0, profile["doc_types"]).otherwise(doc_types).alias("doc_types"),
            profile["headings"].alias("headings"),
            F.slice(F.array_distinct(F.concat(profile["keywords"], words)), 1, 12).alias("keywords"),
            profile["note_mode"].alias("note_mode"), F.lit(None).cast("string").alias("web_topic"),
        ),
    )
    none = F.expr(_NONE)
    numeric = F.struct(
        F.lit("structured").alias("source"), F.concat(F.lit("ratio:"), longest).alias("metric"), none.alias("doc_types"),
        none.alias("headings"), none.alias("keywords"), F.lit(False).alias("note_mode"), F.lit(None).cast("string").alias("web_topic"),
    )
    qualitative = F.struct(
        F.lit("document").alias("source"), F.lit(None).cast("string").alias("metric"), doc_types.alias("doc_types"),
        none.alias("headings"), words.alias("keywords"), F.lit(False).alias("note_mode"), F.lit(None).cast("string").alias("web_topic"),
    )
    default = F.when(item_kind(F.col("output_format")) == "NUMERIC", numeric).otherwise(qualitative)
    topic = _lookup(F.col("item_id"), {i: F.lit(t) for i, t in ST.WEB_TOPICS.items()})
    routed = items.withColumn("_s", F.coalesce(own, from_section, default))
    return routed.select(
        *items.columns, "_s.source", "_s.metric", "_s.doc_types", "_s.headings", "_s.keywords", "_s.note_mode",
        F.coalesce("_s.web_topic", topic).alias("web_topic"), topic.isNotNull().alias("expected_na"),
    )


