"""The evidence stage: what each run and item can be judged by, where that stands, and what a reading of it says.

Passages of documents and hits of outside research are bounded per run and item before they come here. Each is folded
to one row per run or company that holds places only, no texts; the choice between the sources is then an expression
over one row per run, and its result goes into the assessment as it is. Texts go nowhere but to the reader.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.functions import predicates as P
from flagstone.operators.research import research_hits
from flagstone.operators.retrieve import Search, document_evidence
from flagstone.operators.routing import route_items
from flagstone.operators.state import Checklist
from flagstone.plans.stages import Stages

READING = ["page", "value", "evidence", "rationale", "confidence", "provider", "error"]
LINEAGE = ["doc_id", "page", "url", "confidence", "reader", "error"]


@dataclass(frozen=True)
class Route:
    """Where the evidence of one item is looked for, and in which order."""

    search: Search
    web: bool = False
    web_first: bool = False

    @property
    def reads_documents(self) -> bool:
        return bool(self.search.headings or self.search.terms)


def routes_of(spark: SparkSession, checklist: Checklist) -> list[Route]:
    """The routes of a checklist's items. The checklist is configuration, so its routes are too."""
    return [
        Route(
            Search(r.item_id, tuple(r.doc_types), tuple(r.keywords), tuple(r.headings), r.note_mode),
            web=r.source != "structured" and r.web_topic is not None,
            web_first=r.source != "structured" and r.expected_na,
        )
        for r in route_items(checklist.table(spark)).collect()
    ]


def searches(routes: Sequence[Route]) -> list[Search]:
    return [r.search for r in routes if r.reads_documents]


def _literal(routes: Sequence[Route]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.search.item_id).alias("item_id"), F.lit(r.reads_documents).alias("documents"),
                F.lit(r.web).alias("web"), F.lit(r.web_first).alias("web_first"),
            )
            for r in routes
        ]
    )


def _folded(rows: DataFrame, key: str, items: Sequence[str], places: Column, name: str) -> DataFrame:
    """One row per key: map item -> something bounded for each item."""
    cells = rows.filter(F.col("item_id").isin(*items)).groupBy(key, "item_id").agg(places.alias("_cell"))
    return cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("item_id", "_cell"))).alias(name))


def _places(doc_id: Column, page: Column) -> Column:
    place = F.struct(
        F.col("rn").cast("int").alias("rn"), doc_id.cast("bigint").alias("doc_id"), F.col("url").alias("url"),
        page.cast("int").alias("page"),
    )
    return F.sort_array(F.collect_list(place))


def choose_places(runs: DataFrame, routes: Sequence[Route], passages: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per run with `_chosen`: map item -> struct(source, places, note), an entry for every route.

    Documents come first and outside research second; an item that lives in outside research looks there first, unless
    the company is unlisted, whose own documents outrank namesakes on the web. An item read from statements never asks
    outside. Needs runs (run_id, company_id, ticker), passages (run_id, item_id, rn, doc_id, url, page) and hits
    (company_id, item_id, rn, url). Without either there is no source and the note says where was looked.
    """
    items = [r.search.item_id for r in routes]
    nothing = F.lit(None)
    by_run = _folded(passages, "run_id", items, _places(F.col("doc_id"), F.col("page")), "_documents")
    by_company = _folded(hits, "company_id", items, _places(nothing, nothing), "_web")
    joined = runs.join(by_run, "run_id", "left").join(by_company, "company_id", "left")
    unlisted = P.is_unlisted(F.col("ticker"))

    def entry(r: Column) -> Column:
        inside = F.when(r["documents"], F.try_element_at(F.col("_documents"), r["item_id"]))
        outside = F.when(r["web"], F.try_element_at(F.col("_web"), r["item_id"]))
        first = r["web_first"] & ~unlisted & outside.isNotNull()
        source = F.when(first, "web").when(inside.isNotNull(), "document").when(outside.isNotNull(), "web")
        note = (
            F.when(inside.isNotNull() | outside.isNotNull(), F.lit(None).cast("string"))
            .when(r["documents"] & r["web"], "no passage and no hit")
            .when(r["documents"], "no passage")
            .when(r["web"], "no hit")
            .otherwise("nothing to look in")
        )
        places = F.when(first, outside).otherwise(F.coalesce(inside, outside))
        return F.struct(r["item_id"], F.struct(source.alias("source"), places.alias("places"), note.alias("note")))

    chosen = F.map_from_entries(F.transform(_literal(routes), entry))
    return joined.select(*runs.columns, chosen.alias("_chosen"))


def cited(places: Column, page: Column) -> Column:
    """The place on the page that was read, else the first one."""
    on_page = F.filter(places, lambda p: p["page"] == page)
    return F.coalesce(F.get(on_page, F.lit(0)), F.get(places, F.lit(0)))


def evidence_rows(chosen: DataFrame) -> DataFrame:
    """Every run and item with its source, number of places, first place and note."""
    rows = chosen.select("run_id", "company_id", F.explode("_chosen").alias("item_id", "_c"))
    first = F.get(F.col("_c.places"), F.lit(0))
    return rows.select(
        "run_id", "company_id", "item_id", "_c.source", F.coalesce(F.size("_c.places"), F.lit(0)).alias("places"),
        first["doc_id"].alias("doc_id"), first["url"].alias("url"), first["page"].alias("page"), "_c.note",
    )


def to_read(chosen: DataFrame, passages: DataFrame, hits: DataFrame, readings: DataFrame) -> DataFrame:
    """The texts a reader gets: passages of the chosen source of each run and item not read yet.

    A reading that ended in an error is asked for again, any other answer is final, so a restarted reader is asked
    nothing twice.
    """
    rows = chosen.select("run_id", "company_id", F.explode("_chosen").alias("item_id", "_c"))
    wanted = rows.select("run_id", "company_id", "item_id", F.col("_c.source").alias("source")).filter("source IS NOT NULL")
    answered = readings.filter(F.col("error").isNull()).select("run_id", "item_id").distinct()
    open_ = wanted.join(answered, ["run_id", "item_id"], "left_anti")
    none = F.lit(None)
    inside = passages.join(open_.filter("source = 'document'").drop("company_id"), ["run_id", "item_id"]).select(
        "run_id", "item_id", "source", "rn", "doc_id", "url", "page", "passage"
    )
    outside = hits.join(open_.filter("source = 'web'"), ["company_id", "item_id"]).select(
        "run_id", "item_id", "source", "rn", none.cast("bigint").alias("doc_id"), "url", none.cast("int").alias("page"), "passage"
    )
    return inside.unionByName(outside)


def with_readings(chosen: DataFrame, readings: DataFrame, checklist: Checklist) -> DataFrame:
    """Findings folded by run, for the assessment: one row per run, map item -> finding with its lineage.

    Readings (run_id, item_id, seq, page, value, evidence, rationale, confidence, provider, error) are a log of what an
    outside reader said; the last by `seq` counts. Evidence without a reading is deferred. Without evidence there is
    nothing to read, and a reading counts for nothing. What comes from the web is of low confidence whatever the reader
    says, as is an answer that the texts do not hold; an error has no value and cites nothing.
    """
    last = F.max_by(F.struct(*READING), F.struct(F.col("seq"), *READING))
    read = _folded(readings, "run_id", [i.id for i in checklist.items], last, "_read")
    rows = chosen.join(read, "run_id", "left")

    def finding(c: Column, r: Column) -> Column:
        failed = F.coalesce(r["error"].isNotNull(), F.lit(False))
        usable = c["source"].isNotNull() & r.isNotNull() & ~failed
        waiting = c["source"].isNotNull() & r.isNull()
        place = F.when(~(c["source"].isNotNull() & failed), cited(c["places"], r["page"]))
        missing = ~usable | P.is_na(r["value"])
        low = (c["source"] == "web") | missing
        said = lambda n: F.when(usable, r[n])
        return F.struct(
            F.when(~missing, r["value"]).alias("value"), said("evidence").alias("evidence"), said("rationale").alias("rationale"),
            F.coalesce(c["source"], F.lit("none")).alias("source"), waiting.alias("deferred"),
            place["doc_id"].alias("doc_id"), place["page"].alias("page"), place["url"].alias("url"),
            F.when(~waiting, F.when(low, "low").otherwise(F.coalesce(r["confidence"], F.lit("medium")))).alias("confidence"),
            said("provider").alias("reader"), F.when(c["source"].isNotNull(), r["error"]).alias("error"),
        )

    found = F.transform_values("_chosen", lambda item, c: finding(c, F.try_element_at(F.col("_read"), item)))
    return rows.select("run_id", found.alias("_by_item"))


# --- stored results -------------------------------------------------------------------------------------------------
STORED = [
    "flag", "value", "verdict", "evidence", "confidence", "gate_pass", "provider", "rule_fired", "source", "doc_id", "page", "url",
]


def store_results(stored: DataFrame, results: DataFrame) -> DataFrame:
    """Stored results after a pass: an evaluated item's row is replaced and its attempts go up by one.

    An item that had to wait changes its status, error and attempts only: what an earlier pass found stays in its row.
    Items that the pass did not evaluate stay as they are. Needs stored (run_id, item_id, status, error, attempts and
    STORED), unique by run and item.
    """
    common = ["run_id", "item_id", "status", "error", *STORED]
    new = results.select(*common, F.lit(1).cast("bigint").alias("attempts"), F.lit(1).alias("_new"))
    old = stored.select(*common, F.col("attempts").cast("bigint").alias("attempts"), F.lit(0).alias("_new"))
    counts = F.when((F.col("_new") == 0) | (F.col("status") != "DEFERRED"), F.col("_new"))
    return (
        old.unionByName(new)
        .groupBy("run_id", "item_id")
        .agg(
            F.max_by(F.struct("status", "error"), "_new").alias("_state"),
            F.max_by(F.struct(*STORED), counts).alias("_row"),
            F.sum("attempts").alias("attempts"),
        )
        .select("run_id", "item_id", "_state.*", "_row.*", "attempts")
    )


# --- the pass in stages ---------------------------------------------------------------------------------------------
def gather(
    runs: DataFrame, checklist: Checklist, documents: DataFrame, hits: DataFrame, stages: Stages,
    routes: Sequence[Route] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages, kept hits and the chosen places of each run, each written once and read again afterwards.

    The documents' texts are read by the first stage alone. A pass that is started again skips the stages that are whole.
    """
    routes = routes if routes is not None else routes_of(runs.sparkSession, checklist)
    passages = stages.table("passages", lambda: document_evidence(documents, searches(routes)))
    kept = stages.table("hits", lambda: research_hits(hits))
    places = stages.table("places", lambda: choose_places(runs, routes, passages, kept))
    return passages, kept, places
