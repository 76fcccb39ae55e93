"""Rollups, gates, report rows, cards, shares and export tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions import numbers as N
from flagstone.functions import predicates as P
from flagstone.functions.text import trim_all
from flagstone.operators.classify import not_applicable
from flagstone.operators.ordering import numbered
from flagstone.operators.state import Checklist, latest_runs


def _flag_count(flag: str, of: Column) -> Column:
    return F.count_if(F.coalesce(of == flag, F.lit(False)))


# --- rollup of a run ------------------------------------------------------------------------------------
def section_rollup(state: DataFrame) -> DataFrame:
    """Committed flags per run and section, with the run total where section_code is null.

    A flag of an uncommitted result is stale and counts nowhere.
    """
    live = F.when(P.is_committed(F.col("status")), F.col("flag"))
    counts = ["green", "red", "neutral", "na", "total"]
    by_section = (
        state.withColumn("_live", live)
        .groupBy("run_id", "section_code")
        .agg(
            _flag_count("GREEN", F.col("_live")).alias("green"),
            _flag_count("RED", F.col("_live")).alias("red"),
            _flag_count("NEUTRAL", F.col("_live")).alias("neutral"),
            _flag_count("NOT_AVAILABLE", F.col("_live")).alias("na"),
            F.count(F.lit(1)).alias("total"),
        )
    )
    # a run has few sections; its total joins them in the same partition, where grouping sets would shuffle twice the rows
    own = F.struct("section_code", *counts)
    whole = F.struct(F.lit(None).cast("string").alias("section_code"), *[F.sum(c).alias(c) for c in counts])
    by_run = by_section.groupBy("run_id").agg(F.concat(F.collect_list(own), F.array(whole)).alias("_rows"))
    return by_run.select("run_id", F.explode("_rows").alias("_row")).select("run_id", "_row.*")


def gate(state: DataFrame) -> DataFrame:
    """Failed non-negotiable items of each run; it passes when there is none."""
    failed = P.is_committed(F.col("status")) & F.col("non_negotiable") & (F.col("flag") == "RED")
    return (
        state.groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.when(failed, F.col("item_id")))).alias("failed_items"))
        .withColumn("gate_pass", F.size("failed_items") == 0)
    )


def run_status(state: DataFrame) -> DataFrame:
    """Counts by status and whether the run is complete."""
    n = lambda s: F.count_if(F.col("status") == s)
    known = F.col("status").isin("DONE", "NEEDS_REVIEW", "ERROR", "DEFERRED")
    return (
        state.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("items_total"),
            n("DONE").alias("items_done"),
            n("NEEDS_REVIEW").alias("items_review"),
            n("ERROR").alias("items_error"),
            n("DEFERRED").alias("items_deferred"),
            F.count_if(~known).alias("items_pending"),
        )
        .withColumn(
            "complete",
            (F.col("items_pending") == 0) & (F.col("items_error") == 0) & (F.col("items_deferred") == 0),
        )
        .withColumn("run_status", F.when(F.col("complete"), "DONE").otherwise("PARTIAL"))
    )


def summarize(state: DataFrame) -> DataFrame:
    """Totals, status counts, completeness and gate of each run in one pass."""
    committed = P.is_committed(F.col("status"))
    live = F.when(committed, F.col("flag"))
    failed = committed & F.col("non_negotiable") & (F.col("flag") == "RED")
    n = lambda s: F.count_if(F.col("status") == s)
    return (
        state.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("items_total"),
            *[_flag_count(f, live).alias(f.lower()) for f in fixed.FLAGS],
            n("DONE").alias("items_done"),
            n("NEEDS_REVIEW").alias("items_review"),
            n("ERROR").alias("items_error"),
            n("DEFERRED").alias("items_deferred"),
            n("PENDING").alias("items_pending"),
            F.array_sort(F.collect_list(F.when(failed, F.col("item_id")))).alias("failed_items"),
        )
        .withColumn("gate_pass", F.size("failed_items") == 0)
        .withColumn(
            "run_status",
            F.when(F.col("items_pending") + F.col("items_error") + F.col("items_deferred") == 0, "DONE").otherwise("PARTIAL"),
        )
    )


# --- report rows ----------------------------------------------------------------------------------------
def split_flag(status: Column, flag: Column) -> tuple[Column, Column]:
    """(live flag, stale flag): the first only when committed, the second only when not."""
    done = P.is_committed(status)
    return F.when(done, flag), F.when(~done, flag)


def na_kind(status: Column, flag: Column, verdict: Column) -> Column:
    """Why a committed answer is missing: not applicable, or no data."""
    return F.when(
        P.is_committed(status) & (flag == "NOT_AVAILABLE"),
        F.when(verdict == fixed.LISTED_ONLY_VERDICT, "not_applicable").otherwise("no_data"),
    )


def report_items(state: DataFrame) -> DataFrame:
    """Presentation columns with applicability enforced at reading time.

    Needs item_id, ticker, status, flag, value, verdict.
    """
    shown = shown_item(*[F.col(c) for c in _STORED_ITEM])
    return state.select(
        *[c for c in state.columns if c not in ("status", "flag", "value", "verdict")], *[v.alias(k) for k, v in shown.items()]
    )


_STORED_ITEM = ("item_id", "ticker", "status", "flag", "value", "verdict")


def shown_item(item_id: Column, ticker: Column, status: Column, flag: Column, value: Column, verdict: Column) -> dict[str, Column]:
    """What `report_items` shows of an item."""
    forced = not_applicable(item_id, ticker)
    live, stale = split_flag(status, flag)
    kind = na_kind(status, flag, verdict)
    return {
        "status": F.when(forced, "DONE").otherwise(status),
        "flag": F.when(forced, "NOT_AVAILABLE").otherwise(live),
        "stale_flag": F.when(~forced, stale),
        "na_kind": F.when(forced, "not_applicable").otherwise(kind),
        "value": F.when(forced, "not applicable").otherwise(value),
        "verdict": F.when(forced, fixed.LISTED_ONLY_VERDICT).otherwise(verdict),
        "needs_review": ~forced & F.coalesce(status == "NEEDS_REVIEW", F.lit(False)),
    }


def report_items_by_run(runs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`report_items` of runs that hold their items in an array: `items` gets the kept and the shown columns."""

    def shown(item: Column) -> Column:
        cells = shown_item(*[item[c] for c in _STORED_ITEM])
        return F.struct(*[item[c].alias(c) for c in keep], *[v.alias(k) for k, v in cells.items()])

    return runs.withColumn("items", F.transform("items", shown))


def section_counts(report: DataFrame) -> DataFrame:
    """Counts of shown flags; whatever is not green, red or neutral counts as missing."""
    f = F.col("flag")
    judged = F.coalesce(f.isin("GREEN", "RED", "NEUTRAL"), F.lit(False))
    return report.groupBy("run_id", "section_code").agg(
        _flag_count("GREEN", f).alias("green"),
        _flag_count("RED", f).alias("red"),
        _flag_count("NEUTRAL", f).alias("neutral"),
        F.count_if(~judged).alias("na"),
        F.count_if(judged).alias("answered"),
        F.count(F.lit(1)).alias("total"),
    )


def na_split(report: DataFrame) -> DataFrame:
    """Missing answers of each run by reason."""
    na = F.col("flag") == "NOT_AVAILABLE"
    structural = F.coalesce(F.col("na_kind") == "not_applicable", F.lit(False))
    return report.groupBy("run_id").agg(
        F.count_if(F.coalesce(na & structural, F.lit(False))).alias("not_applicable"),
        F.count_if(F.coalesce(na & ~structural, F.lit(False))).alias("no_data"),
    )


def search_report(report: DataFrame, flag: str | None = None, query: str = "") -> DataFrame:
    """Report rows with an effective flag and a text in id, item, verdict or value."""
    out = report.withColumn("effective", F.coalesce("flag", "stale_flag", F.lit("NOT_AVAILABLE")))
    if flag:
        out = out.filter(F.col("effective") == flag)
    q = query.strip().lower()
    if q:
        hay = F.concat_ws("\u0001", *[F.lower(F.col(c).cast("string")) for c in ("item_id", "item", "verdict", "value")])
        out = out.filter(F.contains(hay, F.lit(q)))
    return out


def section_sources(rows: DataFrame) -> DataFrame:
    """Distinct documents behind the answers of each section."""
    return (
        rows.filter(F.col("doc_name").isNotNull())
        .groupBy("run_id", "section_code")
        .agg(F.count_distinct("doc_name").alias("documents"))
    )


def report_rows(results: DataFrame, documents: DataFrame, runs: DataFrame, companies: DataFrame) -> DataFrame:
    """Results with the cited document's name and the company of their run."""
    docs = documents.select("doc_id", F.col("name").alias("doc_name"))
    owner = runs.select("run_id", "company_id").join(
        companies.select("company_id", F.col("name").alias("company"), "ticker"), "company_id", "left"
    )
    return results.join(docs, "doc_id", "left").join(owner, "run_id", "left")


# --- cards ----------------------------------------------------------------------------------------------
def company_cards(companies: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """One card per company: its newest run, committed flag counts and gate.

    Results are tallied per run before they meet the runs; stale flags are left out.
    """
    f = F.col("flag")
    tally = (
        results.filter(P.is_committed(F.col("status")))
        .groupBy("run_id")
        .agg(
            _flag_count("GREEN", f).alias("green"),
            _flag_count("RED", f).alias("red"),
            _flag_count("NEUTRAL", f).alias("neutral"),
            _flag_count("NOT_AVAILABLE", f).alias("na"),
            F.count_if((f == "RED") & F.col("non_negotiable")).alias("_failed"),
        )
    )
    cards = companies.join(latest_runs(runs), "company_id").join(tally, "run_id", "left")
    counts = ["green", "red", "neutral", "na"]
    cards = cards.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in [*counts, "_failed"]})
    return (
        cards.withColumn("answered", F.col("green") + F.col("red") + F.col("neutral"))
        .withColumn("total", F.col("answered") + F.col("na"))
        .withColumn("gate_pass", F.col("_failed") == 0)
        .drop("_failed")
    )


def visible_cards(cards: DataFrame, listed_over: int = 85, unlisted_over: int = 20) -> DataFrame:
    """Finished cards with enough answers; unlisted companies have a lower bar."""
    bar = F.when(P.is_unlisted(F.col("ticker")), unlisted_over).otherwise(listed_over)
    return cards.filter((F.col("status") == "DONE") & (F.col("answered") > bar))


def flag_share(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each flag and answered percent; a dash where there is nothing."""
    c = {k: F.col(k) for k in ("green", "red", "neutral", "na")}
    total = c["green"] + c["red"] + c["neutral"] + c["na"]
    part = F.greatest(total, F.lit(1)).cast("double")
    answered = c["green"] + c["red"] + c["neutral"]
    pct = N.whole(answered / F.greatest(total, F.lit(1)) * 100.0).cast("string")
    return counts.select(
        *keys,
        *[(v / part).alias(f"{k}_share") for k, v in c.items()],
        F.when(total > 0, F.concat(pct, F.lit("%"))).otherwise("—").alias("answered_pct"),
    )


# --- progress -------------------------------------------------------------------------------------------
def progress_counts(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Terminal and really answered items of each run."""
    done = P.is_committed(F.col("status"))
    counts = results.groupBy("run_id").agg(
        F.count_if(done).alias("done_items"),
        F.count_if(done & F.coalesce(F.col("flag").isin("GREEN", "RED", "NEUTRAL"), F.lit(False))).alias("answered"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return runs.join(counts, "run_id", "left").withColumns({c: zero(c) for c in ("done_items", "answered")})


def with_progress(df: DataFrame, total: Column) -> DataFrame:
    """Phase, percent, ready and done of each run. Needs status, done_items and answered.

    Harvesting is the first 15 percent, terminal items carry 68, real answers 15; 98 until done.
    """
    t = F.when(total > 0, total).otherwise(fixed.FALLBACK_ITEM_COUNT).cast("double")
    share = lambda n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), n / t))
    answered = F.least("answered", "done_items")
    working = F.least(
        F.lit(98).cast("bigint"), N.whole(15.0 + share(F.col("done_items")) * 68.0 + share(answered) * 15.0)
    )
    s = F.col("status")
    return df.select(
        "*",
        F.when(s == "QUEUED", "queued").when(s.isin("HARVESTING", "HARVESTED"), "harvesting")
        .when(s == "PROCESSING", "processing").when(s == "PARTIAL", "partial")
        .when(s == "DONE", "done").when(s == "ERROR", "error").otherwise("queued").alias("phase"),
        F.when(s == "QUEUED", 4).when(s == "HARVESTING", 10).when(s == "HARVESTED", 15)
        .when(s == "PROCESSING", working).when(s == "PARTIAL", F.greatest(F.lit(15), working))
        .when(s.isin("DONE", "ERROR"), 100).otherwise(2).cast("bigint").alias("percent"),
        ((s == "DONE") | ((s == "PARTIAL") & (F.col("done_items") > 0))).alias("ready"),
        s.isin("PARTIAL", "DONE", "ERROR").alias("done"),
    )


# --- exports --------------------------------------------------------------------------------------------
def shown_flag(flag: Column, kind: Column) -> Column:
    return (
        F.when(kind == "not_applicable", "N/A (n/a)").when(kind == "no_data", "N/A (no data)")
        .when(flag == "GREEN", "Green").when(flag == "RED", "Red").when(flag == "NEUTRAL", "Neutral")
        .when(flag == "NOT_AVAILABLE", "N/A").otherwise("Pending")
    )


def export_summary(report: DataFrame) -> DataFrame:
    """Section lines of the summary sheet."""
    counts = section_counts(report)
    pct = N.whole(F.col("answered") / F.col("total") * 100.0).cast("string")
    return counts.withColumn("answered_pct", F.when(F.col("total") > 0, F.concat(pct, F.lit("%"))).otherwise("—"))


def export_checklist(report: DataFrame) -> DataFrame:
    """Item lines of the checklist sheet. Needs confidence, doc_name and page beside report columns."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("p."), F.col("page").cast("string")))
    source = F.when(F.col("doc_name").isNotNull(), F.concat_ws(" · ", "doc_name", page)).otherwise(page)
    found = F.when(
        (F.col("value") != "") & (F.lower("value") != fixed.NOT_AVAILABLE_TEXT), F.col("value")
    )
    return report.select(
        "run_id", "section_code", "item_id",
        shown_flag(F.col("flag"), F.col("na_kind")).alias("flag_label"),
        F.coalesce(found, F.lit("—")).alias("finding"),
        F.coalesce("verdict", F.lit("—")).alias("assessment"),
        P.confidence_label(F.col("confidence")).alias("confidence_label"),
        F.coalesce(source, F.lit("—")).alias("source"),
    )


def watchlist(report: DataFrame) -> DataFrame:
    """Red flags first, then what needs review."""
    red = F.coalesce(F.col("flag") == "RED", F.lit(False))
    return report.filter(red | F.col("needs_review")).select(
        "run_id", "item_id", F.when(red, 1).otherwise(2).alias("block"),
        F.coalesce("verdict", "value", F.lit("—")).alias("assessment"),
    )


def nested_report(report: DataFrame, checklist: Checklist) -> DataFrame:
    """One row per run: sections with their items as an array of structs, ready for write.json.

    A run holds at most the checklist, so its arrays are bounded.
    """
    items = F.collect_list(F.struct("section_code", *_NESTED_ITEM))
    return nested_report_by_run(report.groupBy("run_id").agg(items.alias("items")), checklist)


_NESTED_ITEM = ("item_id", "status", "flag", "stale_flag", "value", "verdict")


def nested_report_by_run(runs: DataFrame, checklist: Checklist) -> DataFrame:
    """`nested_report` of runs that hold their items in an array; nothing is gathered. Needs run_id, each id once, and items."""
    order = {i.id: n for n, i in enumerate(checklist.items)}
    position = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])

    def cell(item: Column) -> Column:
        return F.struct(F.try_element_at(position, item["item_id"]).alias("pos"), *[item[c].alias(c) for c in _NESTED_ITEM])

    def section(code: Column) -> Column:
        own = F.filter("items", lambda item: item["section_code"].eqNullSafe(code))
        return F.struct(code.alias("section_code"), F.array_sort(F.transform(own, cell)).alias("items"))

    codes = F.array_distinct(F.transform("items", lambda item: item["section_code"]))
    return runs.select("run_id", F.array_sort(F.transform(codes, section)).alias("sections"))


def tally(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


# --- breakdowns -----------------------------------------------------------------------------------------
def member_table(members: DataFrame, limit: int = 7) -> DataFrame:
    """The members of each group, the busiest first, those without a stated count last, ties by name.

    Positions are counted in pieces of one count each, so a group of very many members is not sorted
    in one task.
    """
    stated = F.coalesce(F.col("n"), F.lit(-1))
    placed = numbered(members.withColumn("_rank", -stated), ["group_id"], F.col("_rank"), ["_rank", "name"])
    return placed.select(
        "group_id", "position", "name", F.coalesce(F.col("n").cast("string"), F.lit("—")).alias("shown"),
        F.when(F.col("n") > limit, "Overboarded").otherwise("OK").alias("status"),
    )


def coverage_gaps(skills: DataFrame) -> DataFrame:
    """Per group: skills named, those no member covers, and the line that leads the answer.

    Needs group_id, skill and covered; blank skills are left out and an unknown coverage is none missing.
    """
    named = skills.filter(trim_all(F.coalesce("skill", F.lit(""))) != "")
    counted = named.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("skills"), F.count_if(F.coalesce(~F.col("covered"), F.lit(False))).alias("gaps")
    )
    line = F.concat_ws(
        "", "gaps", F.lit(" competency gap(s) — "), "skills", F.lit(" competencies identified, "), (F.col("skills") - F.col("gaps")), F.lit(" covered")
    )
    return counted.withColumn("value", line)


def member_breakdown(members: DataFrame, limit: int = 7) -> DataFrame:
    """Per group: how many members, the largest count, how many above the limit, and the busiest.

    Needs group_id, name and n (null when not stated). Maxima combine on the map side.
    """
    busiest = F.max_by("name", F.struct(F.coalesce("n", F.lit(-1)).alias("n"), F.col("name").alias("name")))
    return members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.max("n").alias("most"),
        F.count_if(F.coalesce(F.col("n") > limit, F.lit(False))).alias("over_limit"),
        busiest.alias("busiest"),
    )


