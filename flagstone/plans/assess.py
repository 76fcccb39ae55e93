"""The whole assessment: every run and item from statements, findings and opinions to a stored result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone import strategies as ST
from flagstone.functions import numbers as N
from flagstone.functions import predicates as P
from flagstone.functions import rules as R
from flagstone.operators import classify as C
from flagstone.operators import finance as fin
from flagstone.operators.state import Checklist, grid, results_by_run
from flagstone.plans import evidence as EV

_ROW = "struct<value:string,evidence:string,series:array<string>>"
FINDING_COLUMNS = ["value", "evidence", "rationale", "source", "deferred"]


def structured_by_company(statements: DataFrame) -> DataFrame:
    """One row per company: map metric -> struct(value, evidence, series), and its size.

    Series metrics show the latest value with its trend and keep the whole row for the trend rules.
    """
    series = {
        "working_capital_days": fin.find_series(fixed.ROW["working_capital_days"]),
        "dividend_payout": fin.find_series(fixed.ROW["dividend_payout"]),
        "promoters": fin.holding_series("promoters"),
        "pledged": fin.holding_series("pledged"),
    }
    rows = statements.withColumns({f"_{n}": c for n, c in series.items()})
    figures = fin.figures(rows, *[f"_{n}" for n in series])
    none = F.expr("cast(null as array<string>)")
    cells: list[Column] = []
    for name, text in fin.metric_texts().items():
        cell = F.struct(text.alias("value"), F.concat(F.lit(f"{name} = "), text).alias("evidence"), none.alias("series"))
        cells += [F.lit(name), F.when(text.isNotNull(), cell)]
    for name in series:
        s = F.col(f"_{name}")
        latest = N.latest_text(s["values"])
        shown = F.concat(latest, F.lit(" ("), N.trend_label(s["values"]), F.lit(")"))
        cell = F.struct(
            shown.alias("value"), F.concat(F.lit(f"{name} — "), N.compact_series(s["periods"], s["values"])).alias("evidence"),
            s["values"].alias("series"),
        )
        cells += [F.lit(name), F.when(latest.isNotNull(), cell)]
    scale = F.struct(fin.net_worth().alias("net_worth"), F.col("revenue"), F.col("profit"))
    return figures.select("company_id", F.create_map(*cells).alias("metrics"), scale.alias("scale"))


def structured_evidence(statements: DataFrame) -> DataFrame:
    """Every metric of every company that has a value.

    explode_outer, because explode makes the optimizer ask for a non-empty map below every projection,
    which writes out the definition of all metrics once per level.
    """
    return (
        structured_by_company(statements)
        .select("company_id", F.explode_outer("metrics").alias("metric", "m"))
        .filter(F.col("m").isNotNull())
        .select("company_id", "metric", "m.value", "m.evidence")
    )


def analyses(
    runs: DataFrame, checklist: Checklist, statements: DataFrame, findings: DataFrame, opinions: DataFrame,
    done: DataFrame | None = None, scale_divisor: float = 1.0,
) -> DataFrame:
    """Every run and item with its value, evidence, size and opinions.

    Statements, findings, opinions and stored results all meet the runs once per run, each folded to
    one row per run beforehand; a run's findings and opinions are bounded by the checklist. The items
    unfold only then, so no shuffle ever carries runs times items.
    """
    by_company = structured_by_company(statements)
    folded = findings if _is_folded(findings) else results_by_run(findings, checklist, FINDING_COLUMNS)
    found = folded.withColumnRenamed("_by_item", "_found")
    judged = results_by_run(C.opinions_wide(opinions, ["run_id", "item_id"]), checklist, ["first", "second"])
    joined = (
        runs.join(by_company, "company_id", "left")
        .join(found, "run_id", "left")
        .join(judged.withColumnRenamed("_by_item", "_judged"), "run_id", "left")
    )
    if done is not None:
        stored = results_by_run(done, checklist, ["status"]).withColumnRenamed("_by_item", "_stored")
        joined = joined.join(stored, "run_id", "left")
    columns = ["section_code", "non_negotiable", "output_format", "green_band", "red_band", "note_mode"]
    cells = grid(joined, checklist, columns)
    if done is not None:
        status = F.try_element_at(F.col("_stored"), F.col("item_id"))["status"]
        cells = cells.filter(~P.is_committed(status)).drop("_stored")
    metric = F.create_map(*[x for i, s in _metrics(checklist).items() for x in (F.lit(i), F.lit(s))])
    cells = cells.withColumns(
        {
            "_m": F.try_element_at(F.col("metrics"), F.try_element_at(metric, F.col("item_id"))),
            "_f": F.try_element_at(F.col("_found"), F.col("item_id")),
            "_j": F.try_element_at(F.col("_judged"), F.col("item_id")),
        }
    )
    structured = F.col("_m.value").isNotNull()
    lineage = [F.when(~structured, F.col(f"_f.{c}")).alias(c) for c in EV.LINEAGE] if _is_folded(findings) else []
    sized = F.struct(*[(F.col(f"scale.{c}") / scale_divisor).alias(c) for c in ("net_worth", "revenue", "profit")])
    return cells.select(
        *runs.columns, "item_id", *columns,
        P.item_kind(F.col("output_format")).alias("kind"),
        F.coalesce("_m.value", "_f.value", F.lit(fixed.NOT_AVAILABLE_TEXT)).alias("value"),
        F.when(structured, F.col("_m.evidence")).otherwise(F.col("_f.evidence")).alias("evidence"),
        F.col("_m.series").alias("series"),
        F.when(~structured, F.col("_f.rationale")).alias("rationale"),
        F.when(structured, "structured").otherwise(F.coalesce("_f.source", F.lit("none"))).alias("source"),
        (F.coalesce("_f.deferred", F.lit(False)) & ~structured).alias("deferred"),
        F.when(F.col("scale").isNotNull(), sized).alias("scale"),
        F.col("_j.first").alias("first"), F.col("_j.second").alias("second"), *lineage,
    ).withColumn("from_web", F.col("source") == "web")


def _is_folded(findings: DataFrame) -> bool:
    """Findings of the evidence stage come as one row per run and carry their lineage."""
    return "_by_item" in findings.columns


def _metrics(checklist: Checklist) -> dict[str, str]:
    found = {i.id: ST.BY_ITEM[i.id].metric for i in checklist.items if i.id in ST.BY_ITEM and ST.BY_ITEM[i.id].metric}
    return found or {"": ""}


def run_assessment(
    runs: DataFrame, companies: DataFrame, checklist: Checklist, statements: DataFrame, findings: DataFrame,
    opinions: DataFrame, results: DataFrame | None = None, *, force: bool = False,
    item_ids: Sequence[str] = (), sections: Sequence[str] = (), scale_divisor: float = 1.0,
) -> DataFrame:
    """Results of a pass.

    Without `results`, or under force or a scope, everything in scope is evaluated; otherwise only
    what is not committed yet. An item whose finding is deferred stays DEFERRED and carries no flag.
    Findings of `evidence.with_readings` bring document, page, link, confidence, reader and error along:
    the result then has them too, and an item whose reading failed ends in ERROR.
    """
    traced = _is_folded(findings)
    scoped = checklist.scoped(item_ids, sections)
    resume = results if results is not None and not force and scoped is checklist else None
    owned = runs.select("run_id", "company_id").join(companies.select("company_id", "ticker"), "company_id", "left")
    rows = analyses(owned, scoped, statements, findings, opinions, resume, scale_divisor)
    gone = C.not_applicable(F.col("item_id"), F.col("ticker"))
    rows = rows.withColumns(
        {
            "skip": gone,
            "value": F.when(gone | F.col("deferred"), F.lit(fixed.NOT_AVAILABLE_TEXT)).otherwise(F.col("value")),
        }
    )
    flagged = C.decide(rows)
    expected = F.col("item_id").isin(*ST.WEB_TOPICS)
    verdict = R.build_verdict(
        F.col("flag"), F.col("reason"), F.col("rationale"), F.col("value"), F.col("kind"), expected
    )
    skip, deferred = F.col("skip"), F.col("deferred") & ~F.col("skip")
    own = F.when(F.col("source") == "structured", "deterministic")
    sure = F.when(skip | (F.col("source") == "structured"), 0.9)
    if traced:
        return _traced(flagged, skip, deferred, verdict, own, sure)
    return flagged.select(
        "run_id", "company_id", "item_id", "section_code", "non_negotiable",
        F.when(skip, "not_applicable").when(deferred, "deferred").otherwise(F.col("rule_fired")).alias("rule_fired"),
        F.when(deferred, "DEFERRED").when(F.col("needs_review"), "NEEDS_REVIEW").otherwise("DONE").alias("status"),
        F.when(~deferred, F.col("flag")).alias("flag"),
        F.when(skip, "not applicable").otherwise(F.col("value")).alias("value"),
        F.when(skip, fixed.LISTED_ONLY_VERDICT).when(~deferred, verdict).alias("verdict"),
        "evidence",
        sure.when(F.col("source") == "web", 0.3).otherwise(0.6).alias("confidence"),
        F.when(~deferred, F.col("gate_pass")).alias("gate_pass"),
        P.provider_set(own, F.col("provider")).alias("provider"),
    )


def _traced(flagged: DataFrame, skip: Column, deferred: Column, verdict: Column, own: Column, sure: Column) -> DataFrame:
    """Results with their lineage. What is skipped cites nothing; a failed reading has no answer, and says why."""
    failed = F.col("error").isNotNull() & ~skip
    read = F.when(~failed, P.provider_set(own, F.col("reader"), F.col("provider")))
    place = [F.when(~skip, F.col(c)).alias(c) for c in ("doc_id", "page", "url")]
    return flagged.select(
        "run_id", "company_id", "item_id", "section_code", "non_negotiable",
        F.when(skip, "not_applicable").when(failed, "error").when(deferred, "deferred").otherwise(F.col("rule_fired")).alias("rule_fired"),
        F.when(failed, "ERROR").when(deferred, "DEFERRED").when(F.col("needs_review"), "NEEDS_REVIEW").otherwise("DONE").alias("status"),
        F.when(~deferred, F.col("flag")).alias("flag"),
        F.when(skip, "not applicable").otherwise(F.col("value")).alias("value"),
        F.when(skip, fixed.LISTED_ONLY_VERDICT).when(failed, F.concat(F.lit("Error: "), F.col("error"))).when(~deferred, verdict).alias("verdict"),
        F.when(~skip, F.col("evidence")).alias("evidence"),
        sure.when(~deferred, P.confidence_score(F.coalesce("confidence", F.lit("low")))).alias("confidence"),
        F.when(~deferred, F.col("gate_pass")).alias("gate_pass"),
        read.alias("provider"), F.when(skip, "none").otherwise(F.col("source")).alias("source"), *place,
        F.when(failed, F.col("error")).when(deferred, "no reading yet").alias("error"),
    )
