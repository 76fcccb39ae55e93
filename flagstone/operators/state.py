"""Stored results: idempotent writes, resuming, scoping, pruning, dimension sync and audits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions.predicates import is_committed, is_stale, seconds_between
from flagstone.operators.ordering import latest_per_group


@dataclass(frozen=True)
class Item:
    """One checklist entry."""

    id: str | int
    section_code: str
    item: str = ""
    order_idx: int = 0
    non_negotiable: bool = False
    output_format: str | None = None
    green_band: str | None = None
    red_band: str | None = None
    source_hint: str | None = None
    note_mode: bool = False


@dataclass(frozen=True)
class Checklist:
    """The checklist is configuration of about a hundred entries, so it travels inside the plan as a
    literal: giving every run its items is a row expansion, neither a join nor a broadcast. It is as
    long as the caller's own list; a scope that names nothing known has no items and gives no rows."""

    items: tuple[Item, ...]
    sections: tuple[tuple[str, str], ...] = ()
    key_type: str = "string"

    def literal(self, columns: Sequence[str] = ("section_code", "non_negotiable")) -> Column:
        if not self.items:
            return self._typed(columns)
        names = dict(self.sections)
        rows = []
        for it in self.items:
            cols = [F.lit(it.id).alias("item_id")]
            for c in columns:
                value = names.get(it.section_code, it.section_code) if c == "section_name" else getattr(it, c)
                kind = "boolean" if isinstance(value, bool) else "int" if isinstance(value, int) else "string"
                cols.append(F.lit(value).cast(kind).alias(c))
            rows.append(F.struct(*cols))
        return F.array(*rows)

    def _typed(self, columns: Sequence[str]) -> Column:
        """No items, with the types that items would have."""
        some = Checklist((Item("" if self.key_type == "string" else 0, ""),), self.sections)
        return F.filter(some.literal(columns), lambda _: F.lit(False))

    def scoped(self, item_ids: Sequence = (), sections: Sequence[str] = ()) -> Checklist:
        """Only the named items and sections; blank names are dropped, no name means all."""
        ids = {i.strip() if isinstance(i, str) else i for i in item_ids} - {""}
        codes = {s.strip() for s in sections} - {""}
        if not ids and not codes:
            return self
        kept = tuple(i for i in self.items if i.id in ids or i.section_code in codes)
        return replace(self, items=kept, key_type=self._key_type())

    def _key_type(self) -> str:
        return "int" if self.items and isinstance(self.items[0].id, int) else "string" if self.items else self.key_type

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(
            F.explode(
                self.literal(
                    ["section_code", "item", "order_idx", "non_negotiable", "output_format", "green_band", "red_band", "source_hint"]
                )
            ).alias("x")
        ).select("x.*")


def grid(runs: DataFrame, checklist: Checklist, columns: Sequence[str] = ("section_code", "non_negotiable")) -> DataFrame:
    """Every run with every item."""
    return runs.select("*", F.explode(checklist.literal(columns)).alias("_item")).select(*runs.columns, "_item.*")


def results_by_run(results: DataFrame, checklist: Checklist, columns: Sequence[str]) -> DataFrame:
    """One row per run: map item -> struct of columns, one entry for each item of the checklist that
    has a result. Of several results of one item the one with the greatest column values counts."""
    ids = [i.id for i in checklist.items]
    entry = F.struct(F.col("item_id"), F.struct(*columns))
    return (
        results.filter(F.col("item_id").isin(*ids))
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_set(entry)).alias("_sorted"))
        .select("run_id", F.map_from_entries(F.filter("_sorted", _last_of_item)).alias("_by_item"))
    )


def _last_of_item(entry: Column, i: Column) -> Column:
    return ~F.get(F.col("_sorted"), i + 1)["item_id"].eqNullSafe(entry["item_id"])


def items_with_results(
    runs: DataFrame, checklist: Checklist, results: DataFrame,
    columns: Sequence[str] = ("status", "flag"),
    item_columns: Sequence[str] = ("section_code", "non_negotiable"),
) -> DataFrame:
    """Every run and item with its result, PENDING where there is none.

    Runs meet their results once per run, not once per run and item; the items unfold afterwards.
    """
    joined = runs.join(results_by_run(results, checklist, columns), "run_id", "left")
    cells = grid(joined, checklist, item_columns)
    found = F.try_element_at(F.col("_by_item"), F.col("item_id"))
    out = cells.withColumn("_r", found).select(
        *runs.columns, "item_id", *item_columns, *[F.col("_r")[c].alias(c) for c in columns]
    )
    if "status" in columns:
        out = out.withColumn("status", F.coalesce("status", F.lit("PENDING")))
    return out


def runs_with_items(
    runs: DataFrame, checklist: Checklist, results: DataFrame,
    columns: Sequence[str] = ("status", "flag"),
    item_columns: Sequence[str] = ("section_code", "non_negotiable"),
) -> DataFrame:
    """One row per run_id with `items`, the rows of `items_with_results` as an array of structs.

    Nothing unfolds, so what is worked out for whole runs needs no gathering afterwards. Runs of one id, of which the
    narrow columns alone are gathered, have their items in one array.
    """
    others = [c for c in runs.columns if c != "run_id"]
    own = F.struct(*others) if others else F.struct(F.lit(None).alias("_none"))
    grouped = runs.groupBy("run_id").agg(F.collect_list(own).alias("_runs"))
    joined = grouped.join(results_by_run(results, checklist, columns), "run_id", "left")

    def cell(run: Column, item: Column) -> Column:
        found = F.try_element_at(F.col("_by_item"), item["item_id"])
        value = lambda c: F.coalesce(found[c], F.lit("PENDING")) if c == "status" else found[c]
        return F.struct(
            *[run[c].alias(c) for c in others], *[item[c].alias(c) for c in ("item_id", *item_columns)],
            *[value(c).alias(c) for c in columns],
        )

    items = F.flatten(F.transform("_runs", lambda run: F.transform(checklist.literal(item_columns), lambda item: cell(run, item))))
    return joined.select("run_id", items.alias("items"))


# --- writes ---------------------------------------------------------------------------------------------
def current_state(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last write of each key and how often it was written."""
    payload = [c for c in log.columns if c not in keys]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("attempts"))
        .select(*keys, "_row.*", "attempts")
    )


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored rows (with attempts) and new writes to new stored rows; a later write wins."""
    writes = changes.withColumn("attempts", F.lit(1).cast("bigint")).withColumn("_new", F.lit(1))
    both = base.withColumn("_new", F.lit(0)).unionByName(writes)
    payload = [c for c in base.columns if c not in (*keys, "attempts")]
    return (
        both.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*payload), F.struct("_new", *order)).alias("_row"),
            F.sum("attempts").alias("attempts"),
        )
        .select(*keys, "_row.*", "attempts")
        .select(*base.columns)
    )


def partial_update(base: DataFrame, patch: DataFrame, keys: Sequence[str], given: str = "given") -> DataFrame:
    """A field changes only when the patch names it in `given`; a named null is a value."""
    fields = [c for c in base.columns if c not in keys]
    joined = base.alias("b").join(patch.alias("p"), list(keys), "full")
    cells = [
        F.when(F.array_contains(F.col(f"p.{given}"), f), F.col(f"p.{f}")).otherwise(F.col(f"b.{f}")).alias(f)
        for f in fields
    ]
    return joined.select(*keys, *cells)


def prune_text(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Text of documents of finished runs is dropped, the rest is kept."""
    done = runs.filter(F.col("status") == "DONE").select("run_id", F.lit(True).alias("_done")).distinct()
    marked = documents.join(done, "run_id", "left")
    return marked.withColumn("pruned", F.col("_done").isNotNull() & F.col("text").isNotNull()).withColumn(
        "text", F.when(F.col("_done").isNull(), F.col("text"))
    ).drop("_done")


def stale_ids(current: DataFrame, source: DataFrame, key: str, guard: int = fixed.DIM_GUARD) -> DataFrame:
    """Ids stored but gone from the source; none when the source is too small to be trusted."""
    size = source.select(F.count_distinct(key).alias("n")).scalar()
    return current.select(key).distinct().join(source.select(key), key, "left_anti").filter(size >= guard)


def sync_dimension(current: DataFrame, source: DataFrame, key: str, guard: int = fixed.DIM_GUARD) -> DataFrame:
    """Source rows replace stored ones; stored ids gone from the source are dropped under the guard."""
    kept = current.join(source.select(key), key, "left_anti")
    stale = stale_ids(current, source, key, guard)
    return source.unionByName(kept.join(stale, key, "left_anti"))


def prune_results(results: DataFrame, stale: DataFrame, key: str) -> DataFrame:
    """Results without those of ids that `sync_dimension` dropped; an id's rows go together, whatever their run."""
    return results.join(stale.select(key), key, "left_anti")


# --- planning -------------------------------------------------------------------------------------------
def plan_todo(
    runs: DataFrame, checklist: Checklist, results: DataFrame, *, force: bool = False,
    item_ids: Sequence = (), sections: Sequence[str] = (),
) -> DataFrame:
    """Work of a pass: what is not committed; everything under force; a named scope always."""
    scoped = checklist.scoped(item_ids, sections)
    if force or scoped is not checklist:
        return grid(runs, scoped, ["section_code"])
    state = items_with_results(runs, checklist, results, ["status"], ["section_code"])
    return state.filter(~is_committed(F.col("status"))).drop("status")


def parse_scope(text: Column) -> Column:
    """Comma-separated scope names, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda t: t != "")


def blank_targets(state: DataFrame) -> DataFrame:
    """Items without a real answer: uncommitted, flagless or not available."""
    answered = is_committed(F.col("status")) & F.coalesce(F.col("flag") != "NOT_AVAILABLE", F.lit(False))
    return state.filter(~answered)


def drain_queue(runs: DataFrame, limit: int) -> DataFrame:
    """Runs ready for work in order of creation."""
    ready = runs.filter(F.col("status").isin(*fixed.ELIGIBLE_RUNS))
    return ready.orderBy("created_at", "run_id").limit(limit)


def resume_candidates(
    runs: DataFrame, now: datetime, idle_minutes: int = fixed.IDLE_MINUTES, limit: int = fixed.RESUME_BATCH
) -> DataFrame:
    """Unfinished runs nobody has touched for a while, oldest first."""
    idle = F.col("last_processed_at").isNull() | (
        seconds_between(F.col("last_processed_at"), F.lit(now)) > idle_minutes * 60
    )
    waiting = runs.filter(F.col("status").isin(*fixed.RESUMABLE_RUNS) & idle)
    return waiting.orderBy("created_at", "run_id").limit(limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of each company."""
    return latest_per_group(runs, ["company_id"], ["created_at", "run_id"])


def start_decision(runs: DataFrame, now: datetime, force: bool = False) -> DataFrame:
    """Per company: show the fresh report, join the run in flight, or start a new one."""
    last = latest_runs(runs)
    at = F.coalesce("last_processed_at", "created_at")
    fresh = (F.col("status") == "DONE") & ~is_stale(at, F.lit(now)) & F.lit(not force)
    return last.withColumn(
        "decision",
        F.when(fresh, "fresh").when(F.col("status").isin(*fixed.IN_FLIGHT_RUNS), "reuse").otherwise("new"),
    )


def resolve_runs(args: DataFrame, runs: DataFrame, companies: DataFrame) -> DataFrame:
    """A run id, else an upper-cased ticker to its newest company's newest run. Needs args.arg."""
    newest = latest_per_group(
        companies.filter(F.col("ticker").isNotNull()).select("ticker", "company_id", "created_at"),
        ["ticker"], ["created_at", "company_id"],
    ).select("ticker", "company_id")
    by_ticker = newest.join(
        latest_runs(runs).select("company_id", F.col("run_id").alias("by_ticker")), "company_id"
    ).select(F.col("ticker").alias("_t"), "by_ticker")
    by_id = runs.select(F.col("run_id").alias("by_id"), F.col("run_id").cast("string").alias("_id"))
    return (
        args.join(by_id, F.col("arg") == F.col("_id"), "left")
        .join(by_ticker, F.upper("arg") == F.col("_t"), "left")
        .select("arg", F.coalesce("by_id", "by_ticker").alias("run_id"))
    )


# --- integrity ------------------------------------------------------------------------------------------
def audit_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys stored more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def audit_fk(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """References without a target, with the rows a cascade would take along."""
    orphans = child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
    return orphans.groupBy(key).agg(F.count(F.lit(1)).alias("orphans"))
