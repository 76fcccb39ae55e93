"""Rules from a finding to a flag.

A rule is one expression over the row giving struct<flag,reason>, so a whole rule list stays in a
single projection. Rules that need figures or the company's size take them as columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions import numbers as N
from flagstone.functions import text as X
from flagstone.functions.once import let, terms
from flagstone.functions.predicates import is_absence, states_nil

VERDICT_TYPE = "struct<flag:string,reason:string>"


def fill(template: str, **values: Column) -> Column:
    """A wording with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols)


def verdict(flag: str, wording: str, **values: Column) -> Column:
    reason = fill(fixed.REASONS.get(wording, wording), **values)
    return F.struct(F.lit(flag).alias("flag"), reason.alias("reason"))


def no_verdict() -> Column:
    return F.expr(f"cast(null as {VERDICT_TYPE})")


def both_texts(value: Column, evidence: Column) -> Column:
    return F.concat(value, F.lit(" "), F.coalesce(evidence, F.lit("")))


# --- text rules ---------------------------------------------------------------------------------
def rule_committee(value: Column, evidence: Column) -> Column:
    """Two thirds independent and four meetings are compliant; under half is not."""

    def decide(x: Column) -> Column:
        ratio, meetings = x["ratio"], x["meetings"]
        times = meetings.cast("string")
        share = F.concat(N.whole(ratio * 100).cast("string"), F.lit("% independent"))
        met = F.when(meetings.isNotNull(), F.concat(F.lit(", met "), times, F.lit(" times"))).otherwise("")
        return (
            F.when(ratio.isNull(), verdict("NEUTRAL", "committee_unclear", value=value))
            .when(ratio < 0.5, verdict("RED", "committee_minority", share=share))
            .when(meetings < 4, verdict("RED", "committee_meetings", meetings=times))
            .when(ratio >= F.lit(2.0) / 3, verdict("GREEN", "committee_good", share=share, met=met))
            .otherwise(verdict("NEUTRAL", "committee_between", share=share))
        )

    return let(
        both_texts(value, evidence),
        lambda t: let(terms(ratio=N.parse_ratio(t), meetings=N.parse_meetings(t)), decide),
    )


def rule_cheap_equity(value: Column, evidence: Column) -> Column:
    """A denial is read first; a red needs an insider and a preferential or discounted price."""

    def decide(text: Column) -> Column:
        denied = states_nil(text)
        for pattern in (fixed.CHEAP_CLEAN, fixed.CHEAP_DENIED_BEFORE, fixed.CHEAP_DENIED_AFTER):
            denied = denied | text.rlike(pattern)
        return (
            F.when(denied, verdict("GREEN", "cheap_none", value=value))
            .when(
                text.rlike(fixed.CHEAP_INSIDER) & text.rlike(fixed.CHEAP_MENTION),
                verdict("RED", "cheap_issued", value=value),
            )
            .otherwise(verdict("NEUTRAL", "cheap_unclear", value=value))
        )

    return let(F.lower(both_texts(value, evidence)), decide)


def rule_audit_opinion(value: Column, evidence: Column) -> Column:
    """A modified opinion or a real going-concern emphasis is red; standard wording is not."""

    def decide(text: Column) -> Column:
        emphasis = (
            text.rlike(fixed.OPINION_GOING_CONCERN)
            & text.rlike(fixed.OPINION_DOUBT)
            & ~text.rlike(fixed.OPINION_BOILERPLATE)
        )
        return (
            F.when(text.rlike(fixed.OPINION_MODIFIED) | emphasis, verdict("RED", "opinion_modified", value=value))
            .when(text.rlike(fixed.OPINION_CLEAN), verdict("GREEN", "opinion_clean", value=value))
            .when(text.rlike(fixed.OPINION_CONTEXT), verdict("GREEN", "opinion_nothing", value=value))
            .otherwise(verdict("NEUTRAL", "opinion_unclear", value=value))
        )

    return let(F.lower(both_texts(value, evidence)), decide)


def rule_separation(value: Column, evidence: Column) -> Column:
    """One person in both roles is red, two persons are green."""
    return let(
        F.lower(both_texts(value, evidence)),
        lambda text: F.when(text.rlike(fixed.ROLES_COMBINED), verdict("RED", "roles_combined", value=value))
        .when(text.rlike(fixed.ROLES_SPLIT), verdict("GREEN", "roles_split", value=value))
        .otherwise(verdict("NEUTRAL", "roles_unclear", value=value)),
    )


def rule_goodwill(value: Column, evidence: Column) -> Column:
    """Only evidence of an impairment of goodwill is red; buying assets is none."""

    def decide(x: Column) -> Column:
        ev, both = x["ev"], x["both"]
        impaired = ev.rlike(fixed.GOODWILL_IMPAIRED) | ev.rlike(fixed.GOODWILL_WRITTEN_DOWN)
        return (
            F.when(states_nil(both) | both.rlike(fixed.GOODWILL_NONE), verdict("GREEN", "goodwill_none", value=value))
            .when(ev.rlike(fixed.GOODWILL_PURCHASE) & ~impaired, verdict("GREEN", "goodwill_purchase", value=value))
            .when(impaired & F.contains(ev, F.lit("goodwill")), verdict("RED", "goodwill_impaired", value=value))
            .otherwise(verdict("NEUTRAL", "goodwill_unclear", value=value))
        )

    said = F.lower(F.coalesce(evidence, F.lit("")))
    return let(terms(ev=said, both=F.concat(F.lower(value), F.lit(" "), said)), decide)


# --- numeric rules ------------------------------------------------------------------------------
def custom_rule(item: str) -> Callable[[Column], Column]:
    """The numeric rule of one item, built from its bounds and wordings."""
    bounds, (green, red, neutral) = fixed.CUSTOM_NUMERIC[item], fixed.CUSTOM_REASONS[item]

    def decide(x: Column) -> Column:
        n, shown = x["n"], x["shown"]
        return (
            F.when(N.bounds_hold(n, bounds["green"], every=True), verdict("GREEN", green, n=shown))
            .when(N.bounds_hold(n, bounds["red"], every=False), verdict("RED", red, n=shown))
            .otherwise(verdict("NEUTRAL", neutral, n=shown))
        )

    return lambda n: let(terms(n=n, shown=N.number_text(n)), decide)


def classify_band(value: Column, green: Column, red: Column) -> Column:
    """Green or red when exactly one band holds, else NEUTRAL."""
    named = lambda t: F.when(t == "", "n/a").otherwise(t)

    def decide(x: Column) -> Column:
        in_green, in_red, n, g, r = (x[k] for k in ("in_green", "in_red", "n", "g", "r"))
        return (
            F.when(in_green & ~in_red, verdict("GREEN", "band_green", n=n, green=g))
            .when(in_red & ~in_green, verdict("RED", "band_red", n=n, red=r))
            .when(in_green & in_red, verdict("NEUTRAL", "band_both", n=n, green=g, red=r))
            .otherwise(verdict("NEUTRAL", "band_neither", n=n, green=named(g), red=named(r)))
        )

    return let(
        terms(
            in_green=N.in_band(N.parse_band(green), value), in_red=N.in_band(N.parse_band(red), value),
            n=N.number_text(value), g=X.trim_all(F.coalesce(green, F.lit(""))), r=X.trim_all(F.coalesce(red, F.lit(""))),
        ),
        decide,
    )


# --- trend rules --------------------------------------------------------------------------------
def rule_working_capital(values: Column) -> Column:
    """Judged on the movement of the days, not on their level."""
    ends = let(
        N.numbers_of(values), lambda v: terms(first=F.get(v, F.lit(0)), last=F.try_element_at(v, F.lit(-1)))
    )
    return let(ends, lambda x: working_capital_flag(x["first"], x["last"]))


def working_capital_flag(first: Column, last: Column) -> Column:
    """Against a base under fifteen days the movement counts in days, else in percent."""
    text = lambda c: N.whole(c).cast("string")
    span = F.concat(text(first), F.lit("→"), text(last), F.lit(" days"))
    moved = N.whole(last - first)
    delta = F.concat(F.when(moved >= 0, "+").otherwise(""), moved.cast("string"))
    change = (last - first) / F.abs(first) * 100
    small_base = (
        F.when(moved <= 15, verdict("GREEN", "days_low", span=span, delta=delta))
        .when(moved >= 45, verdict("RED", "days_low_sharp", span=span, delta=delta))
        .otherwise(verdict("NEUTRAL", "days_low_rose", span=span, delta=delta))
    )
    return (
        F.when(first.isNull() | last.isNull(), verdict("NEUTRAL", "days_incomplete"))
        .when(last <= 0, verdict("GREEN", "days_negative", span=span))
        .when((first <= 0) | (F.abs(first) < 15), small_base)
        .when(change <= 10, verdict("GREEN", "days_stable", span=span))
        .when(change >= 40, verdict("RED", "days_sharp", span=span, change=text(change)))
        .otherwise(verdict("NEUTRAL", "days_rose", span=span, change=text(change)))
    )


def rule_dividend(values: Column) -> Column:
    """Green only when every one of the last four reported years paid; never red."""

    def decide(recent: Column) -> Column:
        size, paid = F.size(recent), F.size(F.filter(recent, lambda v: v > 0))
        n = size.cast("string")
        latest = N.whole(F.try_element_at(recent, F.lit(-1))).cast("string")
        return (
            F.when(size == 0, verdict("NEUTRAL", "dividend_missing"))
            .when(paid == size, verdict("GREEN", "dividend_steady", n=n, latest=latest))
            .when(paid == 0, verdict("NEUTRAL", "dividend_none", n=n))
            .otherwise(verdict("NEUTRAL", "dividend_erratic", paid=paid.cast("string"), n=n, latest=latest))
        )

    last_four = lambda v: F.slice(v, F.greatest(F.size(v) - 3, F.lit(1)), F.lit(4))
    return let(let(N.numbers_of(values), last_four), decide)


# --- registries ---------------------------------------------------------------------------------
TEXT_RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A1-02": rule_separation,
    "A2-01": rule_committee,
    "A3-05": rule_cheap_equity,
    "A4-05": rule_audit_opinion,
    "A8-06": rule_goodwill,
}
NUMBER_RULES: dict[str, Callable[[Column], Column]] = {i: custom_rule(i) for i in fixed.CUSTOM_NUMERIC}
SERIES_RULES: dict[str, Callable[[Column], Column]] = {
    "A8-02": rule_working_capital,
    "A10-01": rule_dividend,
}


def register_rule(kind: str, item: str, rule: Callable[..., Column]) -> None:
    """Add or replace the rule of an item; kind is 'number', 'series' or 'text'."""
    {"number": NUMBER_RULES, "series": SERIES_RULES, "text": TEXT_RULES}[kind][item] = rule


# --- materiality --------------------------------------------------------------------------------
def amount_of(value: Column, evidence: Column) -> Column:
    return F.coalesce(N.max_amount_crore(value), N.max_amount_crore(evidence))


def is_plausible(amount: Column, scale: Column) -> Column:
    """Not beyond one and a half times the larger of revenue and net worth (else ten profits)."""
    zero = F.lit(0.0)
    size = F.greatest(F.coalesce(scale["revenue"], zero), F.coalesce(scale["net_worth"], zero))
    ceiling = F.when(size > 0, size).otherwise(
        F.coalesce(scale["profit"], zero) * fixed.PROFIT_MULTIPLE
    )
    return (ceiling <= 0) | (amount <= ceiling * fixed.PLAUSIBLE_MULTIPLE)


def classify_amount(
    amount: Column, value: Column, evidence: Column, scale: Column, base: Column, green_pct: Column, red_pct: Column
) -> Column:
    """An amount against the company's size; `scale` is struct<net_worth,revenue,profit> or null.

    `amount` is amount_of(value, evidence), best computed once as a column of its own.
    """
    by_base = lambda nw, rev, pat: F.when(base == "net_worth", nw).when(base == "revenue", rev).otherwise(pat)
    against = by_base(scale["net_worth"], scale["revenue"], scale["profit"])

    def decide(x: Column) -> Column:
        pct = F.when(x["against"] > 0, x["amount"] / x["against"] * 100)
        return (
            F.when(
                x["amount"].isNull() & (states_nil(value) | states_nil(evidence)),
                verdict("GREEN", "amount_nil", value=value),
            )
            .when(x["amount"].isNull(), verdict("NEUTRAL", "amount_unread"))
            .otherwise(
                let(terms(pct=pct, shown=N.format_crore(x["amount"]), pct_text=N.percent_text(pct)), lambda y: sized(x, y))
            )
        )

    def sized(x: Column, y: Column) -> Column:
        said = {"amount": y["shown"], "base": x["label"]}
        full = {**said, "pct": y["pct_text"]}
        return (
            F.when(scale.isNull(), verdict("NEUTRAL", "amount_no_scale", **said))
            .when(~is_plausible(x["amount"], scale), verdict("NEUTRAL", "amount_implausible", **said))
            .when(y["pct"].isNull(), verdict("NEUTRAL", "amount_no_base", **said))
            .when(y["pct"] >= x["red"], verdict("RED", "amount_material", limit=N.number_text(x["red"]), **full))
            .when(y["pct"] <= x["green"], verdict("GREEN", "amount_immaterial", limit=N.number_text(x["green"]), **full))
            .otherwise(verdict("NEUTRAL", "amount_moderate", **full))
        )

    known = terms(
        amount=amount, against=against, green=green_pct, red=red_pct,
        label=by_base(F.lit("net worth"), F.lit("revenue"), F.lit("PAT")),
    )
    return let(known, decide)


def materiality_rule(item: Column, part: int) -> Column:
    """Base (0), green (1) or red (2) limit of an item; null without a rule."""
    out = None
    for name, rule in fixed.MATERIALITY.items():
        value = F.lit(rule[part] if part == 0 else float(rule[part]))
        out = F.when(item == name, value) if out is None else out.when(item == name, value)
    return out


# --- guards ---------------------------------------------------------------------------------------
def guard_amount(item: Column, flag: Column, amount: Column, scale: Column) -> Column:
    """Downgrade of a judged RED whose only figure is small or implausible; null keeps the flag."""
    worth = F.when(scale["net_worth"] > 0, amount / scale["net_worth"] * 100)
    applies = (flag == "RED") & item.isin(*fixed.GUARDED_ITEMS) & amount.isNotNull() & scale.isNotNull()
    downgrade = let(
        worth,
        lambda pct: F.when(
            ~is_plausible(amount, scale), verdict("NEUTRAL", "guard_implausible", amount=N.format_crore(amount))
        ).when(
            pct < fixed.GUARD_PERCENT,
            verdict("NEUTRAL", "guard_immaterial", amount=N.format_crore(amount), pct=N.percent_text(pct)),
        ),
    )
    return F.when(F.coalesce(applies, F.lit(False)), downgrade)


def guard_absence(item: Column, flag: Column, value: Column, evidence: Column) -> Column:
    """A GREEN built on "nothing found" is held NEUTRAL for the integrity items; else null."""
    applies = (
        (flag == "GREEN") & item.isin(*fixed.INTEGRITY_ITEMS) & is_absence(both_texts(value, evidence))
    )
    return F.when(applies, verdict("NEUTRAL", fixed.ABSENCE_NOTE))


def note_web(flag: Column, reason: Column, from_web: Column) -> Column:
    """A RED from outside research says so."""
    web_red = (flag == "RED") & F.coalesce(from_web, F.lit(False))
    return F.when(web_red, F.concat(reason, F.lit(fixed.WEB_NOTE))).otherwise(reason)


def reconcile_debt(doc_high: Column, debt_to_equity: Column) -> Column:
    """A document that reads as high debt is not trusted against a ratio below one."""
    low_ratio = F.coalesce(debt_to_equity < 1, F.lit(False))
    return F.when(doc_high & low_ratio, "use_tier1").otherwise("trust_doc")


def build_verdict(
    flag: Column, reason: Column, rationale: Column, value: Column, kind: Column, expected_na: Column,
    limit: int | None = None,
) -> Column:
    """The reader-facing answer of one result; whole, unless a display wants it cut."""
    trimmed = terms(
        **{n: X.trim_all(F.coalesce(c, F.lit(""))) for n, c in [("reason", reason), ("rationale", rationale), ("value", value)]}
    )
    text = let(trimmed, lambda x: _verdict_text(x["reason"], x["rationale"], x["value"], kind))
    missing = F.when(F.coalesce(expected_na, F.lit(False)), fixed.EXPECTED_NA_VERDICT).otherwise(
        fixed.MISSING_VERDICT
    )
    return F.when(flag == "NOT_AVAILABLE", missing).otherwise(F.substring(text, 1, limit) if limit else text)


def _verdict_text(reason: Column, rationale: Column, value: Column, kind: Column) -> Column:
    """A distrusted figure speaks first; then the rationale, completed by the reason; then the value."""
    has_reason, has_value = reason != "", (value != "") & (F.lower(value) != fixed.NOT_AVAILABLE_TEXT)
    repeats = F.contains(F.lower(rationale), F.lower(reason))
    return (
        F.when(has_reason & reason.rlike(fixed.DISTRUST), reason)
        .when((rationale != "") & has_reason & ~repeats, F.concat(rationale, F.lit(" "), reason))
        .when(rationale != "", rationale)
        .when((kind == "NUMERIC") | ~has_value, F.when(has_reason, reason).otherwise(value))
        .when(has_reason & ~F.contains(reason, value), F.concat(value, F.lit(" — "), reason))
        .otherwise(value)
    )
