"""Yes/no questions over values and findings, and small label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions.text import trim_all


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def item_kind(output_format: Column) -> Column:
    """NUMERIC or QUALITATIVE; explicit judgement formats win over a number in the same text."""
    low = _low(output_format)
    some = lambda hints: F.exists(
        F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(low, h)
    )
    return (
        F.when(some(fixed.QUALITATIVE_HINTS), "QUALITATIVE")
        .when(some(fixed.NUMERIC_HINTS), "NUMERIC")
        .otherwise("QUALITATIVE")
    )


def is_committed(status: Column) -> Column:
    return F.coalesce(status.isin(*fixed.COMMITTED), F.lit(False))


def is_na(value: Column) -> Column:
    """Missing, empty or the not-available text in any case."""
    return F.coalesce(
        (value == "") | (F.lower(trim_all(value)) == fixed.NOT_AVAILABLE_TEXT), F.lit(True)
    )


def is_unlisted(ticker: Column) -> Column:
    return F.coalesce(ticker, F.lit("")) == ""


def is_absence(text: Column) -> Column:
    """Reads as "we found nothing" rather than as a confirmation."""
    low = _low(text)
    return (trim_all(low) == "") | low.rlike(fixed.ABSENCE)


def states_nil(text: Column) -> Column:
    """States a true zero; a data gap is none."""
    low = _low(text)
    nil = low.rlike("|".join(f"(?:{p})" for p in (fixed.NIL_WORD, fixed.NO_EXPOSURE, fixed.ZERO_EXPOSURE, fixed.ZERO_AMOUNT)))
    return (low != "") & ~low.rlike(fixed.DATA_GAP) & nil


def confidence_score(word: Column) -> Column:
    return F.when(word == "high", 0.9).when(word == "medium", 0.6).when(word == "low", 0.3)


def confidence_label(score: Column) -> Column:
    return (
        F.when(score.isNull(), "—")
        .when(score >= 0.8, "High")
        .when(score >= 0.45, "Medium")
        .otherwise("Low")
    )


def basis_label(provider: Column, research_token: str = "research") -> Column:
    """How a flag was decided, in plain words; `research_token` marks outside research."""
    low = _low(provider)
    return (
        F.when(low == "", "the engine")
        .when(F.contains(low, F.lit("deterministic")), "a deterministic rule (no AI)")
        .when(F.contains(low, F.lit(research_token)), "AI research over the web")
        .otherwise("AI reasoning over the filings")
    )


def doc_type_label(doc_type: Column) -> Column:
    return (
        F.when(doc_type == "ANNUAL_REPORT", "Annual report")
        .when(doc_type == "EARNINGS_PDF", "Concall")
        .when(doc_type == "ANNOUNCEMENT", "Filing")
        .otherwise(F.lower(F.replace(doc_type, F.lit("_"), F.lit(" "))))
    )


def provider_set(*providers: Column) -> Column:
    """Distinct providers out of "+"-joined texts, in order, joined again; null when none."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(p, F.lit("")), r"\+") for p in providers]))
    kept = F.array_distinct(F.filter(parts, lambda p: p != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "+"))


def normalise_enum(value: Column, domain: list[str]) -> Column:
    """Trimmed and upper-cased when in the domain, else null."""
    upper = F.upper(trim_all(value))
    return F.when(upper.isin(*domain), upper)


def age_label(at: Column, now: Column) -> Column:
    secs = F.greatest(F.lit(0).cast("bigint"), seconds_between(at, now))
    days, hours, mins = (F.floor(secs / n).cast("bigint") for n in (86400, 3600, 60))
    say = lambda n, one, many: F.when(n == 1, f"1 {one} ago").otherwise(
        F.concat(n.cast("string"), F.lit(f" {many} ago"))
    )
    return (
        F.when(days >= 1, say(days, "day", "days"))
        .when(hours >= 1, say(hours, "hour", "hours"))
        .when(mins >= 1, say(mins, "min", "min"))
        .otherwise("just now")
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def is_stale(at: Column, now: Column, days: int = fixed.STALE_AFTER_DAYS) -> Column:
    return F.coalesce(seconds_between(at, now) > F.lit(days * 86400), F.lit(True))


def days_since(at: Column, now: Column) -> Column:
    whole = F.floor(seconds_between(at, now) / 86400).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(whole, F.lit(0).cast("bigint")))


def source_host(url: Column) -> Column:
    return F.parse_url(url, F.lit("HOST"))


def citation_label(name: Column, doc_type: Column, url: Column, page: Column) -> Column:
    """Where a finding comes from: document, its type or the host; then the page."""
    where = F.coalesce(name, doc_type, F.try_parse_url(url, F.lit("HOST")), F.lit("source"))
    return F.concat(
        where, F.when(page.isNotNull(), F.concat(F.lit(" p."), page.cast("string"))).otherwise(F.lit(""))
    )


def answer_or_verdict(value: Column, verdict: Column) -> Column:
    """A bare "not available" says nothing: the verdict speaks instead."""
    usable = F.when((value != "") & (F.lower(value) != fixed.NOT_AVAILABLE_TEXT), value)
    return F.coalesce(usable, verdict, value, F.lit("—"))
