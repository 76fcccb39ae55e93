"""Numbers in text, rounding and number formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions.once import let, terms
from flagstone.functions.text import trim_all

_PLAIN_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_INFINITY = float("inf")


def parse_number(text: Column) -> Column:
    """A displayed figure as a double; null when blank, a dash or not finite."""
    bare = F.regexp_replace(text, "[,₹%\\s ]", "")
    number = F.when(bare.rlike(_PLAIN_NUMBER), bare.try_cast("double"))
    return F.when(F.abs(number) < F.lit(_INFINITY), number)


def first_match(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without one, as the cast of an empty text to a number throws and catches an
    error inside Spark for every row, which costs more than ten patterns."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def first_number(text: Column) -> Column:
    """The first number written in a text, thousands commas ignored."""
    return first_match(F.replace(text, F.lit(","), F.lit("")), fixed.FIRST_NUMBER, 0).try_cast("double")


def round_half_up(value: Column, places: int = 0) -> Column:
    """Halves go towards plus infinity, for negative values too."""
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def whole(value: Column) -> Column:
    """Nearest integer, halves up, as a bigint."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def fixed_text(value: Column, places: int) -> Column:
    """Text with exactly `places` decimals (at least one), rounded on the magnitude."""
    units = F.floor(F.abs(value) * F.lit(float(10**places)) + F.lit(0.5)).cast("bigint")
    base = 10**places
    body = F.concat(
        F.floor(units / F.lit(base)).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((units % F.lit(base)).cast("string"), places, "0"),
    )
    return F.when((value < 0) & (units > 0), F.concat(F.lit("-"), body)).otherwise(body)


def number_text(value: Column) -> Column:
    """Shortest plain form: no exponent, no trailing zeros, no point for whole numbers. Values too
    large or too small for a plain form keep the exponent of their shortest text."""
    is_whole = F.abs(value) < F.lit(1e15)
    is_whole = is_whole & (value == F.floor(F.when(is_whole, value)))
    shown = F.when((F.abs(value) < F.lit(1e20)) & (F.abs(value) >= F.lit(1e-6)), value.try_cast("decimal(38,16)").cast("string"))
    plain = F.when(F.contains(shown, F.lit(".")), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
    return F.when(is_whole, F.when(is_whole, value).cast("bigint").cast("string")).otherwise(F.coalesce(plain, value.cast("string")))


def format_crore(value: Column) -> Column:
    """Rounded amount with Indian digit grouping: the last three digits, then pairs."""
    digits = F.abs(whole(value)).cast("string")
    tail = F.right(digits, F.lit(3))
    head = F.when(
        F.length(digits) > 3,
        F.regexp_replace(
            F.substring(digits, F.lit(1), F.length(digits) - 3), r"(?<=\d)(?=(\d\d)+$)", ","
        ),
    )
    grouped = F.when(head.isNull(), digits).otherwise(F.concat(head, F.lit(","), tail))
    sign = F.when(whole(value) < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(F.lit("₹"), sign, grouped, F.lit("cr"))


def percent_text(pct: Column) -> Column:
    """Two decimals below one percent, one decimal from there on."""
    return F.when(pct < 1, fixed_text(pct, 2)).otherwise(fixed_text(pct, 1))


def max_amount_crore(text: Column) -> Column:
    """The largest amount in crore named in a text."""
    figures = F.regexp_extract_all(text, F.lit(fixed.AMOUNT_CRORE), 1)
    return F.array_max(F.transform(figures, lambda f: F.replace(f, F.lit(",")).try_cast("double")))


def parse_ratio(text: Column) -> Column:
    """Share between 0 and 1 from "a of b", "a/b" or "p%"."""
    pair = lambda hit: terms(**{n: first_match(hit, fixed.COUNT_OF_TOTAL, g).try_cast("double") for n, g in [("part", 1), ("total", 2)]})
    share = let(
        let(first_match(text, fixed.COUNT_OF_TOTAL, 0), pair),
        lambda x: F.when((x["total"] > 0) & (x["part"] <= x["total"]), x["part"] / x["total"]),
    )
    percent = let(
        first_match(text, fixed.PERCENT_VALUE, 1).try_cast("double"), lambda p: F.when((p >= 0) & (p <= 100), p / 100)
    )
    return F.coalesce(share, percent)


def parse_meetings(text: Column) -> Column:
    """How often a committee met."""
    return F.coalesce(
        first_match(text, fixed.MET_TIMES, 1).try_cast("int"),
        first_match(text, fixed.N_MEETINGS, 1).try_cast("int"),
    )


def share_percent(part: Column, total: Column) -> Column:
    """part / total in percent to one decimal; null without a total."""
    return F.when(total > 0, round_half_up(part / total * F.lit(100.0), 1))


# --- bands ------------------------------------------------------------------------------------
def parse_band(text: Column) -> Column:
    """Comparable bounds of a band text as array<struct<op,value>>.

    A range takes its far end: the upper one under "<", the lower one under ">", both inclusive.
    Numbers without an operator say nothing.
    """
    plain = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "≥", ">="), "≤", "<="),
        "[–—]",
        "-",
    )
    ops, low, high = (
        F.regexp_extract_all(plain, F.lit(fixed.BAND_BOUND), group) for group in (1, 2, 3)
    )

    def bound(row: Column) -> Column:
        first, second = row["low"].try_cast("double"), F.when(row["high"] != "", row["high"]).try_cast("double")
        upper = row["ops"].startswith("<")
        value = (
            F.when(second.isNull(), first)
            .when(upper, F.greatest(first, second))
            .otherwise(F.least(first, second))
        )
        op = (
            F.when(second.isNull(), row["ops"])
            .when(upper, F.lit("<="))
            .otherwise(F.lit(">="))
        )
        return F.struct(op.alias("op"), value.alias("value"))

    rows = F.arrays_zip(ops.alias("ops"), low.alias("low"), high.alias("high"))
    return F.transform(rows, bound)


def band_unit(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    ratio = low.rlike(r"d/e|ratio|times|multiple|\bx\b")
    return (
        F.when(low.rlike("%|percent"), "percent").when(ratio, "ratio").otherwise("number")
    )


def in_band(band: Column, value: Column) -> Column:
    """True when the band has bounds and the value meets every one of them."""

    def holds(b: Column) -> Column:
        op, limit = b["op"], b["value"]
        return (
            F.when(op == "<", value < limit)
            .when(op == "<=", value <= limit)
            .when(op == ">", value > limit)
            .otherwise(value >= limit)
        )

    return (F.size(band) > 0) & F.forall(band, holds)


def bounds_hold(value: Column, bounds: Sequence[tuple[str, float]], every: bool) -> Column:
    """Literal bounds, all of them or any of them."""
    tests = [
        {"<": value < n, "<=": value <= n, ">": value > n, ">=": value >= n}[op]
        for op, n in bounds
    ]
    out = tests[0]
    for test in tests[1:]:
        out = (out & test) if every else (out | test)
    return out


# --- numeric series ----------------------------------------------------------------------------
def align(values: Column, n: Column) -> Column:
    """Pad with nulls or cut to n entries."""
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, i.cast("int")))
    ).otherwise(F.expr("cast(array() as array<double>)"))


def combine(left: Column, right: Column, f) -> Column:
    """Entry-wise f, null where either side is."""
    return F.zip_with(
        left, right, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), f(a, b))
    )


def numbers_of(values: Column) -> Column:
    """The parseable entries, in order."""
    return F.filter(F.transform(values, parse_number), lambda v: v.isNotNull())


def latest_number(values: Column) -> Column:
    nums = numbers_of(values)
    return F.try_element_at(nums, F.lit(-1))


def first_of(values: Column) -> Column:
    return F.get(numbers_of(values), F.lit(0))


def sum_numbers(values: Column) -> Column:
    """Sum of the parseable entries; null when there is none."""
    nums = numbers_of(values)
    return F.when(
        F.size(nums) > 0, F.aggregate(nums, F.lit(0.0).cast("double"), lambda a, b: a + b)
    )


def latest_text(values: Column) -> Column:
    """Last entry that is not blank, trimmed."""
    kept = F.filter(values, lambda v: v.isNotNull() & (trim_all(v) != ""))
    return trim_all(F.try_element_at(kept, F.lit(-1)))


def trend_label(values: Column) -> Column:
    """rising, declining or stable between the first and last entry; n/a without two ends."""
    kept = F.filter(values, lambda v: v.isNotNull() & (trim_all(v) != ""))
    return trend_of(first_number(F.get(kept, F.lit(0))), first_number(F.try_element_at(kept, F.lit(-1))))


def trend_of(first: Column, last: Column) -> Column:
    slack = F.greatest(F.lit(2.0), F.abs(first) * F.lit(0.02))
    return (
        F.when(first.isNull() | last.isNull(), "n/a")
        .when(last > first + slack, "rising")
        .when(last < first - slack, "declining")
        .otherwise("stable")
    )


def compact_series(periods: Column, values: Column, n: int = 6) -> Column:
    """The last n periods as "period:value" text."""
    pairs = F.zip_with(
        periods, values, lambda p, v: F.concat(p, F.lit(":"), F.coalesce(v, F.lit("-")))
    )
    size = F.size(pairs)
    return F.array_join(F.slice(pairs, F.greatest(size - n + 1, F.lit(1)), F.lit(n)), ", ")
