"""From an analysed item to its flag: the ordered rule list, guards, cross-check and gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions import numbers as N
from flagstone.functions import rules as R
from flagstone.functions.predicates import is_na, is_unlisted


def _by_item(item: Column, rules: dict, *args: Column) -> Column:
    """The verdict of the item's own rule; null for items without one."""
    return reduce(
        lambda out, pair: out.when(item == pair[0], pair[1](*args)),
        rules.items(),
        F.when(F.lit(False), R.no_verdict()),
    )


def rule_fired() -> Column:
    """Which step decides, first match wins."""
    item = F.col("item_id")
    return (
        F.when(is_na(F.col("value")), "not_available")
        .when(item.isin(*R.SERIES_RULES) & F.exists("series", lambda v: v.isNotNull()), "series")
        .when(item.isin(*R.NUMBER_RULES) & F.col("num").isNotNull(), "custom_numeric")
        .when(item.isin(*R.TEXT_RULES), "text")
        .when(item.isin(*fixed.MATERIALITY), "materiality")
        .when(
            (F.col("kind") == "NUMERIC") & ~F.coalesce(F.col("note_mode"), F.lit(False)) & F.col("num").isNotNull(),
            "band",
        )
        .otherwise("opinion")
    )


def apply_rules(analyses: DataFrame) -> DataFrame:
    """Adds num, amount, rule_fired and the verdict of every step that needs no opinion.

    Needs item_id, kind, value, evidence, series array<string>, note_mode, green_band, red_band and
    scale struct<net_worth,revenue,profit>.
    """
    item, value, evidence, num = F.col("item_id"), F.col("value"), F.col("evidence"), F.col("num")
    fired = F.col("rule_fired")
    settled = (
        F.when(fired == "not_available", R.verdict("NOT_AVAILABLE", "no_evidence"))
        .when(fired == "series", _by_item(item, R.SERIES_RULES, F.col("series")))
        .when(fired == "custom_numeric", _by_item(item, R.NUMBER_RULES, num))
        .when(fired == "text", _by_item(item, R.TEXT_RULES, value, evidence))
        .when(
            fired == "materiality",
            R.classify_amount(
                F.col("amount"), value, evidence, F.col("scale"), *[R.materiality_rule(item, part) for part in range(3)]
            ),
        )
        .when(fired == "band", R.classify_band(num, F.col("green_band"), F.col("red_band")))
    )
    sized = item.isin(*fixed.MATERIALITY, *fixed.GUARDED_ITEMS)
    return (
        analyses.withColumn("num", N.first_number(value))
        .withColumn("amount", F.when(sized, R.amount_of(value, evidence)))
        .withColumn("rule_fired", rule_fired())
        .withColumn("settled", settled)
    )


def opinions_wide(opinions: DataFrame, keys: list[str]) -> DataFrame:
    """First and second opinion of each key side by side."""
    pick = lambda n: F.max_by(F.struct("flag", "reason", "provider"), F.when(F.col("seq") == n, F.lit(1)))
    return opinions.filter(F.col("seq").isin(1, 2)).groupBy(*keys).agg(
        pick(1).alias("first"), pick(2).alias("second")
    )


def assign_flags(analyses: DataFrame, opinions: DataFrame, keys: list[str]) -> DataFrame:
    """Flag, reason, gate, review mark and provider of every analysis.

    `opinions` holds (keys, seq, flag, reason, provider). Without a first opinion an item no rule
    settles is NEUTRAL; without the checking opinion a RED stands but is marked for review.
    """
    return decide(analyses.join(opinions_wide(opinions, keys), keys, "left"))


def decide(analyses: DataFrame) -> DataFrame:
    """assign_flags for rows that already carry `first` and `second` opinion structs (or nulls)."""
    item, value, evidence = F.col("item_id"), F.col("value"), F.col("evidence")
    first, second = F.col("first"), F.col("second")
    guard = F.coalesce(
        R.guard_amount(item, first["flag"], F.col("amount"), F.col("scale")),
        R.guard_absence(item, first["flag"], value, evidence),
    )
    judged = (
        F.when(
            first.isNull(),
            R.verdict("NEUTRAL", "no_opinion", why=F.lit("no opinion recorded")),
        )
        .when(F.col("guard").isNotNull(), F.col("guard"))
        .otherwise(
            F.struct(
                first["flag"].alias("flag"),
                R.note_web(first["flag"], first["reason"], F.col("from_web")).alias("reason"),
            )
        )
    )
    numeric = F.col("rule_fired").isin("custom_numeric", "band")
    by_opinion = F.col("rule_fired") == "opinion"
    joined = (
        apply_rules(analyses)
        .withColumn("guard", F.when(by_opinion & first.isNotNull(), guard))
        .withColumn("base", F.coalesce(F.col("settled"), judged))
        .withColumn(
            "checker",
            F.when(numeric, first).when(by_opinion & first.isNotNull() & F.col("guard").isNull(), second),
        )
        .withColumn(
            "checked",
            (F.col("base.flag") == "RED")
            & (numeric | (by_opinion & first.isNotNull() & F.col("guard").isNull())),
        )
    )
    own = F.when(by_opinion, first["provider"]).when(
        F.col("rule_fired").isin("series", "text", "materiality"), F.lit("deterministic")
    )
    checked = cross_check(joined, own)
    return with_gate(checked).drop("num", "amount", "settled", "first", "second", "guard", "base", "checker", "checked")


def cross_check(df: DataFrame, own_provider: Column) -> DataFrame:
    """A checked RED stands when the other opinion agrees, falls to NEUTRAL when it does not, and
    stands marked for review when there is none. Needs base, checker and checked."""
    flag, reason, other = F.col("base.flag"), F.col("base.reason"), F.col("checker")
    missing = F.col("checked") & other.isNull()
    disputed = F.col("checked") & other.isNotNull() & (other["flag"] != "RED")
    return df.select(
        "*",
        F.when(disputed, "NEUTRAL").otherwise(flag).alias("flag"),
        F.when(
            disputed,
            R.fill(fixed.REASONS["red_disputed"], provider=other["provider"], flag=other["flag"], reason=reason),
        )
        .when(missing, R.fill(fixed.REASONS["red_unchecked"], reason=reason))
        .otherwise(reason)
        .alias("reason"),
        (disputed | missing).alias("needs_review"),
        F.nullif(
            F.concat_ws("+", own_provider, F.when(F.col("checked"), other["provider"])), F.lit("")
        ).alias("provider"),
    )


def with_gate(df: DataFrame) -> DataFrame:
    """gate_pass: only for non-negotiable items; GREEN passes, RED fails, the rest is open."""
    gate = F.when(
        F.col("non_negotiable"), F.when(F.col("flag") == "GREEN", True).when(F.col("flag") == "RED", False)
    )
    return df.withColumn("gate_pass", gate)


def not_applicable(item: Column, ticker: Column) -> Column:
    """A listed-only item of an unlisted company."""
    return is_unlisted(ticker) & item.isin(*fixed.LISTED_ONLY)


def apply_applicability(results: DataFrame) -> DataFrame:
    """Listed-only items of unlisted companies get the fixed answer. Needs item_id and ticker."""
    out = not_applicable(F.col("item_id"), F.col("ticker"))
    put = {
        "flag": F.lit("NOT_AVAILABLE"),
        "value": F.lit("not applicable"),
        "verdict": F.lit(fixed.LISTED_ONLY_VERDICT),
        "status": F.lit("DONE"),
        "confidence": F.lit(0.9),
    }
    return results.withColumns({c: F.when(out, v).otherwise(F.col(c)) for c, v in put.items() if c in results.columns})
