"""Outside research: links, hits, answers, cache, identity gate and audit."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions import text as X
from flagstone.functions.predicates import is_committed, seconds_between
from flagstone.operators.ordering import first_per_group, top_k


def link_rank(label: Column) -> Column:
    """Transcripts first, then presentations, notes, others, recordings."""
    low = F.lower(label)
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(has("transcript"), 0)
        .when(has("ppt") | has("presentation"), 1)
        .when(has("note"), 2)
        .when((low == "rec") | has("recording"), 4)
        .otherwise(3)
    )


def is_listing_link(label: Column) -> Column:
    """Navigation to a full list, not a document."""
    low = F.lower(X.trim_all(label))
    return (low == "all") | low.startswith("view all")


def cap_per_group(
    links: DataFrame, keys: Sequence[str], order: Sequence[Column],
    caps: dict[str, int] = fixed.CATEGORY_CAPS, default: int = fixed.DEFAULT_CATEGORY_CAP,
) -> DataFrame:
    """The first links of each category up to its cap; the largest cap prunes before the shuffle."""
    cap = F.lit(default)
    for name, n in caps.items():
        cap = F.when(F.col("category") == name, n).otherwise(cap)
    most = max([default, *caps.values()])
    return top_k(links, [*keys, "category"], order, most).filter(F.col("rn") <= cap)


def concat_distinct(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lists one after the other, the first of equal keys kept."""
    tagged = [f.withColumn("_list", F.lit(i)) for i, f in enumerate(frames)]
    pooled = tagged[0]
    for f in tagged[1:]:
        pooled = pooled.unionByName(f)
    return first_per_group(pooled, keys, ["_list", *order])


def dedup_by_url(hits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One hit per link, the first seen."""
    return first_per_group(hits.filter(F.coalesce(F.col("url"), F.lit("")) != ""), [*keys, "url"], order)


def hit_text() -> Column:
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.trim(F.concat_ws(" — ", some("title"), some("snippet")))


def research_hits(hits: DataFrame, keep_hits: int = 3, keep_research: int = 5) -> DataFrame:
    """Hits pooled over queries, de-duplicated, filtered and cut to the best few.

    Needs company_id, item_id, query_idx, pos, url, title, snippet, name and ticker. Research items
    keep more and ignore filing hosts; items about persons need not name the company. How many are
    kept is a parameter; `left_out` counts those beyond it for each company and item.
    """
    research = F.col("item_id").isin(*fixed.RESEARCH_ITEMS)
    person = F.col("item_id").isin(*fixed.PERSON_ITEMS)
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), "url")
    keep = (
        ~X.host_in(F.col("url"), fixed.BLOCKED_HOSTS)
        & ~(research & X.host_in(F.col("url"), fixed.FILING_HOSTS))
        & (person | X.hit_relevant(said, F.col("name"), F.col("ticker")))
    )
    unique = dedup_by_url(hits.filter(keep), ["company_id", "item_id"], ["query_idx", "pos"])
    best = top_k(unique, ["company_id", "item_id"], [F.asc("query_idx"), F.asc("pos"), F.asc("url")], max(keep_hits, keep_research))
    total = unique.groupBy("company_id", "item_id").agg(F.count("*").alias("_all"))
    limit = F.when(research, keep_research).otherwise(keep_hits)
    best = best.join(total, ["company_id", "item_id"]).withColumn("left_out", F.greatest(F.col("_all") - limit, F.lit(0))).drop("_all")
    return (
        best.filter(F.col("rn") <= limit)
        .withColumn("passage", hit_text())
        .filter(F.col("passage") != "")
    )


def query_angles(targets: DataFrame, people_asked: int = 3) -> DataFrame:
    """Search queries of each target: plain, adverse and forum for research items, then persons.

    Needs company_id, item_id, name, ticker, topic and people array<string>.
    """
    ask = lambda extra: X.search_query(
        F.col("name"), F.col("ticker"), F.concat(F.col("topic"), F.lit(extra)) if extra else F.col("topic")
    )
    research = F.col("item_id").isin(*fixed.RESEARCH_ITEMS)
    person = research & F.col("item_id").isin(*fixed.PERSON_ITEMS)
    quoted = lambda n, tail: F.concat(F.lit('"'), n, F.lit('" ' + tail))
    people = F.flatten(
        F.transform(
            F.slice(F.coalesce("people", F.expr("cast(array() as array<string>)")), 1, people_asked),
            lambda n: F.array(quoted(n, "India " + fixed.ADVERSE_TERMS), quoted(n, fixed.PERSON_FORUM_TERMS)),
        )
    )
    none = F.expr("cast(array() as array<string>)")
    angles = F.concat(
        F.array(ask("")),
        F.when(research, F.array(ask(" " + fixed.ADVERSE_TERMS), ask(" " + fixed.FORUM_TERMS))).otherwise(none),
        F.when(person, people).otherwise(none),
    )
    asked = F.array_distinct(F.filter(angles, lambda q: q != ""))
    return targets.select("company_id", "item_id", F.posexplode(asked).alias("query_idx", "query"))


def clean_names(names: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Distinct person names of each key, the first spelling kept. Needs `raw`."""
    cleaned = names.withColumn("name", X.clean_name(F.col("raw"))).filter(F.col("name").isNotNull())
    folded = cleaned.withColumn("_low", F.lower("name"))
    return first_per_group(folded, [key, "_low"], order).select(key, "name")


# --- answers --------------------------------------------------------------------------------------------
def usable_answer(answer: Column) -> Column:
    return F.coalesce((answer != "") & ~answer.startswith(fixed.ERROR_ANSWER_PREFIX), F.lit(False))


def qa_pairs(turns: DataFrame) -> DataFrame:
    """Assistant turns with the user turn right before them, unusable answers dropped.

    Turns are numbered, so the question is found by turn number: a join on (conversation, turn)
    that spreads a very long conversation, where a lag window would keep it in one task.
    """
    questions = turns.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    answers = turns.filter((F.col("role") == "assistant") & usable_answer(F.col("text"))).select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    return answers.join(questions, ["conv_id", "turn"])


def fresh_answers(
    cache: DataFrame, targets: DataFrame, now: datetime, ttl_days: int = fixed.CACHE_TTL_DAYS
) -> DataFrame:
    """Cached answers of the targets that are young enough and no errors."""
    age = seconds_between(F.col("updated_at"), F.lit(now))
    live = cache.filter((age <= ttl_days * 86400) & usable_answer(F.col("answer")))
    return live.join(targets.select("company_id", "item_id"), ["company_id", "item_id"], "left_semi")


def split_reuse_live(targets: DataFrame, cached: DataFrame) -> DataFrame:
    """Targets marked reuse or live."""
    known = cached.select("company_id", "item_id").distinct().withColumn("_hit", F.lit(True))
    return targets.join(known, ["company_id", "item_id"], "left").select(
        *targets.columns, F.when(F.col("_hit"), "reuse").otherwise("live").alias("plan")
    )


def merge_answers(live: DataFrame, cached: DataFrame) -> DataFrame:
    """All answers; a cached one takes the place of a live one."""
    on = ["company_id", "item_id"]
    a, c = live.select(*on, F.col("answer").alias("_live")), cached.select(*on, F.col("answer").alias("_cached"))
    return a.join(c, on, "full").select(
        *on, F.coalesce("_cached", "_live").alias("answer"),
        F.when(F.col("_cached").isNotNull(), "cache").otherwise("live").alias("origin"),
    )


def identity_gate(answers: DataFrame) -> DataFrame:
    """Answers about another company are dropped. Needs answer and name."""
    return answers.filter(~X.foreign_subject(F.col("answer"), F.col("name")))


# --- audit ----------------------------------------------------------------------------------------------
def audit_eligible(results: DataFrame, min_rows: int = fixed.AUDIT_MIN_ROWS) -> DataFrame:
    """Committed flagged results of runs with enough of them."""
    flagged = results.filter(is_committed(F.col("status")) & F.col("flag").isNotNull())
    enough = flagged.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return flagged.join(enough.select("run_id"), "run_id", "left_semi")


def audit_soften(results: DataFrame, findings: DataFrame, min_rows: int = fixed.AUDIT_MIN_ROWS) -> DataFrame:
    """Findings applied: only a RED changes, and only to GREEN or NEUTRAL.

    Needs findings (run_id, item_id, corrected_flag, note) unique per result; results carry run_id,
    item_id, status, flag, verdict and provider.
    """
    soft = findings.filter(F.col("corrected_flag").isin("GREEN", "NEUTRAL"))
    ready = audit_eligible(results, min_rows).filter(F.col("flag") == "RED").select("run_id", "item_id")
    applied = soft.join(ready, ["run_id", "item_id"], "left_semi")
    joined = results.join(applied, ["run_id", "item_id"], "left")
    changed = F.col("corrected_flag").isNotNull()
    note = F.coalesce(F.nullif(F.col("note"), F.lit("")), F.col("verdict"), F.lit(""))
    return joined.select(
        *[c for c in results.columns if c not in ("flag", "verdict", "provider")],
        F.coalesce("corrected_flag", "flag").alias("flag"),
        F.when(changed, note).otherwise(F.col("verdict")).alias("verdict"),
        F.when(changed, F.concat_ws("+", "provider", F.lit("qa"))).otherwise(F.col("provider")).alias("provider"),
        changed.alias("softened"),
    )


def number_in_section(items: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Position and letter of each item in its section: a..z, aa, ab, ..."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    letter = lambda i: F.char((F.lit(97) + i).cast("int"))
    i = F.col("number") - 1
    return items.withColumn("number", n).withColumn(
        "letter",
        F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26))),
    )


def date_window(now: Column, section: Column) -> tuple[Column, Column]:
    """Search window: two years for current-market sections, else twenty-five."""
    today = F.to_date(now)
    years = F.when(section.isin(*fixed.RECENT_SECTIONS), fixed.RECENT_YEARS).otherwise(fixed.HISTORY_YEARS)
    # the day of the month is counted on from the first, so 29 February falls on 1 March where there is none
    first = F.make_date(F.year(today) - years, F.month(today), F.lit(1))
    return F.date_add(first, F.dayofmonth(today) - 1), today


def choose_evidence(candidates: DataFrame) -> DataFrame:
    """The first source that found something, by the item's order of sources.

    Needs run_id, item_id, source (structured, document or web), found, web_first and unlisted.
    """
    order = (
        F.when(F.col("source") == "structured", 0)
        .when(F.col("web_first") & ~F.col("unlisted"), F.when(F.col("source") == "web", 1).otherwise(2))
        .otherwise(F.when(F.col("source") == "document", 1).otherwise(2))
    )
    found = candidates.filter("found").withColumn("priority", order)
    return first_per_group(found, ["run_id", "item_id"], ["priority"])


def pick_citation(extracts: DataFrame, passages: DataFrame) -> DataFrame:
    """Citation of the passage on the extract's page, else of the first passage.

    Needs extracts (run_id, item_id, page), passages (run_id, item_id, rn, doc_id, page).
    """
    on = ["run_id", "item_id"]
    first = passages.groupBy(*on).agg(F.min_by(F.struct("doc_id", "page"), "rn").alias("_first"))
    paged = passages.groupBy(*on, "page").agg(F.min_by("doc_id", "rn").alias("_doc"))
    return (
        extracts.join(paged, [*on, "page"], "left")
        .join(first, on, "left")
        .select(
            *on,
            F.coalesce("_doc", "_first.doc_id").alias("doc_id"),
            F.when(F.col("_doc").isNotNull(), F.col("page")).otherwise(F.col("_first.page")).alias("cited_page"),
        )
    )


