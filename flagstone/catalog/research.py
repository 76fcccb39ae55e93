"""Hits, names, queries, answers, cache, identity gate and audit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone import strategies as ST
from flagstone.catalog.oracle import with_ctes
from flagstone.catalog.registry import query
from flagstone.functions import text as X
from flagstone.operators import research as RS
from flagstone.operators import state as S
from flagstone.operators.routing import route_items
from flagstone.sources.bindings import ITEMS, Tables

_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.NAME_STOPWORDS) + "]"
_ITEM4 = "CASE CAST({} % 4 AS INT) WHEN 0 THEN 'A9-04' WHEN 1 THEN 'A1-02' WHEN 2 THEN 'A4-02' ELSE 'A9-01' END"
_COMPANY_NAME = "CASE CAST({0} % 4 AS INT) WHEN 0 THEN 'Metal Book ' || CAST({0} AS STRING) || ' Private Limited' WHEN 1 THEN 'Nora Enterprises' WHEN 2 THEN 'Trent Services Ltd' ELSE 'AB Corp' END"
HIT = [
    "page_id", "page_id % 5 AS company_id", f"{_ITEM4.format('page_id')} AS item_id",
    "CAST(page_id % 3 AS INT) AS query_idx", "CAST(page_id AS INT) AS pos",
    "CASE CAST(page_id % 9 AS INT) WHEN 0 THEN 'https://www.Facebook.com/p/' || CAST(page_id AS STRING) WHEN 1 THEN 'https://www.nseindia.com/f/' || CAST(page_id AS STRING) "
    "WHEN 2 THEN 'https://x.com/' || CAST(page_id AS STRING) WHEN 3 THEN 'https://dup.example.org/' || CAST(page_id % 40 AS STRING) WHEN 4 THEN '' ELSE url END AS url",
    "CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'About Metal-Book 0 private limited' WHEN 2 THEN 'Nora enterprises wins' WHEN 3 THEN 'T1 and T2 results' WHEN 4 THEN 'Trent reports' ELSE 'General news' END AS title",
    "CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'metal book review' ELSE 'AB corp and Trent compared' END AS snippet",
    f"{_COMPANY_NAME.format('(page_id % 5)')} AS name",
    "CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'T' || CAST(page_id % 5 AS STRING) END AS ticker",
]
_HITS = "SELECT " + ", ".join(HIT) + " FROM pages"


def hits(t: Tables) -> DataFrame:
    return t.raw("pages").selectExpr(*HIT)


def _host(url: str) -> str:
    return f"CASE WHEN regexp_matches(lower({url}), '^[a-z][a-z0-9+.-]*://') THEN regexp_extract(lower({url}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) ELSE lower({url}) END"


def _host_in(url: str, domains: list[str]) -> str:
    return "(" + " OR ".join(f"({_host(url)}) = '{d}' OR ({_host(url)}) LIKE '%.{d}'" for d in domains) + ")"


def _norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"


_TOKENS = (
    f"list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w)) || "
    "CASE WHEN length(coalesce(ticker, '')) >= 2 THEN [lower(ticker)] ELSE [] END"
)
_HAY = _norm("title || ' ' || snippet || ' ' || url")
_RELEVANT = (
    f"CASE WHEN ticker IS NULL AND {_norm('name')} <> '' THEN contains({_HAY}, {_norm('name')}) ELSE len({_TOKENS}) = 0 OR "
    f"len(list_filter({_TOKENS}, lambda w: contains({_HAY}, w))) > 0 END"
)
_RESEARCH = "item_id IN ('" + "', '".join(fixed.RESEARCH_ITEMS) + "')"
_PERSON = "item_id IN ('" + "', '".join(fixed.PERSON_ITEMS) + "')"


@query("host_filter", with_ctes(f"SELECT page_id, {_host_in('url', fixed.BLOCKED_HOSTS)} AS blocked, {_host_in('url', fixed.FILING_HOSTS)} AS filing FROM h", h=_HITS))
def host_filter(t: Tables) -> DataFrame:
    u = F.col("url")
    return hits(t).select("page_id", X.host_in(u, fixed.BLOCKED_HOSTS).alias("blocked"), X.host_in(u, fixed.FILING_HOSTS).alias("filing"))


@query("hit_relevance", with_ctes(f"SELECT page_id, {_RELEVANT} AS relevant FROM h", h=_HITS))
def hit_relevance(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", "title", "snippet", "url")
    return hits(t).select("page_id", X.hit_relevant(said, F.col("name"), F.col("ticker")).alias("relevant"))


@query("dedup_url", with_ctes("SELECT company_id, item_id, url, arg_min(page_id, query_idx * 1000000 + pos) AS page_id FROM h WHERE url <> '' GROUP BY 1, 2, 3", h=_HITS))
def dedup_url(t: Tables) -> DataFrame:
    return RS.dedup_by_url(hits(t), ["company_id", "item_id"], ["query_idx", "pos"]).select("company_id", "item_id", "url", "page_id")


HITS_KEPT_SQL = (
    f"SELECT company_id, item_id, rn, url, passage FROM (SELECT *, CASE WHEN title <> '' AND snippet <> '' THEN title || ' — ' || snippet ELSE title || snippet END AS passage, "
    f"row_number() OVER (PARTITION BY company_id, item_id ORDER BY query_idx, pos, url) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY company_id, item_id, url ORDER BY query_idx, pos) AS u FROM h "
    f"WHERE url <> '' AND NOT {_host_in('url', fixed.BLOCKED_HOSTS)} AND NOT ({_RESEARCH} AND {_host_in('url', fixed.FILING_HOSTS)}) AND ({_PERSON} OR {_RELEVANT})) WHERE u = 1) "
    f"WHERE rn <= CASE WHEN {_RESEARCH} THEN 5 ELSE 3 END AND passage <> ''"
)


@query("research_hits", with_ctes(HITS_KEPT_SQL, h=_HITS))
def research_hits(t: Tables) -> DataFrame:
    return RS.research_hits(hits(t)).select("company_id", "item_id", "rn", "url", "passage")


@query(
    "union_dedup",
    with_ctes(
        "SELECT url, arg_min(list_no || ':' || page_id, list_no * 1000000 + pos) AS kept FROM (SELECT 0 AS list_no, * FROM h WHERE page_id % 2 = 1 UNION ALL SELECT 1, * FROM h) WHERE url <> '' GROUP BY 1",
        h=_HITS,
    ),
)
def union_dedup(t: Tables) -> DataFrame:
    h = hits(t).filter("url <> ''").select("url", "page_id", "pos")
    odd = h.filter("page_id % 2 = 1").withColumn("list_no", F.lit(0))
    merged = RS.concat_distinct([odd, h.withColumn("list_no", F.lit(1))], ["url"], ["pos"])
    return merged.select("url", F.concat(F.col("list_no").cast("string"), F.lit(":"), F.col("page_id").cast("string")).alias("kept"))


# --- names --------------------------------------------------------------------------------------------------
@query(
    "name_tokens",
    "SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND NOT list_contains("
    f"{_STOP}, w)) || CASE WHEN ticker IS NULL THEN [] ELSE [lower(ticker)] END)), ' ') AS tokens, "
    f"trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{fixed.CORPORATE_FORMS}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS core FROM "
    f"(SELECT c_custkey, {_COMPANY_NAME.format('c_custkey')} || ' ' || c_mktsegment || ' Company of India' AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'TK' || c_custkey END AS ticker FROM customer)",
)
def name_tokens(t: Tables) -> DataFrame:
    named = t.raw("customer").selectExpr(
        "c_custkey", f"{_COMPANY_NAME.format('c_custkey')} || ' ' || c_mktsegment || ' Company of India' AS name",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'TK' || CAST(c_custkey AS STRING) END AS ticker",
    )
    tokens = X.name_tokens(F.col("name"), F.col("ticker"))
    return named.select("c_custkey", F.array_join(F.sort_array(tokens), " ").alias("tokens"), X.name_core(F.col("name")).alias("core"))


_RAW_NAME = (
    "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'Mr. Ravi ' || c_mktsegment WHEN 1 THEN 'RAVI ' || c_mktsegment WHEN 2 THEN 'Dr Asha Rao' "
    "WHEN 3 THEN 'Shri' WHEN 4 THEN 'Smt.  Meena Iyer ' ELSE 'X Y' END"
)


@query(
    "clean_names",
    "SELECT c_nationkey, arg_min(name, c_custkey) AS name FROM (SELECT c_nationkey, c_custkey, trim(regexp_replace("
    + _RAW_NAME + ", '(?i)^(mr|ms|mrs|dr|capt|shri|smt|prof)\\.?\\s+', '')) AS name FROM customer) WHERE length(name) >= 4 AND regexp_matches(name, '\\s') GROUP BY c_nationkey, lower(name)",
)
def clean_names(t: Tables) -> DataFrame:
    return RS.clean_names(t.raw("customer").selectExpr("c_nationkey", "c_custkey", f"{_RAW_NAME} AS raw"), "c_nationkey", ["c_custkey"])


_ANCHOR = (
    "name || CASE WHEN regexp_matches(name, '(?i)\\bindia\\b|\\blimited\\b|\\bltd\\b') THEN '' ELSE ' India' END || CASE WHEN ticker IS NOT NULL THEN ' (NSE: ' || ticker || ')' ELSE '' END || ' ' || topic"
)


@query(
    "query_angles",
    with_ctes(
        "SELECT company_id, item_id, i AS query_idx, angles[i + 1] AS query FROM (SELECT *, unnest(range(0, len(angles))) AS i FROM (SELECT company_id, item_id, "
        f"[{_ANCHOR}] || CASE WHEN {_RESEARCH} THEN [{_ANCHOR} || ' {fixed.ADVERSE_TERMS}', {_ANCHOR} || ' {fixed.FORUM_TERMS}'] ELSE [] END || "
        f"CASE WHEN {_PERSON} THEN ['\"Ravi ' || company_id || '\" India {fixed.ADVERSE_TERMS}', '\"Ravi ' || company_id || '\" {fixed.PERSON_FORUM_TERMS}'] ELSE [] END AS angles FROM q))",
        q=f"SELECT c_custkey AS company_id, {_ITEM4.format('c_custkey')} AS item_id, {_COMPANY_NAME.format('c_custkey // 4')} AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'TK' || c_custkey END AS ticker, 'topic ' || c_mktsegment AS topic FROM customer",
    ),
)
def query_angles(t: Tables) -> DataFrame:
    targets = t.raw("customer").selectExpr(
        "c_custkey AS company_id", f"{_ITEM4.format('c_custkey')} AS item_id", f"{_COMPANY_NAME.format('(c_custkey div 4)')} AS name",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'TK' || CAST(c_custkey AS STRING) END AS ticker", "'topic ' || c_mktsegment AS topic",
        "array('Ravi ' || CAST(c_custkey AS STRING)) AS people",
    )
    return RS.query_angles(targets)


@query(
    "date_window",
    "SELECT o_orderkey, (make_date((year(o_orderdate) - CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 25 END)::INT, month(o_orderdate)::INT, 1) + (day(o_orderdate)::INT - 1))::VARCHAR AS from_date, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS to_date FROM orders",
)
def date_window(t: Tables) -> DataFrame:
    section = F.when(F.col("o_orderkey") % 2 == 0, "A15").otherwise("A9")
    start, end = RS.date_window(F.col("o_orderdate"), section)
    return t.raw("orders").select("o_orderkey", start.cast("string").alias("from_date"), end.cast("string").alias("to_date"))


# --- answers ------------------------------------------------------------------------------------------------
@query(
    "qa_pairs",
    "SELECT a.conv_id, a.turn, sha256(a.text) AS answer, sha256(q.text) AS question FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 "
    "WHERE a.role = 'assistant' AND q.role = 'user' AND a.text <> '' AND a.text NOT LIKE '[Error]%'",
)
def qa_pairs(t: Tables) -> DataFrame:
    return RS.qa_pairs(t.raw("conversations")).select("conv_id", "turn", F.sha2("answer", 256).alias("answer"), F.sha2("question", 256).alias("question"))


NOW = datetime(2024, 6, 1)
_CACHE = (
    "SELECT conv_id AS company_id, turn AS item_id, CASE WHEN conv_id % 7 = 0 THEN '[Error] no answer' ELSE text END AS answer, "
    "TIMESTAMP '2024-06-01' - INTERVAL 1 DAY * (conv_id * 13 % 180) AS updated_at FROM conversations WHERE role = 'assistant'"
)
_TARGETS = "SELECT conv_id AS company_id, turn AS item_id FROM conversations WHERE (conv_id + turn) % 3 <> 0"
_FRESH = "SELECT c.* FROM cache c JOIN targets USING (company_id, item_id) WHERE updated_at >= TIMESTAMP '2024-06-01' - INTERVAL 90 DAY AND answer <> '' AND answer NOT LIKE '[Error]%'"
_CACHING = {"cache": _CACHE, "targets": _TARGETS, "fresh": _FRESH}


def cache(t: Tables) -> DataFrame:
    return t.raw("conversations").filter("role = 'assistant'").selectExpr(
        "conv_id AS company_id", "turn AS item_id", "CASE WHEN conv_id % 7 = 0 THEN '[Error] no answer' ELSE text END AS answer",
        "timestampadd(DAY, -CAST(conv_id * 13 % 180 AS INT), TIMESTAMP_NTZ '2024-06-01 00:00:00') AS updated_at",
    )


def targets(t: Tables) -> DataFrame:
    return t.raw("conversations").filter("(conv_id + turn) % 3 <> 0").selectExpr("conv_id AS company_id", "turn AS item_id")


@query("cache_fresh", with_ctes("SELECT company_id, item_id, sha256(answer) AS answer FROM fresh", **_CACHING))
def cache_fresh(t: Tables) -> DataFrame:
    return RS.fresh_answers(cache(t), targets(t), NOW).select("company_id", "item_id", F.sha2("answer", 256).alias("answer"))


@query("cache_plan", with_ctes("SELECT t.*, CASE WHEN f.answer IS NULL THEN 'live' ELSE 'reuse' END AS plan FROM targets t LEFT JOIN fresh f USING (company_id, item_id)", **_CACHING))
def cache_plan(t: Tables) -> DataFrame:
    return RS.split_reuse_live(targets(t), RS.fresh_answers(cache(t), targets(t), NOW))


@query(
    "answer_merge",
    with_ctes(
        "SELECT coalesce(l.company_id, f.company_id) AS company_id, coalesce(l.item_id, f.item_id) AS item_id, coalesce(f.answer, l.answer) IS NOT NULL AS answered, "
        "CASE WHEN f.answer IS NULL THEN 'live' ELSE 'cache' END AS origin FROM (SELECT *, 'live ' || item_id AS answer FROM targets WHERE item_id % 2 = 0 OR company_id % 3 = 0) l "
        "FULL JOIN fresh f ON f.company_id = l.company_id AND f.item_id = l.item_id",
        **_CACHING,
    ),
)
def answer_merge(t: Tables) -> DataFrame:
    live = targets(t).filter("item_id % 2 = 0 OR company_id % 3 = 0").withColumn("answer", F.concat(F.lit("live "), F.col("item_id").cast("string")))
    merged = RS.merge_answers(live, RS.fresh_answers(cache(t), targets(t), NOW))
    return merged.select("company_id", "item_id", F.col("answer").isNotNull().alias("answered"), "origin")


_SUBJECT = "CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'Metal Book Private Limited' WHEN 1 THEN 'Nora Enterprises Ltd' WHEN 2 THEN '' ELSE 'Trent Steel Limited' END"
_ANSWER = (
    "CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN 'According to filings Acme Steel Limited reported ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) WHEN 1 THEN 'MetalBook grew fast' "
    "WHEN 2 THEN 'The firm was audited by Deloitte Haskins LLP' WHEN 3 THEN 'Nora Foods Limited and Zed Holdings Limited merged' WHEN 4 THEN 'A generic remark' "
    "WHEN 5 THEN 'Shares of Nora rose' WHEN 6 THEN '' ELSE 'Trent Inc. and trentsteel were named' END"
)


def _core(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({text}), '{fixed.CORPORATE_FORMS}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


_LONG3 = "list_filter(string_split({}, ' '), lambda z: length(z) >= 3)"
_RELATED = (
    "len(list_filter(" + _LONG3.format(_core("nm")) + ", lambda x: len(list_filter(" + _LONG3.format("core") + ", lambda y: contains(x, y) OR contains(y, x))) > 0)) > 0 OR "
    f"(length(replace({_core('nm')}, ' ', '')) >= 4 AND length(replace(core, ' ', '')) >= 4 AND (contains(replace({_core('nm')}, ' ', ''), replace(core, ' ', '')) OR contains(replace(core, ' ', ''), replace({_core('nm')}, ' ', ''))))"
)


@query(
    "foreign_subject",
    with_ctes(
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, core <> '' AND answer <> '' AND NOT ((length(replace(core, ' ', '')) >= 4 AND contains(regexp_replace(lower(answer), '[^a-z0-9]+', '', 'g'), replace(core, ' ', ''))) OR "
        "len(list_filter(string_split(core, ' '), lambda w: length(w) >= 5 AND contains(' ' || regexp_replace(lower(answer), '[^a-z0-9_]+', ' ', 'g') || ' ', ' ' || w || ' '))) > 0) AND "
        f"len(list_filter(names, lambda nm: NOT ({_RELATED}))) > 0 AS foreign_subject FROM s",
        s=f"SELECT *, {_core('subject')} AS core, regexp_extract_all(answer, '{fixed.COMPANY_MENTION}', 1) AS names FROM (SELECT *, {_SUBJECT} AS subject, {_ANSWER} AS answer FROM lineitem)",
    ),
)
def foreign_subject(t: Tables) -> DataFrame:
    rows = t.spread("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_SUBJECT} AS subject", f"{_ANSWER} AS answer")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.foreign_subject(F.col("answer"), F.col("subject")).alias("foreign_subject")
    )


# --- audit --------------------------------------------------------------------------------------------------
_FINDING = (
    "SELECT run_id, item_id, CASE CAST(run_id % 3 AS INT) WHEN 0 THEN 'GREEN' WHEN 1 THEN 'NEUTRAL' ELSE 'RED' END AS corrected_flag, CASE WHEN run_id % 2 = 0 THEN 'note ' || item_id ELSE '' END AS note FROM results WHERE (run_id + item_id) % 4 <> 0"
)


@query(
    "audit_soften",
    with_ctes(
        "SELECT r.run_id, r.item_id, CASE WHEN ok THEN f.corrected_flag ELSE r.flag END AS flag, CASE WHEN ok THEN CASE WHEN f.note <> '' THEN f.note ELSE 'verdict ' || r.doc_id END ELSE 'verdict ' || r.doc_id END AS verdict, "
        "CASE WHEN ok THEN 'alpha+qa' ELSE 'alpha' END AS provider, ok AS softened FROM (SELECT r.*, coalesce(r.flag = 'RED' AND r.status IN ('DONE', 'NEEDS_REVIEW') AND n.n >= 2 AND f.corrected_flag IN ('GREEN', 'NEUTRAL'), false) AS ok "
        "FROM results r LEFT JOIN n ON n.run_id = r.run_id LEFT JOIN f ON f.run_id = r.run_id AND f.item_id = r.item_id) r LEFT JOIN f ON f.run_id = r.run_id AND f.item_id = r.item_id",
        "results", n="SELECT run_id, count(*) AS n FROM results WHERE status IN ('DONE', 'NEEDS_REVIEW') GROUP BY 1", f=_FINDING,
    ),
)
def audit_soften(t: Tables) -> DataFrame:
    results = t.results().select(
        "run_id", "item_id", "status", "flag", F.concat(F.lit("verdict "), F.col("doc_id").cast("string")).alias("verdict"), F.lit("alpha").alias("provider")
    )
    findings = t.results().filter("(run_id + item_id) % 4 <> 0").selectExpr(
        "run_id", "item_id", "CASE CAST(run_id % 3 AS INT) WHEN 0 THEN 'GREEN' WHEN 1 THEN 'NEUTRAL' ELSE 'RED' END AS corrected_flag",
        "CASE WHEN run_id % 2 = 0 THEN 'note ' || CAST(item_id AS STRING) ELSE '' END AS note",
    )
    return RS.audit_soften(results, findings, min_rows=2).select("run_id", "item_id", "flag", "verdict", "provider", "softened")


@query(
    "section_numbering",
    with_ctes(
        "SELECT run_id, item_id, number, chr(CAST(96 + number AS INT)) AS letter FROM (SELECT *, row_number() OVER (PARTITION BY run_id, section_code ORDER BY item_id) AS number FROM state WHERE status NOT IN ('DONE', 'NEEDS_REVIEW'))",
        "state",
    ),
)
def section_numbering(t: Tables) -> DataFrame:
    todo = S.plan_todo(t.runs().select("run_id"), ITEMS, t.results())
    return RS.number_in_section(todo, ["run_id", "section_code"], [F.asc("item_id")]).select("run_id", "item_id", "number", "letter")


# --- routing ------------------------------------------------------------------------------------------------
_ROUTED = sorted({*ST.BY_ITEM, *ST.WEB_TOPICS, "A5-02", "A7a-03", "A10-03", "A15-02", "A2-02"})
_ROUTED_CASE = f"CASE CAST(p_partkey % {len(_ROUTED)} AS INT) " + " ".join(f"WHEN {n} THEN '{i}'" for n, i in enumerate(_ROUTED)) + " END"
_FMT = "CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'Ratio' WHEN 1 THEN 'Text' ELSE NULL END"


def _in(values) -> str:
    return "('" + "', '".join(values) + "')"


@query(
    "evidence_route",
    "SELECT p_partkey, item_id, CASE WHEN item_id IN " + _in([i for i, s in ST.BY_ITEM.items() if s.source == "structured"]) + " THEN 'structured' WHEN item_id IN "
    + _in([i for i, s in ST.BY_ITEM.items() if s.source == "document"]) + " OR section_code IN " + _in(ST.BY_SECTION) + " THEN 'document' WHEN fmt = 'Ratio' THEN 'structured' ELSE 'document' END AS source, "
    "item_id IN " + _in(ST.WEB_TOPICS) + " AS expected_na FROM (SELECT *, regexp_extract(item_id, '^[^-]+') AS section_code FROM "
    f"(SELECT p_partkey, {_ROUTED_CASE} AS item_id, {_FMT} AS fmt FROM part))",
)
def evidence_route(t: Tables) -> DataFrame:
    items = t.raw("part").selectExpr(
        "p_partkey", f"{_ROUTED_CASE} AS item_id", "p_name AS item", f"{_FMT} AS output_format", "p_type AS source_hint"
    ).withColumn("section_code", F.regexp_extract("item_id", "^[^-]+", 0))
    return route_items(items).select("p_partkey", "item_id", "source", "expected_na")


@query("evidence_route_terms")
def evidence_route_terms(t: Tables) -> DataFrame:
    items = t.raw("part").selectExpr(
        "p_partkey", f"{_ROUTED_CASE} AS item_id", "p_name AS item", f"{_FMT} AS output_format", "p_type AS source_hint"
    ).withColumn("section_code", F.regexp_extract("item_id", "^[^-]+", 0))
    return route_items(items).select("p_partkey", "item_id", "metric", "doc_types", "headings", "keywords", "web_topic")


@query(
    "item_keywords",
    "SELECT p_partkey, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 8), ' ') AS keywords FROM (SELECT p_partkey, "
    "list_filter(string_split_regex(lower(p_name || ' ' || p_brand || ' the note and note of ' || p_type || ' ' || p_name || coalesce(p_type, '')), '[^a-z0-9]+'), lambda x: length(x) > 3) AS w FROM part)",
)
def item_keywords(t: Tables) -> DataFrame:
    text = F.expr("p_name || ' ' || p_brand || ' the note and note of ' || p_type")
    hint = F.expr("p_name || p_type")
    return t.raw("part").select("p_partkey", F.array_join(X.keywords_from(text, hint), " ").alias("keywords"))
