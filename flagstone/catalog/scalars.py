"""Scalar functions over the tables: numbers, bands, text, enums, payloads, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.catalog.oracle import with_ctes
from flagstone.catalog.registry import query
from flagstone.functions import numbers as N
from flagstone.functions import payload as PL
from flagstone.functions import predicates as P
from flagstone.functions import text as X
from flagstone.sources import landing as L
from flagstone.sources.bindings import Tables

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE = ", ".join(LINE)
_BIG = "CAST(FLOOR(l_extendedprice) AS BIGINT)"
_DISPLAY = (
    f"CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN '₹ ' || CAST(CAST(FLOOR({_BIG} / 1000) AS BIGINT) AS STRING) || ',' || LPAD(CAST({_BIG} % 1000 AS STRING), 3, '0') "
    f"WHEN 1 THEN CAST({_BIG} AS STRING) || '.5%' WHEN 2 THEN '-' WHEN 3 THEN ' ' WHEN 4 THEN '-' || CAST({_BIG} AS STRING) WHEN 5 THEN 'n/a ' || CAST({_BIG} AS STRING) "
    f"WHEN 6 THEN NULL ELSE CAST(l_linenumber AS STRING) || 'e3' END"
)


@query(
    "parse_number",
    f"SELECT {_LINE}, CASE WHEN regexp_full_match(bare, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(bare AS DOUBLE) END AS num FROM "
    f"(SELECT {_LINE}, regexp_replace({_DISPLAY}, '[,₹%\\s\\x{{00A0}}]', '', 'g') AS bare FROM lineitem)",
)
def parse_number(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(*LINE, N.parse_number(F.expr(_DISPLAY)).alias("num"))


@query("first_number", f"SELECT {_LINE}, TRY_CAST(nullif(regexp_extract(replace({_DISPLAY}, ',', ''), '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS num FROM lineitem")
def first_number(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(*LINE, N.first_number(F.expr(_DISPLAY)).alias("num"))


@query("round_half_up", f"SELECT {_LINE}, floor(v + 0.5) AS r0, floor(v * 10.0e0 + 0.5) / 10.0e0 AS r1 FROM (SELECT *, (l_quantity - 25) / 4 AS v FROM lineitem)")
def round_half_up(t: Tables) -> DataFrame:
    v = (F.col("l_quantity") - 25) / 4
    return t.raw("lineitem").select(*LINE, N.round_half_up(v).alias("r0"), N.round_half_up(v, 1).alias("r1"))


@query(
    "fmt_crore",
    f"SELECT {_LINE}, '₹' || CASE WHEN length(d) <= 3 THEN d ELSE trim(regexp_replace(reverse(regexp_replace(reverse(left(d, -3)), '(\\d\\d)', '\\1,', 'g')), '^,', '')) || ',' || right(d, 3) END || 'cr' AS shown "
    f"FROM (SELECT {_LINE}, CAST(CAST(floor(l_extendedprice * l_linenumber * l_linenumber / 7 + 0.5) AS BIGINT) AS VARCHAR) AS d FROM lineitem)",
)
def fmt_crore(t: Tables) -> DataFrame:
    v = F.col("l_extendedprice") * F.col("l_linenumber") * F.col("l_linenumber") / 7
    return t.raw("lineitem").select(*LINE, N.format_crore(v).alias("shown"))


# --- bands ------------------------------------------------------------------------------------------------
_A, _B = "CAST(p_size AS STRING)", "CAST(p_size % 7 + 20 AS STRING)"
_BAND = (
    f"CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '<' || {_A} || '–' || {_B} WHEN 1 THEN '>=' || {_A} || ' - ' || {_B} || ' / rising' WHEN 2 THEN '≥' || {_A} || '% independent; board 8–12' "
    f"WHEN 3 THEN '0% (or <' || {_A} || '%)' WHEN 4 THEN 'Stable, prose only' ELSE '> ' || {_A} || '.5 or ≤ 3' END"
)
_PARSED = (
    "SELECT p_partkey, i, CASE WHEN high = '' THEN op WHEN op LIKE '<%' THEN '<=' ELSE '>=' END AS op, CASE WHEN high = '' THEN CAST(low AS DOUBLE) WHEN op LIKE '<%' THEN greatest(CAST(low AS DOUBLE), CAST(high AS DOUBLE)) "
    "ELSE least(CAST(low AS DOUBLE), CAST(high AS DOUBLE)) END AS value FROM (SELECT p_partkey, i, regexp_extract_all(b, '{p}', 1)[i + 1] AS op, regexp_extract_all(b, '{p}', 2)[i + 1] AS low, "
    "coalesce(regexp_extract_all(b, '{p}', 3)[i + 1], '') AS high FROM (SELECT p_partkey, b, unnest(range(0, len(regexp_extract_all(b, '{p}', 1)))) AS i FROM "
    "(SELECT p_partkey, replace(replace(regexp_replace({band}, '[–—]', '-', 'g'), '≥', '>='), '≤', '<=') AS b FROM part)))"
).format(p=fixed.BAND_BOUND.replace("{", "{{").replace("}", "}}"), band=_BAND)


@query("band_parse", with_ctes("SELECT * FROM parsed", parsed=_PARSED))
def band_parse(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", F.posexplode(N.parse_band(F.expr(_BAND))).alias("i", "b")).select("p_partkey", "i", "b.op", "b.value")


@query(
    "band_member",
    with_ctes(
        "SELECT p.p_partkey, coalesce(bool_and(CASE op WHEN '<' THEN v < value WHEN '<=' THEN v <= value WHEN '>' THEN v > value ELSE v >= value END), false) AS inside FROM "
        "(SELECT p_partkey, p_partkey % 53 AS v FROM part) p LEFT JOIN parsed b ON b.p_partkey = p.p_partkey GROUP BY 1",
        parsed=_PARSED,
    ),
)
def band_member(t: Tables) -> DataFrame:
    value = (F.col("p_partkey") % 53).cast("double")
    return t.raw("part").select("p_partkey", N.in_band(N.parse_band(F.expr(_BAND)), value).alias("inside"))


# --- text -------------------------------------------------------------------------------------------------
@query("clean_text", "SELECT doc_id, sha256(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g'))) AS digest, substr(trim(regexp_replace(replace(text, chr(160), ' '), '\\s+', ' ', 'g')), 1, 40) AS head FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", F.sha2(X.clean_text(F.col("text")), 256).alias("digest"), X.clean_text(F.col("text"), 40).alias("head"))


@query("strip_nul", "SELECT doc_id, sha256(text) AS digest, lang || source AS tags FROM documents")
def strip_nul(t: Tables) -> DataFrame:
    """NUL characters are put in first: into the text and into a nested field."""
    dirty = t.spread("documents").select(
        "doc_id", F.concat(F.substring("text", 1, 5), F.lit("\u0000"), F.expr("substring(text, 6)"), F.lit("\u0000")).alias("text"),
        F.array(F.struct(F.concat(F.lit("\u0000"), F.col("lang")).alias("a")), F.struct(F.concat(F.col("source"), F.lit("\u0000")).alias("a"))).alias("tags"),
    )
    clean = X.strip_nul(dirty)
    return clean.select("doc_id", F.sha2("text", 256).alias("digest"), F.array_join(F.transform("tags", lambda x: x["a"]), "").alias("tags"))


_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&quot;", '"'), ("&nbsp;", " ")]


def _markup_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({text}, '(?is)<doc_source>.*?</doc_source>', '', 'g'), '(?is)<docsource>.*?</docsource>', '', 'g'), '<[^>]+>', '', 'g')"
    for entity, plain in _ENTITIES:
        out = f"replace({out}, '{entity}', '{plain}')"
    return f"regexp_replace(regexp_replace({out}, '\n{{3,}}', '\n\n', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("clean_markup", f"SELECT page_id, sha256({_markup_sql('html')}) AS digest FROM (SELECT page_id, '<Doc_Source>' || url || '</doc_source>' || html || '\n\n\n\n &lt;end&gt; ' AS html FROM pages)")
def clean_markup(t: Tables) -> DataFrame:
    body = F.expr("'<Doc_Source>' || url || '</doc_source>' || html || '\n\n\n\n &lt;end&gt; '")
    return t.raw("pages").select("page_id", F.sha2(X.clean_markup(body), 256).alias("digest"))


_CITED = "'See ' || url || '. Also (' || url || ') and <a href=\"' || url || '/x\">it</a>; HTTP://other.example.org/p,;: done'"


@query("extract_urls", f"SELECT page_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS urls FROM (SELECT page_id, list_transform(regexp_extract_all({_CITED}, '{fixed.SOURCE_URL.replace(chr(39), chr(39) * 2)}'), lambda x: regexp_replace(x, '[.,;:]+$', '')) AS u FROM pages)")
def extract_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.array_join(X.extract_urls(F.expr(_CITED)), " ").alias("urls"))


_BODY = (
    "CASE CAST(page_id % 3 AS INT) WHEN 0 THEN 'x<ans>first &amp; <b>' || url || '</b></ans> noise <ANS>second</ANS>' WHEN 1 THEN '{\"answer\": \"plain ' || url || '\"}' ELSE 'neither' END"
)


@query("answer_body", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'first & ' || url || '\n\nsecond' WHEN 1 THEN 'plain ' || url ELSE '' END AS answer FROM pages")
def answer_body(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.answer_of(F.expr(_BODY)).alias("answer"))


@query("enum_domain", "SELECT event_id, CASE WHEN upper(trim(e)) IN ('CLICK', 'VIEW', 'PURCHASE') THEN upper(trim(e)) END AS kind FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '  ' || event_type ELSE event_type || ' ' END AS e FROM events)")
def enum_domain(t: Tables) -> DataFrame:
    raw = F.expr("CASE WHEN event_id % 2 = 0 THEN '  ' || event_type ELSE event_type || ' ' END")
    return t.raw("events").select("event_id", P.normalise_enum(raw, ["CLICK", "VIEW", "PURCHASE"]).alias("kind"))


_PROVIDER = "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'deterministic' WHEN 2 THEN 'research+' || event_type WHEN 3 THEN '' ELSE event_type END"


@query(
    "basis_label",
    f"SELECT event_id, CASE WHEN coalesce(p, '') = '' THEN 'the engine' WHEN contains(p, 'deterministic') THEN 'a deterministic rule (no AI)' WHEN contains(p, 'research') THEN 'AI research over the web' ELSE 'AI reasoning over the filings' END AS basis "
    f"FROM (SELECT event_id, {_PROVIDER} AS p FROM events)",
)
def basis_label(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", P.basis_label(F.expr(_PROVIDER)).alias("basis"))


@query(
    "provider_set",
    "SELECT event_id, nullif(array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), '+'), '') AS providers FROM (SELECT event_id, list_filter(string_split(coalesce("
    f"{_PROVIDER}, ''), '+') || string_split(event_type || '+deterministic', '+'), lambda x: x <> '') AS u FROM events)",
)
def provider_set(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", P.provider_set(F.expr(_PROVIDER), F.expr("event_type || '+deterministic'")).alias("providers"))


@query(
    "confidence_label",
    "SELECT event_id, CASE WHEN v IS NULL THEN '—' WHEN v >= 0.8 THEN 'High' WHEN v >= 0.45 THEN 'Medium' ELSE 'Low' END AS label, CASE WHEN event_id % 3 = 0 THEN 0.9e0 WHEN event_id % 3 = 1 THEN 0.6e0 ELSE 0.3e0 END AS score "
    "FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value / 50 END AS v FROM events)",
)
def confidence_label(t: Tables) -> DataFrame:
    v = F.when(F.col("event_id") % 11 != 0, F.col("value") / 50)
    word = F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "medium").otherwise("low")
    return t.raw("events").select("event_id", P.confidence_label(v).alias("label"), P.confidence_score(word).alias("score"))


@query(
    "source_label",
    "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Report ' || page_id WHEN page_id % 4 = 1 THEN 'ANNUAL_REPORT' WHEN page_id % 4 = 2 THEN regexp_extract(url, '://([^/?#:]+)', 1) ELSE 'source' END || CASE WHEN page_id % 3 = 0 THEN ' p.' || page_id ELSE '' END AS label, "
    "CASE WHEN page_id % 2 = 0 THEN 'value' ELSE 'verdict ' || page_id END AS detail FROM pages",
)
def source_label(t: Tables) -> DataFrame:
    c = F.col("page_id")
    name = F.when(c % 4 == 0, F.concat(F.lit("Report "), c.cast("string")))
    kind, link = F.when(c % 4 == 1, "ANNUAL_REPORT"), F.when(c % 4 == 2, F.col("url"))
    value = F.when(c % 2 == 0, "value").otherwise("Not Available")
    return t.raw("pages").select(
        "page_id", P.citation_label(name, kind, link, F.when(c % 3 == 0, c)).alias("label"),
        P.answer_or_verdict(value, F.concat(F.lit("verdict "), c.cast("string"))).alias("detail"),
    )


@query("doc_type_label", with_ctes("SELECT doc_id, CASE doc_type WHEN 'ANNUAL_REPORT' THEN 'Annual report' WHEN 'EARNINGS_PDF' THEN 'Concall' WHEN 'ANNOUNCEMENT' THEN 'Filing' ELSE 'web' END AS label FROM docs", "docs"))
def doc_type_label(t: Tables) -> DataFrame:
    return t.documents().select("doc_id", P.doc_type_label(F.col("doc_type")).alias("label"))


@query("rename_defaults", "SELECT p_partkey AS id, p_brand AS \"sectionCode\", p_name AS item, '' AS description, CASE WHEN p_size % 2 = 0 THEN 'Ratio' END AS \"outputFormat\", NULL::VARCHAR AS \"greenFlag\", NULL::VARCHAR AS \"redFlag\", p_type AS \"sourceHint\", coalesce(p_size > 40, false) AS \"isNonNegotiable\" FROM part")
def rename_defaults(t: Tables) -> DataFrame:
    stored = t.raw("part").selectExpr(
        "p_partkey AS id", "p_brand AS section_code", "p_name AS item", "CAST(NULL AS STRING) AS description", "CASE WHEN p_size % 2 = 0 THEN 'Ratio' END AS output_format",
        "CAST(NULL AS STRING) AS green_flag", "CAST(NULL AS STRING) AS red_flag", "p_type AS source_hint", "CASE WHEN p_size > 40 THEN true END AS is_non_negotiable",
    )
    return PL.to_engine_item(stored)


@query("url_candidates", "SELECT s_suppkey, i, 'https://pages.example.org/company/T%26' || s_suppkey || CASE i WHEN 0 THEN '/consolidated/' ELSE '/' END AS url FROM supplier CROSS JOIN (VALUES (0), (1)) v(i)")
def url_candidates(t: Tables) -> DataFrame:
    code = F.concat(F.lit(" t&"), F.col("s_suppkey").cast("string"), F.lit(" "))
    return t.raw("supplier").select("s_suppkey", F.posexplode(PL.url_candidates("https://pages.example.org", code)).alias("i", "url"))


# --- payloads ---------------------------------------------------------------------------------------------
_WRAPPED = (
    "CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Sure: ```json\n' || props || '\n``` done' WHEN 1 THEN 'The value is ' || props || ' as asked' WHEN 2 THEN 'no json here' WHEN 3 THEN '{\"other\": 1}' ELSE props END"
)


@query("payload_validate", "SELECT event_id, event_id % 5 NOT IN (2, 3) AS valid, CASE WHEN event_id % 5 NOT IN (2, 3) THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def payload_validate(t: Tables) -> DataFrame:
    checked = PL.validate_payload(t.raw("events").select("event_id", F.expr(_WRAPPED).alias("body")), "body", "k int", ["k"])
    return checked.select("event_id", "valid", F.when(F.col("valid"), F.col("parsed.k")).alias("k"))


@query("marker_table", f"SELECT {_LINE}, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) END AS cells, CASE WHEN l_partkey % 3 = 0 THEN 'quote ' || l_partkey END AS quote FROM lineitem")
def marker_table(t: Tables) -> DataFrame:
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    table = F.struct(F.array(F.lit("Part"), F.lit("Supplier")).alias("columns"), F.array(F.array(part, supp)).alias("rows"))
    stored = F.when(F.col("l_partkey") % 3 != 0, PL.pack_table(table)).otherwise(F.concat(F.lit("quote "), part))
    rows = t.raw("lineitem").select(*LINE, stored.alias("evidence"))
    return rows.select(
        *LINE, F.array_join(F.get(PL.unpack_table(F.col("evidence"))["rows"], F.lit(0)), "/").alias("cells"), PL.plain_quote(F.col("evidence")).alias("quote")
    )


@query("map_rows", "SELECT s_suppkey, 'T' || s_suppkey AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN 'T' || s_suppkey ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Tools' END AS industry, 'N' || s_nationkey AS country FROM supplier")
def map_rows(t: Tables) -> DataFrame:
    row = F.expr("map('T' || CAST(s_suppkey AS STRING), array('N' || CAST(s_nationkey AS STRING), CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, CASE WHEN s_suppkey % 2 = 0 THEN 'Tools' END))")
    return PL.explode_map_rows(t.raw("supplier").select("s_suppkey", row.alias("m")), "m")


_LIST = "'[{\"url\":\"' || url || '\",\"title\":\"one\",\"description\":\"d\"},{\"title\":\"no link\"},{\"url\":\"https://two.example.org/\",\"snippet\":\"s\"}]'"


@query(
    "payload_shapes",
    "SELECT page_id, 0 AS pos, url, 'one' AS title, 'd' AS snippet FROM pages WHERE page_id % 4 <> 3 UNION ALL SELECT page_id, 2, 'https://two.example.org/', NULL, 's' FROM pages WHERE page_id % 4 <> 3",
)
def payload_shapes(t: Tables) -> DataFrame:
    body = F.expr(
        f"CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '{{\"data\":' || {_LIST} || '}}' WHEN 1 THEN '{{\"data\":{{\"web\":' || {_LIST} || '}}}}' WHEN 2 THEN '{{\"web\":' || {_LIST} || '}}' ELSE '{{\"data\":null}}' END"
    )
    return PL.unify_payload(t.raw("pages").select("page_id", body.alias("body")), "body")


@query("content_sniff", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'pdf' ELSE 'other' END AS kind FROM documents")
def content_sniff(t: Tables) -> DataFrame:
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("text"))).otherwise(F.col("text")).cast("binary")
    header = F.when(F.col("doc_id") % 4 == 0, "Application/PDF; q=1").otherwise("text/html")
    return t.raw("documents").select("doc_id", PL.sniff_type(content, header).alias("kind"))


# --- landing ----------------------------------------------------------------------------------------------
_FILES = [
    "doc_id", "source || '-' || CAST(doc_id % 4 AS STRING) AS run_id", "'f' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.PDF' END AS name",
    "n_chars * 2000 AS bytes", "CASE WHEN doc_id % 6 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text",
]
_INTAKE = (
    "SELECT f.*, CASE WHEN n > 12 THEN 'at most 12 files' WHEN bytes > 15728640 THEN 'too large (max 15 MB)' WHEN NOT (mime LIKE '%pdf%' OR lower(name) LIKE '%.pdf') THEN 'not a PDF' "
    "WHEN trim(coalesce(text, '')) = '' THEN 'no readable text (scanned PDF?)' END AS reason FROM files f JOIN (SELECT run_id, count(*) AS n FROM files GROUP BY 1) c ON c.run_id = f.run_id"
)
_FILE_CTE = "SELECT " + ", ".join(_FILES) + " FROM documents"


@query("intake_audit", with_ctes("SELECT doc_id, run_id, reason, CASE WHEN reason IS NULL THEN 'OK' WHEN reason LIKE 'no readable%' THEN 'EMPTY' END AS fetch_status FROM audited", files=_FILE_CTE, audited=_INTAKE))
def intake_audit(t: Tables) -> DataFrame:
    return L.intake(t.raw("documents").selectExpr(*_FILES), max_files=12).select("doc_id", "run_id", "reason", "fetch_status")


@query("intake_status", with_ctes("SELECT run_id, count(*) FILTER (reason IS NULL) AS usable, CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 'HARVESTED' ELSE 'ERROR' END AS status FROM audited GROUP BY 1", files=_FILE_CTE, audited=_INTAKE))
def intake_status(t: Tables) -> DataFrame:
    return L.intake_status(L.intake(t.raw("documents").selectExpr(*_FILES), max_files=12))


@query(
    "checklist_flatten",
    "SELECT p_partkey, s AS section_idx, i AS order_idx, 'S' || s AS section_code, 'A' || s || '-' || i AS id, p_name || ' ' || i AS item, CASE WHEN i = 0 THEN 'Ratio' END AS output_format, i = 1 AND p_size > 20 AS is_non_negotiable "
    "FROM part CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0)) v(s, i)",
)
def checklist_flatten(t: Tables) -> DataFrame:
    """A small nested checklist is written as JSON text from each part and read back."""
    one = lambda s, i: (
        f"named_struct('id', 'A{s}-{i}', 'item', p_name || ' {i}', 'output_format', {repr('Ratio') if i == 0 else 'CAST(NULL AS STRING)'}, "
        f"'is_non_negotiable', CASE WHEN {i} = 1 AND p_size > 20 THEN true END)"
    )
    body = F.expr(
        f"to_json(named_struct('title', 't', 'sections', array(named_struct('code', 'S0', 'name', 'n', 'items', array({one(0, 0)}, {one(0, 1)})), "
        f"named_struct('code', 'S1', 'name', 'n', 'items', array({one(1, 0)})))))"
    )
    parsed = t.raw("part").select("p_partkey", F.from_json(body, L.CHECKLIST_TYPE).alias("c")).select("p_partkey", "c.sections")
    return L.flatten_checklist(parsed).select("p_partkey", "section_idx", "order_idx", "section_code", "id", "item", "output_format", "is_non_negotiable")
