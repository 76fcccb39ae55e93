"""Text cleaning, markup, names, hosts, links and keyword hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone import fixed
from flagstone.functions.once import let


def clean_text(text: Column, limit: int | None = None) -> Column:
    """One space for every run of white space (no-break spaces too), trimmed, cut to `limit`."""
    out = F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))
    return F.substring(out, 1, limit) if limit else out


def strip_nul(df: DataFrame) -> DataFrame:
    """Drop NUL characters from every string of every column, nested ones too."""
    return df.select(*[_without_nul(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def _without_nul(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.translate(col, "\u0000", "")
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _without_nul(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _k, v: _without_nul(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(*[_without_nul(col[f.name], f.dataType).alias(f.name) for f in dtype])
        return F.when(col.isNotNull(), rebuilt)
    return col


def clean_markup(text: Column) -> Column:
    """Answer prose without citations and tags, entities restored, blank lines collapsed."""
    out = F.regexp_replace(text, r"(?is)<doc_source>.*?</doc_source>", "")
    out = F.regexp_replace(out, r"(?is)<docsource>.*?</docsource>", "")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, plain in [
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"'), ("&nbsp;", " "),
    ]:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def answer_of(body: Column) -> Column:
    """The marked answer parts of a response body joined by a blank line, cleaned; else JSON fields."""
    parts = F.regexp_extract_all(body, F.lit(r"(?is)<ans>(.*?)</ans>"), 1)
    field = F.coalesce(
        *[F.get_json_object(body, f"$.{k}") for k in ("response", "answer", "text", "content", "message")]
    )
    return F.when(F.size(parts) > 0, clean_markup(F.array_join(parts, "\n\n"))).otherwise(
        F.coalesce(clean_markup(field), F.lit(""))
    )


def extract_urls(text: Column) -> Column:
    """Distinct links in order of appearance, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(fixed.SOURCE_URL), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:]+$", "")))


def normalise_phrase(text: Column) -> Column:
    """Lower case, words of letters and digits parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def name_core(name: Column) -> Column:
    """A company name without its corporate form words."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), fixed.CORPORATE_FORMS, " ")
    out = F.regexp_replace(out, r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def name_tokens(name: Column, ticker: Column) -> Column:
    """Words that tell a company apart: four letters or more, not generic, and its ticker."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in fixed.NAME_STOPWORDS])
    telling = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    symbol = F.lower(F.coalesce(ticker, F.lit("")))
    extra = F.when(F.length(symbol) >= 2, F.array(symbol)).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    return F.array_distinct(F.concat(telling, extra))


def hit_relevant(hit_text: Column, name: Column, ticker: Column) -> Column:
    """Unlisted: the whole name as a phrase. Listed: any telling word. No word to go by: keep."""
    hay = normalise_phrase(hit_text)
    full = normalise_phrase(F.coalesce(name, F.lit("")))
    tokens = name_tokens(name, ticker)
    unlisted = F.coalesce(ticker, F.lit("")) == ""
    any_token = (F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(hay, t))
    return F.when(unlisted & (full != ""), F.contains(hay, full)).otherwise(any_token)


def foreign_subject(answer: Column, target: Column) -> Column:
    """True when an answer names another company and never the target."""
    core = name_core(target)
    low = F.lower(F.coalesce(answer, F.lit("")))
    squeezed = F.regexp_replace(low, r"[^a-z0-9]+", "")
    run_together = F.replace(core, F.lit(" "))
    words = F.filter(F.split(core, " "), lambda t: F.length(t) >= 5)
    spoken = F.concat(F.lit(" "), F.regexp_replace(low, r"[^a-z0-9_]+", " "), F.lit(" "))
    named = ((F.length(run_together) >= 4) & F.contains(squeezed, run_together)) | F.exists(
        words, lambda t: F.contains(spoken, F.concat(F.lit(" "), t, F.lit(" ")))
    )
    others = F.transform(
        F.regexp_extract_all(answer, F.lit(fixed.COMPANY_MENTION), 1), lambda n: name_core(n)
    )
    return F.when((core == "") | (F.coalesce(answer, F.lit("")) == ""), F.lit(False)).otherwise(
        ~named & F.exists(others, lambda n: ~_related(n, core))
    )


def _related(a: Column, b: Column) -> Column:
    long_words = lambda s: F.filter(F.split(s, " "), lambda t: F.length(t) >= 3)
    shared = F.exists(
        long_words(a),
        lambda x: F.exists(long_words(b), lambda y: F.contains(x, y) | F.contains(y, x)),
    )
    ac, bc = F.replace(a, F.lit(" ")), F.replace(b, F.lit(" "))
    joined = (F.length(ac) >= 4) & (F.length(bc) >= 4) & (F.contains(ac, bc) | F.contains(bc, ac))
    return shared | joined


def url_host(url: Column) -> Column:
    """Lower-case host; the whole text when it is no URL."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host == "", F.lower(url)).otherwise(host)


def host_in(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one."""
    host = url_host(url)
    out = host.isin(*domains)
    for d in domains:
        out = out | host.endswith("." + d)
    return out


def keywords_from(text: Column, hint: Column, most: int = 8) -> Column:
    """The first distinct words of more than three letters, in order."""
    base = F.lower(F.concat(text, F.lit(" "), F.coalesce(hint, F.lit(""))))
    words = F.filter(F.split(base, r"[^a-z0-9]+"), lambda w: F.length(w) > 3)
    return F.slice(F.array_distinct(words), 1, most)


def excerpt(text: Column, terms: Column, radius: int = fixed.PASSAGE_RADIUS) -> Column:
    """Text around the earliest term, with ellipses where it was cut."""
    places = let(
        F.lower(text), lambda low: F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0)
    )

    def around(at: Column) -> Column:
        start = F.greatest(at - 1 - radius, F.lit(0))
        end = F.least(at - 1 + radius, F.length(text))
        return F.when(at.isNull(), trim_all(F.substring(text, 1, radius * 2))).otherwise(
            F.concat(
                F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
                trim_all(F.substring(text, start + 1, end - start)),
                F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")),
            )
        )

    return let(F.array_min(places), around)


def trim_all(text: Column) -> Column:
    """White space of any kind removed from both ends."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def clean_name(raw: Column) -> Column:
    """A person's name without an honorific; null when it is not at least two words."""
    name = trim_all(F.regexp_replace(F.coalesce(raw, F.lit("")), fixed.HONORIFIC, ""))
    return F.when((F.length(name) >= 4) & name.rlike(r"\s"), name)


def search_query(name: Column, ticker: Column, topic: Column) -> Column:
    """A topic anchored to one company: name, country unless the name tells it, ticker."""
    full, symbol = trim_all(F.coalesce(name, F.lit(""))), trim_all(F.coalesce(ticker, F.lit("")))
    who = F.when(full != "", full).otherwise(symbol)
    anchor = F.concat_ws(
        " ",
        who,
        F.when(~who.rlike(fixed.COUNTRY_QUALIFIED), F.lit("India")),
        F.when(
            (symbol != "") & (F.lower(symbol) != F.lower(who)),
            F.concat(F.lit("(NSE: "), symbol, F.lit(")")),
        ),
    )
    return F.when(who == "", F.trim(topic)).otherwise(
        F.trim(F.concat_ws(" ", anchor, F.when(topic != "", topic)))
    )


def json_part(text: Column) -> Column:
    """The JSON value inside prose or a fenced block."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = trim_all(F.when(text.rlike(r"(?s)```.*?```"), fenced).otherwise(text))
    found = F.regexp_extract(body, r"(?s)[{\[].*[}\]]", 0)
    return F.when(found == "", body).otherwise(found)


def absolute_url(href: Column, base: Column) -> Column:
    """A link resolved against the page it stands on."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(
        F.regexp_extract(page, r"^(.*/)", 1)
    )
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
