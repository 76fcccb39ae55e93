"""Markup as columns: the tokens of a page, its elements by a fold over the tags, texts and attributes of elements.

A page is cut into tokens by one pattern. A fold over the tags holds the stack of open elements and gives every
element the places of its first and last token, so that all lookups are comparisons of places. Elements nest or
stand apart; end tags may be missing or stray, and the fold counts both. Everything is a column expression.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.functions.once import let

#: Comments, scripts and styles are one token each, so nothing inside them is read.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
    r"""|</?[a-z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|<[!?][^>]*>|[^<]+|<"""
)
VOID = ["br", "img", "hr", "input", "meta", "link", "col", "source", "wbr"]
#: Start tag -> open elements that it ends.
CLOSES = {"li": ["li"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "p": ["p"]}
#: Elements whose end tag may be left out.
OPTIONAL_END = ["li", "tr", "td", "th", "p", "tbody", "thead", "body", "html", "option", "dd", "dt"]
#: Closed elements are gathered in pieces of this size, so that no step copies all of them.
PIECE = 512

_SPANS = "array<struct<start:int,end:int>>"
_STATE = f"struct<tags:array<string>,starts:array<int>,part:{_SPANS},done:array<{_SPANS}>,stray:int,open_ends:int>"
_ZERO = f"cast(named_struct('tags', array(), 'starts', array(), 'part', array(), 'done', array(), 'stray', 0, 'open_ends', 0) as {_STATE})"
_NAMES = " ".join(name2codepoint)
_CHARS = "\n".join(map(chr, name2codepoint.values()))


def unescape(text: Column) -> Column:
    """Character references as characters, each read once. Unknown ones stay as they are."""
    named = F.map_from_arrays(F.split(F.lit(_NAMES), " "), F.split(F.lit(_CHARS), "\n"))

    def character(piece: Column) -> Column:
        body = F.regexp_replace(F.substring(piece, 2, 40), ";$", "")
        code = F.when(body.rlike("^#[0-9]{1,7}$"), F.substring(body, 2, 7).cast("int")).when(
            body.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(body, 3, 6), 16, 10).cast("int")
        )
        numbered = let(
            code,
            lambda n: F.when(
                (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            ),
        )
        return F.when(piece.startswith("&"), F.coalesce(F.try_element_at(named, body), numbered, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"&#?[0-9a-zA-Z]{1,31};|[^&]+|&"), 0)
    return F.array_join(F.transform(pieces, character), "")


def attribute(token: Column, name: str) -> Column:
    """The value of an attribute of a start tag, empty if it has none."""
    raw = F.regexp_extract(token, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return unescape(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def _tags(tokens: Column) -> Column:
    """Tags with their places; text, comments, scripts and styles left out."""

    def tag(token: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))
        return let(
            name,
            lambda n: F.struct(
                i.alias("i"), n.alias("tag"), token.startswith("</").alias("closes"),
                (token.endswith("/>") | n.isin(VOID)).alias("empty"),
                F.coalesce(
                    *[F.when((n == t) & ~token.startswith("</"), F.array(*map(F.lit, ends))) for t, ends in CLOSES.items()],
                    F.expr("cast(array() as array<string>)"),
                ).alias("ends"),
            ),
        )

    return F.filter(F.transform(tokens, tag), lambda x: (x["tag"] != "") & ~x["tag"].isin("script", "style"))


def _step(s: Column, x: Column) -> Column:
    """One tag: elements it ends leave the stack, an element it begins goes on top."""
    top_stays = F.array_position(F.transform(s["tags"], lambda t: F.array_contains(x["ends"], t)), F.lit(False))
    leave = (
        F.when(x["closes"], F.array_position(s["tags"], x["tag"]))
        .when(F.size(x["ends"]) == 0, F.lit(0))
        .when(top_stays == 0, F.size(s["tags"]))
        .otherwise(top_stays - 1)
        .cast("int")
    )
    begins = ~x["closes"] & ~x["empty"]

    def after(n: Column) -> Column:
        rest = lambda a: F.slice(a, n + 1, F.size(s["tags"]))
        ended = F.transform(F.slice(s["starts"], F.lit(1), n), lambda a: F.struct(a.alias("start"), x["i"].alias("end")))
        alone = F.array(F.struct(x["i"].alias("start"), x["i"].alias("end")))
        part = F.concat(s["part"], ended, F.when(~x["closes"] & x["empty"], alone).otherwise(F.expr(f"cast(array() as {_SPANS})")))
        left = F.filter(F.slice(s["tags"], F.lit(1), F.greatest(n - 1, F.lit(0))), lambda t: ~t.isin(OPTIONAL_END))
        full = F.size(s["part"]) >= PIECE
        return F.struct(
            F.when(begins, F.concat(F.array(x["tag"]), rest(s["tags"]))).otherwise(rest(s["tags"])).alias("tags"),
            F.when(begins, F.concat(F.array(x["i"]), rest(s["starts"]))).otherwise(rest(s["starts"])).alias("starts"),
            F.when(full, F.slice(part, F.lit(PIECE + 1), F.size(part))).otherwise(part).alias("part"),
            F.when(full, F.concat(s["done"], F.array(F.slice(part, 1, PIECE)))).otherwise(s["done"]).alias("done"),
            (s["stray"] + F.when(x["closes"] & (n == 0), 1).otherwise(0)).alias("stray"),
            (s["open_ends"] + F.when(x["closes"], F.size(left)).otherwise(0)).alias("open_ends"),
        )

    return let(leave, after)


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `tokens`, `elements` (first and last token, tag, id, classes; in page order) and `markup_error`.

    A page that is null or empty has no elements. `markup_error` is null for sound pages, else it counts end
    tags without a start and elements without an end. The stack is copied at each tag, so a page costs its tags
    times its depth; closed elements are copied in pieces.
    """
    cut = pages.withColumn("tokens", F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TOKEN), 0))
    folded = cut.withColumn("_tags", _tags(F.col("tokens"))).withColumn("_fold", F.aggregate("_tags", F.expr(_ZERO), _step))
    f = F.col("_fold")
    last = F.size("tokens").cast("int")
    unended = F.transform(f["starts"], lambda a: F.struct(a.alias("start"), last.alias("end")))
    spans = F.sort_array(F.concat(F.flatten(f["done"]), f["part"], unended))

    def element(e: Column) -> Column:
        token = F.get(F.col("tokens"), e["start"])
        classes = F.concat(F.lit(" "), F.trim(F.regexp_replace(attribute(token, "class"), r"\s+", " ")), F.lit(" "))
        return F.struct(
            e["start"].alias("start"), e["end"].alias("end"),
            F.lower(F.regexp_extract(token, r"^<([a-zA-Z][^\s/>]*)", 1)).alias("tag"),
            attribute(token, "id").alias("id"), classes.alias("classes"),
        )

    open_ends = f["open_ends"] + F.size(F.filter(f["tags"], lambda t: ~t.isin(OPTIONAL_END)))
    error = F.when(
        (f["stray"] > 0) | (open_ends > 0),
        F.concat(f["stray"].cast("string"), F.lit(" end tags without a start, "), open_ends.cast("string"), F.lit(" elements without an end")),
    )
    return (
        folded.withColumns({"elements": F.transform(spans, element), "markup_error": error})
        .drop("_tags", "_fold")
    )


def has_class(e: Column, name: str) -> Column:
    return F.contains(e["classes"], F.lit(f" {name} "))


def holds(outer: Column, inner: Column) -> Column:
    """Whether an element lies inside another one."""
    return (inner["start"] > outer["start"]) & (inner["start"] < outer["end"])


def inside(elements: Column, outer: Column) -> Column:
    """The elements below one element, in page order; null if there is no such element."""
    return let(outer, lambda o: F.when(o.isNotNull(), F.filter(elements, lambda e: holds(o, e))))


def of_tag(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))


def nearest_above(elements: Column, inner: Column) -> Column:
    """The innermost of some elements around one element."""
    return F.try_element_at(F.filter(elements, lambda e: holds(e, inner)), F.lit(-1))


def text_of(tokens: Column, e: Column) -> Column:
    """The text of an element, references read, one space for every run of white space."""
    between = F.slice(tokens, e["start"] + 2, F.greatest(e["end"] - e["start"] - 1, F.lit(0)))
    words = F.filter(between, lambda t: ~t.startswith("<") | (t == "<"))
    joined = unescape(F.array_join(words, ""))
    return F.trim(F.regexp_replace(joined, r"(?U)[\s\x1c-\x1f]+", " "))
