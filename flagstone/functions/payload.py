"""JSON inside text columns: validation, packed tables, payload shapes, content kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from flagstone import fixed
from flagstone.functions.text import json_part

TABLE_TYPE = "struct<columns:array<string>,rows:array<array<string>>>"
HIT_TYPE = "array<struct<url:string,title:string,description:string,snippet:string>>"


def validate_payload(df: DataFrame, column: str, schema: str | DataType, required: list[str]) -> DataFrame:
    """Adds `parsed` and `valid`: JSON found in the text that carries all required fields."""
    parsed = F.from_json(json_part(F.col(column)), schema)
    ok = F.col("parsed").isNotNull()
    for name in required:
        ok = ok & F.col("parsed")[name].isNotNull()
    return df.withColumn("parsed", parsed).withColumn("valid", ok)


def pack_table(table: Column) -> Column:
    """A breakdown table as text behind the marker."""
    return F.concat(F.lit(fixed.TABLE_MARKER), F.to_json(table))


def unpack_table(text: Column) -> Column:
    """The packed table; null for plain text or a broken table."""
    body = F.substring(text, F.lit(len(fixed.TABLE_MARKER) + 1), F.length(text))
    table = F.from_json(body, TABLE_TYPE)
    whole = table["columns"].isNotNull() & table["rows"].isNotNull()
    return F.when(text.startswith(fixed.TABLE_MARKER) & whole, table)


def plain_quote(text: Column) -> Column:
    """The evidence text unless it is a packed table."""
    return F.when(unpack_table(text).isNull(), text)


def unify_payload(df: DataFrame, column: str) -> DataFrame:
    """Search payloads of three shapes to rows (pos, url, title, snippet); entries without a link go."""
    flat = F.get_json_object(column, "$.data")
    listed = F.coalesce(
        F.when(flat.startswith("["), flat), F.get_json_object(column, "$.data.web"), F.get_json_object(column, "$.web")
    )
    rest = [c for c in df.columns if c != column]
    return (
        df.select(*rest, F.posexplode(F.from_json(listed, HIT_TYPE)).alias("pos", "_h"))
        .filter(F.coalesce(F.col("_h.url"), F.lit("")) != "")
        .select(*rest, "pos", "_h.url", "_h.title", F.coalesce("_h.description", "_h.snippet").alias("snippet"))
    )


def explode_map_rows(df: DataFrame, column: str) -> DataFrame:
    """map<key, [country, name, industry]> to rows; the key stands in for a missing name."""
    rest = [c for c in df.columns if c != column]
    at = lambda i: F.get(F.col("_v"), F.lit(i))
    return df.select(*rest, F.explode(column).alias("ticker", "_v")).select(
        *rest, "ticker", F.coalesce(F.nullif(at(1), F.lit("")), F.col("ticker")).alias("name"),
        at(2).alias("industry"), at(0).alias("country"),
    )


def sniff_type(content: Column, header: Column) -> Column:
    """pdf by its content type or its first bytes, else other."""
    said = F.contains(F.lower(F.coalesce(header, F.lit(""))), F.lit("pdf"))
    starts = F.substring(content, F.lit(1), F.lit(5)).cast("string") == "%PDF-"
    return F.when(said | F.coalesce(starts, F.lit(False)), "pdf").otherwise("other")


def url_candidates(base: str, code: Column) -> Column:
    """Addresses to try for a code: consolidated, then standalone."""
    root = F.concat(F.lit(f"{base}/company/"), F.url_encode(F.upper(F.trim(code))))
    return F.array(F.concat(root, F.lit("/consolidated/")), F.concat(root, F.lit("/")))


def path_candidates(base: str, path: Column) -> Column:
    root = F.concat(F.lit(base), F.regexp_replace(path, "/+$", ""))
    return F.array(F.concat(root, F.lit("/consolidated/")), F.concat(root, F.lit("/")))


def to_engine_item(df: DataFrame) -> DataFrame:
    """Stored item columns under the engine's names, with defaults."""
    return df.select(
        "id", F.col("section_code").alias("sectionCode"), "item", F.coalesce("description", F.lit("")).alias("description"),
        F.col("output_format").alias("outputFormat"), F.col("green_flag").alias("greenFlag"), F.col("red_flag").alias("redFlag"),
        F.col("source_hint").alias("sourceHint"), F.coalesce("is_non_negotiable", F.lit(False)).alias("isNonNegotiable"),
    )
