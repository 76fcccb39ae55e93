"""Checklist files, uploads and written reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone import fixed
from flagstone.functions.text import trim_all

CHECKLIST_TYPE = (
    "title string, sections array<struct<code:string,name:string,items:array<struct<id:string,item:string,description:string,"
    "output_format:string,green_flag:string,red_flag:string,source_hint:string,is_non_negotiable:boolean,threshold_logic:string>>>>"
)


def flatten_checklist(files: DataFrame) -> DataFrame:
    """Nested sections to items with the positions of both."""
    keep = [c for c in files.columns if c not in ("title", "sections")]
    sections = files.select(*keep, F.posexplode("sections").alias("section_idx", "s"))
    items = sections.select(
        *keep, "section_idx", F.col("s.code").alias("section_code"), F.col("s.name").alias("section_name"),
        F.posexplode("s.items").alias("order_idx", "i"),
    )
    return items.select(*keep, "section_idx", "section_code", "section_name", "order_idx", "i.*").withColumn(
        "is_non_negotiable", F.coalesce("is_non_negotiable", F.lit(False))
    )


def load_checklist(spark: SparkSession, path: str) -> DataFrame:
    """Items of a checklist file."""
    return flatten_checklist(spark.read.schema(CHECKLIST_TYPE).json(path, multiLine=True))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of landed files, their content unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "modificationTime")


def intake(files: DataFrame, max_files: int = fixed.MAX_UPLOADS, max_bytes: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """Why an upload is refused or kept. Needs run_id, name, bytes, mime and text.

    Too many files refuse the whole upload. The count per run is combined before the shuffle and
    joined back, so one run with very many files does not sit in one task.
    """
    counts = files.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"))
    pdf = F.contains(F.lower(F.coalesce("mime", F.lit(""))), F.lit("pdf")) | F.lower("name").endswith(".pdf")
    return files.join(counts, "run_id").withColumn(
        "reason",
        F.when(F.col("files") > max_files, f"at most {max_files} files")
        .when(F.col("bytes") > max_bytes, "too large (max 15 MB)")
        .when(~pdf, "not a PDF")
        .when(F.coalesce(trim_all(F.col("text")), F.lit("")) == "", "no readable text (scanned PDF?)"),
    ).withColumn("fetch_status", F.when(F.col("reason").isNull(), "OK").when(F.col("reason").startswith("no readable"), "EMPTY"))


def intake_status(audited: DataFrame) -> DataFrame:
    """Runs with a usable file are HARVESTED, the others are in ERROR."""
    usable = F.count_if(F.col("fetch_status") == "OK")
    return audited.groupBy("run_id").agg(usable.alias("usable")).withColumn(
        "status", F.when(F.col("usable") > 0, "HARVESTED").otherwise("ERROR")
    )


def write_report(nested: DataFrame, path: str) -> None:
    """Machine-readable report, one JSON object per run."""
    nested.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """An export table as parquet or csv, split by a low-cardinality column when one is named."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
