"""Landed pages and documents to document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.operators import research as RS
from flagstone.operators import retrieve as RT
from flagstone.sources import pages as PG


def document_plan(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """What to fetch for each company: its page's links, ranked, capped, against what is stored."""
    links = PG.page_links(PG.structure_pages(pages.filter(PG.looks_like_company_page(F.col("html")))))
    capped = RS.cap_per_group(links, ["company_id"], [F.asc("rank"), F.asc("pos"), F.asc("link")])
    wanted = capped.select(F.col("company_id").alias("run_id"), F.col("link").alias("url"), "category", "doc_type", "label")
    return RT.plan_refetch(wanted, documents)


def land_documents(documents: DataFrame) -> DataFrame:
    """Fetched documents with copies inside a run reduced to a note."""
    return RT.dedup_by_hash(documents)
