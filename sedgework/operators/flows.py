"""Whole runs as one declared plan: from stored result pages to queue decisions, and from files to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_document_rows
from ..functions.text import safe_filename, usable_page
from ..functions.urls import document_identity
from .dedup import content_duplicates, inherited
from .rows import top_per_key


def queue_decisions(pages: DataFrame, relevant: Column, evaluated: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored result pages (page, url, html) to decisions for each document.

    ``relevant`` is a predicate over title and text; ``evaluated`` and ``stored`` hold document_id of what
    was judged or fetched before.  Repeated documents are decided by their first row.
    """
    rows = extract_document_rows(pages.filter(usable_page(F.col("html"))).withColumnRenamed("url", "base_url"), ["page"])
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("document_id", document_identity(F.col("link"), none, F.col("title"))).withColumn("item", F.col("row_no") + 1)
    fresh = rows.join(evaluated.select("document_id").distinct(), "document_id", "left_anti")
    first = top_per_key(fresh, ["document_id"], ["page", "item"])
    known = stored.select("document_id", F.lit(True).alias("_stored")).distinct()
    decision = F.when(~relevant, "STAGE1_REJECTED").when(F.col("_stored"), "STORED").otherwise("QUEUE")
    return first.join(known, "document_id", "left").select("page", "item", "document_id", "title", "link", safe_filename(F.col("title"), F.col("page").cast("int"), F.col("item")).alias("filename"), decision.alias("decision"))


def validation_summary(docs: DataFrame, verdicts: DataFrame, scope: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of verdicts by ``scope`` after duplicates took over those of their canonical documents."""
    judged = inherited(content_duplicates(docs, id_col, text_col), verdicts, id_col)
    n = lambda s: F.count_if(F.col("status") == s)
    rows = judged.join(docs.select(id_col, scope), id_col)
    return rows.groupBy(scope).agg(F.count("*").alias("found"), n("APPROVED").alias("approved"), n("REJECTED").alias("rejected"), n("PENDING").alias("pending"), n("DUPLICATE_PENDING").alias("duplicates_waiting"))
