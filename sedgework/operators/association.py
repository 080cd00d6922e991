"""Association of documents with the rows of a result page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def associate(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (doc), rows (row_id, link) -> (doc, mirrors): the links of the one row that holds the document's link.

    A document in no row or in several keeps only its own link.
    """
    hits = rows.join(docs, F.col("link") == F.col("doc"), "left_semi").groupBy(F.col("link").alias("doc")).agg(F.min("row_id").alias("row_id"), F.max("row_id").alias("_last"))
    one = hits.filter(F.col("row_id") == F.col("_last")).select("doc", "row_id")
    links = rows.join(one.select("row_id").distinct(), "row_id", "left_semi").groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("link").cast("string"))), ",").alias("mirrors"))
    found = one.join(links, "row_id").select("doc", "mirrors")
    return docs.join(found, "doc", "left").select("doc", F.coalesce("mirrors", F.col("doc").cast("string")).alias("mirrors"))
