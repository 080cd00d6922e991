"""Batches of documents and the ids that a response approves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_batches(docs: DataFrame, batch: str, item: str) -> DataFrame:
    """Batches whose ids are there and unique."""
    return docs.groupBy(batch).agg((F.count("*") == F.count_distinct(item)).alias("valid"))


def approved_items(docs: DataFrame, responses: DataFrame, batch: str, item: str, raw: str) -> DataFrame:
    """Documents whose ids their batch's response lists; input order is that of ``item``.

    A response must be a JSON array of integers, all of them in the batch; else its batch gives
    nothing.  Repeated ids count once.
    """
    strict = F.col(raw).rlike(r"^\s*\[\s*(-?[0-9]+\s*(,\s*-?[0-9]+\s*)*)?\]\s*$")
    ids = responses.filter(strict).select(batch, F.explode(F.from_json(raw, "array<bigint>")).alias("_id")).distinct()
    known = docs.select(batch, F.col(item).alias("_id"), F.lit(True).alias("_known"))
    checked = ids.join(known, [batch, "_id"], "left")
    broken = checked.filter(F.col("_known").isNull()).select(batch).distinct()
    good = checked.join(broken, batch, "left_anti").select(batch, F.col("_id").alias(item))
    return docs.join(good, [batch, item], "left_semi")


def batch_errors(docs: DataFrame, responses: DataFrame, batch: str, item: str, raw: str) -> DataFrame:
    """Batches whose response breaks the rules above."""
    strict = F.coalesce(F.col(raw).rlike(r"^\s*\[\s*(-?[0-9]+\s*(,\s*-?[0-9]+\s*)*)?\]\s*$"), F.lit(False))
    malformed = responses.filter(~strict).select(batch)
    ids = responses.filter(strict).select(batch, F.explode(F.from_json(raw, "array<bigint>")).alias(item))
    unknown = ids.join(docs.select(batch, item), [batch, item], "left_anti").select(batch)
    return malformed.unionByName(unknown).distinct()
