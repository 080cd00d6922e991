"""Queries of a run that several instances share: claims, fenced updates, page shards, host limits.

The compare-and-set itself needs a single writer; these give the eligible rows and what follows for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import MAX_ATTEMPTS

TERMINAL = ("COMPLETED", "PERMANENTLY_FAILED")


def page_shards(pages: DataFrame, number: Column, shards: int) -> DataFrame:
    """Adds the shard of each page: pages are numbered from 1 and dealt to shards in turn."""
    return pages.withColumn("shard", F.pmod(number - 1, F.lit(shards)).cast("int"))


def pages(spark: SparkSession, n: int, shards: int) -> DataFrame:
    """The pages 1 to n of a run with their shards."""
    numbers = spark.range(1, n + 1).select(F.col("id").alias("page"))
    return page_shards(numbers, F.col("page"), shards)


def register(runs: DataFrame, wanted: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, keys whose manifest differs from what is registered)."""
    fresh = wanted.join(runs, key, "left_anti")
    both = wanted.alias("w").join(runs.alias("r"), key)
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"w.{f}").eqNullSafe(F.col(f"r.{f}"))
    return fresh, both.filter(differs).select(key)


def claimable(status: Column, attempt: Column, not_before: Column, owner: Column, lease: Column, now: Column, most: int = MAX_ATTEMPTS) -> Column:
    free = owner.isNull() | (lease < now)
    return ~F.upper(status).isin(*TERMINAL) & (attempt < most) & (not_before.isNull() | (not_before <= now)) & free


def fenced(current: DataFrame, updates: DataFrame, key: str, now: Column) -> DataFrame:
    """Updates whose owner and token are those of the row and whose lease still runs."""
    u = updates.alias("u")
    c = current.alias("c")
    live = (F.col("c.owner") == F.col("u.owner")) & (F.col("c.token") == F.col("u.token")) & (F.col("c.lease") >= now)
    return c.join(u, key).filter(live)


def cached_verdicts(docs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """REUSE an approved verdict, DROP a rejected one, else FRESH."""
    hit = cache.select(*keys, F.upper("status").alias("_s"))
    return docs.join(hit, keys, "left").withColumn("decision", F.when(F.col("_s") == "APPROVED", "REUSE").when(F.col("_s") == "REJECTED", "DROP").otherwise("FRESH")).drop("_s")
