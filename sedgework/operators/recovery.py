"""Recovery of transfers: who is tried again, in what order, and with which attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import MAX_ATTEMPTS, SAME_ATTEMPT
from .rows import top_per_key


def round_jobs(rows: DataFrame, key: str, seq: str, attempt: str, most: int = MAX_ATTEMPTS) -> DataFrame:
    """First row of each key; attempts out of range fail for good."""
    status = F.when(F.col(attempt).between(1, most), "QUEUED").otherwise("PERMANENTLY_FAILED")
    return top_per_key(rows, [key], [seq]).withColumn("status", status)


def order_jobs(orders: DataFrame) -> DataFrame:
    """Orders read as ledger entries: status, bytes of the partial file, time of the last update, attempt."""
    status = F.when(F.col("o_orderstatus") == "F", "FAILED_FOR_ROUND").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("PARTIAL")
    part = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.floor("o_totalprice")).cast("long")
    return orders.select("o_orderkey", status.alias("status"), part.alias("part"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated"), (F.col("o_custkey") % 6 + 1).cast("int").alias("attempt"))


def next_attempt(status: Column, attempt: Column) -> Column:
    return attempt + F.when(status.isin(*SAME_ATTEMPT), 0).otherwise(1)


def recovery_plan(jobs: DataFrame, limit: int, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs to try again: those with a partial file first, larger and newer ones before; none for a limit of 0."""
    rows = jobs.withColumn("next_attempt", next_attempt(F.col("status"), F.col("attempt"))).filter(F.col("next_attempt") <= most)
    return rows.orderBy(F.when(F.col("part") > 0, 0).otherwise(1), F.desc("part"), F.desc("updated"), "o_orderkey").limit(max(0, limit))


def exhausted(jobs: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    return jobs.filter(next_attempt(F.col("status"), F.col("attempt")) > most).withColumn("status", F.lit("PERMANENTLY_FAILED"))


def rotate(routes: Column, by: Column) -> Column:
    k = F.pmod(by, F.size(routes)).cast("int")
    return F.concat(F.slice(routes, k + 1, F.size(routes)), F.slice(routes, F.lit(1), k))


def pick(routes: Column, attempt: Column) -> Column:
    return F.element_at(routes, (F.pmod(attempt - 1, F.size(routes)) + 1).cast("int"))


def backlog(jobs: DataFrame, key: str, attempt: str, keep: str = "highest") -> DataFrame:
    """One row of each key: the highest attempt after failures, the lowest after a restart; the latest deadline."""
    choose = F.max(attempt) if keep == "highest" else F.min(attempt)
    return jobs.groupBy(key).agg(choose.alias(attempt), F.max("not_before").alias("not_before"))
