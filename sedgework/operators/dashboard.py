"""Worker rows of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(rows: DataFrame, worker: str, state: str, active: int) -> DataFrame:
    """Rows brought to the queue's number of active workers: surplus ones IDLE, missing ones STARTING.

    There is a row for each worker of one run, so ranks over all of them stay small.
    """
    busy = F.col(state) != "IDLE"
    rn = F.row_number().over(Window.partitionBy(busy).orderBy(worker))
    n = F.count_if(busy).over(Window.partitionBy(F.lit(1)))
    ranked = rows.withColumn("_rn", rn).withColumn("_n", n)
    new = F.when(busy & (F.col("_rn") > active), "IDLE").when(~busy & (F.col("_rn") <= F.greatest(F.lit(0), active - F.col("_n"))), "STARTING").otherwise(F.col(state))
    return ranked.select(worker, new.alias(state))


def fill_workers(rows: DataFrame, worker: str, state: str, most: int) -> DataFrame:
    """All workers 1 .. ``most``, IDLE where nothing is known."""
    every = rows.sparkSession.range(1, most + 1).select(F.col("id").alias(worker))
    return every.join(rows, worker, "left").select(worker, F.coalesce(state, F.lit("IDLE")).alias(state))
