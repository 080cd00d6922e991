"""Row operators that several plans share: latest per key, bounded lists, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer partitions than there are cores; large inputs stay as they are.

    For work that costs much more for each row than moving the row does.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def top_per_key(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (rank filters are pushed below the shuffle by the planner)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, keys: list[str], seq: list[str], columns: list[str]) -> DataFrame:
    """Last row of each key, by one aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*seq)).alias("_r")).select(*keys, "_r.*")


def last_set(df: DataFrame, keys: list[str], seq: list[str], columns: list[str]) -> DataFrame:
    """Field-wise merge: of each column the last value that isn't null."""
    order = F.struct(*seq)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def bounded_with_rest(df: DataFrame, order: list, label: str, n: int) -> DataFrame:
    """The first ``n`` labels and, if there are more, a row that tells how many."""
    head = df.orderBy(*order).limit(n).select(F.col(label).cast("string").alias("entry"))
    rest = df.agg((F.count("*") - n).alias("more")).filter("more > 0").select(F.concat(F.lit("... "), F.col("more").cast("string"), F.lit(" more")).alias("entry"))
    return head.unionByName(rest)


def zero_filled(df: DataFrame, key: Column, known: list[str]) -> DataFrame:
    """Counts by key for all known keys, 0 where there is none."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, known))).alias("key"))
    counts = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    return names.join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
