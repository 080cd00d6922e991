"""Running values along each key's order in two levels, so that the events of one key may be spread over tasks.

Events of hot keys are cut into buckets of consecutive events.  Within a bucket a running value is a window, as it is for
a whole key that isn't hot; each bucket also gives one summary row, and the summaries of the buckets before make what
a bucket carries in.  A key is hot when it holds more than one in SHARE of all events (and more than LEAST), so there
are fewer than SHARE hot keys; they are found, and their buckets' bounds drawn, by a small job when a scan is built.
Events of one key and one instant stay in one bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Buckets that all events would make, and events of a key that are never cut.
SHARE, LEAST = 200, 100_000
BUCKET = "_bucket"


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which nulls are equal."""
    return reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys])


def instant(df: DataFrame, column: str) -> Column:
    """An order column as a whole number that never falls along the order."""
    kind = df.schema[column].dataType.typeName()
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.floor(column).cast("long")


def bucketed(df: DataFrame, key: list[str], at: str) -> tuple[DataFrame, bool]:
    """``df`` with the bucket of each event, from 0, and whether there are hot keys: without any, nothing is carried on.

    All events of a key that isn't hot are in bucket 0.
    """
    spark, time = df.sparkSession, instant(df, at)
    total = df.agg(F.count("*").alias("_total"))
    hot = df.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > LEAST).crossJoin(F.broadcast(total)).filter(F.col("_n") * SHARE > F.col("_total"))
    found = hot.collect()
    if not found:
        return df.withColumn(BUCKET, F.lit(0)), False
    keys = StructType([df.schema[k] for k in key])
    named = spark.createDataFrame([tuple(r[k] for k in key) for r in found], keys)
    cuts = [(i + 1) / SHARE for i in range(SHARE - 1)]
    drawn = df.join(F.broadcast(named), same(df, named, key), "left_semi").groupBy(*key).agg(F.percentile_approx(time, cuts, 10_000).alias("_cuts")).collect()
    parts = {tuple(r[k] for k in key): -(-r["_n"] * SHARE // r["_total"]) for r in found}
    rows = []
    for r in drawn:
        k = tuple(r[x] for x in key)
        bounds = sorted({r["_cuts"][i * (SHARE - 1) // parts[k]] for i in range(1, parts[k])})
        rows.append((*k, bounds))
    cut = spark.createDataFrame(rows, StructType([*keys.fields, StructField("_cuts", ArrayType(LongType()))]))
    out = df.join(F.broadcast(cut), same(df, cut, key), "left").select(df["*"], cut["_cuts"])
    inside = F.size(F.filter("_cuts", lambda c: c < time))
    return out.withColumn(BUCKET, F.when(F.col("_cuts").isNull(), 0).otherwise(inside)).drop("_cuts"), True


def within(key: list[str], order: list[str]):
    """The window of a bucket, up to the event itself."""
    return Window.partitionBy(*key, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(key: list[str]):
    """Over summaries: the buckets before."""
    return Window.partitionBy(*key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def after(key: list[str]):
    """Over summaries: the buckets after, the next one last."""
    return Window.partitionBy(*key).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)


def carried(rows: DataFrame, carry: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with what their bucket carries in."""
    return rows.join(carry, same(rows, carry, [*key, BUCKET]), "left").select(rows["*"], *[carry[c] for c in columns])
