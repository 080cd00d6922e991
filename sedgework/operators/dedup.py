"""Content dedup and the verdicts that duplicates take over."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import TERMINAL_VALIDATION
from ..sources.files import work_folder


#: A text that more than one row in so many repeats is hot: there are fewer hot ones than this.
HOT = 1000


def content_duplicates(docs: DataFrame, id_col: str, text_col: str, scope: str | None = None) -> DataFrame:
    """(id, scope, sha, canonical_id, is_duplicate): the earliest row with the same content, within ``scope``.

    Texts are hashed once, and ids and hashes written; the rest reads those.  Only hashes that are repeated are joined
    back: hot ones, of which there are fewer than HOT, by broadcast and so without bringing their rows together, others
    by hash.  A null scope is a scope of its own; a null text has no content and is nobody's duplicate.
    """
    keys = ([scope] if scope else []) + ["sha"]
    rows = docs.select(id_col, *([scope] if scope else []), F.sha2(F.col(text_col).cast("binary"), 256).alias("sha"))
    folder = work_folder(docs.sparkSession, "content")
    rows.write.parquet(folder)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(folder)
    groups = rows.filter(F.col("sha").isNotNull()).groupBy(*keys).agg(F.min(id_col).alias("_canon"), F.count("*").alias("_n")).filter("_n > 1")
    total = rows.agg(F.count("*").alias("_total"))
    split = groups.crossJoin(F.broadcast(total)).withColumn("_hot", F.col("_n") * HOT > F.col("_total"))
    same = lambda a, b: reduce(and_, [a[k].eqNullSafe(b[k]) for k in keys])
    hot, cold = split.filter("_hot").select(*keys, "_canon"), split.filter("not _hot").select(*keys, "_canon")
    marked = rows.join(F.broadcast(hot), same(rows, hot), "left").select(rows["*"], "_canon")
    rest = marked.filter("_canon is null").drop("_canon")
    rest = rest.join(cold, same(rest, cold), "left").select(rest["*"], "_canon")
    out = marked.filter("_canon is not null").unionByName(rest)
    return out.withColumn("canonical_id", F.coalesce("_canon", id_col)).drop("_canon").withColumn("is_duplicate", F.col("canonical_id") != F.col(id_col))


def label_status(labels: DataFrame) -> DataFrame:
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "APPROVED").when(F.col("quality") == 0, "REJECTED").otherwise("PENDING")
    return labels.select("doc_id", status.alias("status"))


def inherited(dups: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    """Own verdict of canonical rows; duplicates take a terminal one over, else wait for it."""
    own = verdicts.select(F.col(id_col), F.col("status").alias("_own"))
    canon = verdicts.select(F.col(id_col).alias("canonical_id"), F.col("status").alias("_canon"))
    rows = dups.select(id_col, "canonical_id", "is_duplicate").join(own, id_col, "left").join(canon, "canonical_id", "left")
    status = F.when(~F.col("is_duplicate"), F.coalesce("_own", F.lit("PENDING"))).when(F.col("_canon").isin(*TERMINAL_VALIDATION), F.col("_canon")).otherwise("DUPLICATE_PENDING")
    return rows.select(id_col, "canonical_id", status.alias("status"))


def propagated(dups: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    """Duplicates whose canonical row has a terminal verdict, with that verdict."""
    done = verdicts.filter(F.col("status").isin(*TERMINAL_VALIDATION)).select(F.col(id_col).alias("canonical_id"), "status")
    return dups.filter("is_duplicate").select(id_col, "canonical_id").join(done, "canonical_id").select(id_col, "status")


def unique_match(rows: DataFrame, library: DataFrame, title: str, path: str, out: str) -> DataFrame:
    """``rows`` with the one library path of their title; null without any, with several, or where files of other
    folders have the same name."""
    only = lambda key: library.groupBy(key).agg(F.min(path).alias(out), F.max(path).alias("_max")).filter(F.col(out) == F.col("_max")).drop("_max")
    library = library.withColumn("_name", F.regexp_extract(F.col(path).cast("string"), "([^/]*)$", 1))
    one = only(title).join(only("_name").select(out), out, "left_semi")
    return rows.join(one, title, "left")
