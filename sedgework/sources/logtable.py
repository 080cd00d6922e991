"""A keyed table kept as a log of commits: appended, merged on read, compacted by key range.

A commit writes its rows to a new folder below ``rows/`` and then adds one row to ``commits/``; only folders that a
commit names are read, so a job that fails in between leaves nothing visible.  Rows are merged by a function that may
be applied to any grouping of them (see ``operators.ledger``); a commit's own rows are merged before they are written,
so a key that a batch changes a million times is one row of it.  A batch that names its writer and number is
committed once: replayed, it changes nothing.  Versions count commits, and each of them can be read.

Compaction writes the merged rows of a key range, sorted by key, and hides that range in the commits before it.  Other
ranges keep their rows, and files sorted by key let a point lookup skip most of them.  Nothing is deleted.

One writer is expected at a time.  Writers that meet may get the same version; appends lose nothing by that, as
merging doesn't depend on the order of commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, kind string, folder string, writer string, batch long, low string, high string"


def written(value: Column, seq: Column, when: Column | None = None) -> Column:
    """A written field: its value and the place in the order of changes; null where it isn't written.

    Fields are written where the value isn't null, or where ``when`` holds, a null value included.
    """
    return F.when(value.isNotNull() if when is None else F.coalesce(when, F.lit(False)), F.struct(seq.alias("seq"), value.alias("value")))


def last(field: str) -> Column:
    """Merge rule: the value that was written last."""
    return F.max_by(field, F.col(field)["seq"]).alias(field)


def first(field: str) -> Column:
    """Merge rule: the value that was written first."""
    return F.min_by(field, F.col(field)["seq"]).alias(field)


def merged_maps(rows: DataFrame, key: list[str], field: str) -> DataFrame:
    """Merge rule of a field that maps names to written values: the last one of each name.  -> key and the map."""
    entries = rows.select(*key, F.explode(field).alias("_name", "_written"))
    latest = entries.groupBy(*key, "_name").agg(F.max_by("_written", F.col("_written")["seq"]).alias("_written"))
    return latest.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_written"))).alias(field))


class LogTable:
    """Rows of ``schema`` below ``folder``, merged by ``merge`` (DataFrame -> DataFrame of the same columns)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.key, self.schema, self.merge = spark, folder.rstrip("/"), key, schema, merge
        self.columns = spark.createDataFrame([], schema).columns

    def commits(self) -> list:
        """A row for each commit, in order; before the first one there is no folder to read."""
        try:
            found = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = []
        return sorted(found, key=lambda c: (c.version, c.folder))

    def version(self) -> int:
        return max((c.version for c in self.commits()), default=0)

    def _commit(self, kind: str, rows: DataFrame, writer: str | None = None, batch: int | None = None, low: str | None = None, high: str | None = None) -> int:
        folder, version = f"rows/{uuid.uuid4().hex}", self.version() + 1
        rows.select(*self.columns).write.parquet(f"{self.folder}/{folder}")
        self.spark.createDataFrame([(version, kind, folder, writer, batch, low, high)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return version

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Commits rows, and tells whether it did: a batch that its writer has committed before is left out."""
        if writer is not None and any(c.writer == writer and c.batch == batch for c in self.commits()):
            return False
        self._commit("append", self.merge(rows), writer, batch)
        return True

    def sink(self, writer: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
        """For ``foreachBatch``: commits each micro-batch of a stream once, also when the stream starts again."""
        return lambda df, batch: self.append(prepare(df), writer, batch) and None

    def _live(self, version: int | None, part: Column | None = None) -> DataFrame:
        """Rows of all commits up to a version that no later compaction hides."""
        commits = [c for c in self.commits() if version is None or c.version <= version]
        if version is not None and version > 0 and (not commits or commits[-1].version < version):
            raise ValueError(f"there is no version {version}")
        groups: dict[tuple, list[str]] = {}
        for i, c in enumerate(commits):  # folders under the same compactions are read together
            hidden = tuple((x.low, x.high) for x in commits[i + 1 :] if x.kind == "compact")
            if (None, None) not in hidden:
                groups.setdefault(tuple(dict.fromkeys(hidden)), []).append(f"{self.folder}/{c.folder}")
        out = self.spark.createDataFrame([], self.schema)
        for hidden, folders in groups.items():
            rows = self.spark.read.schema(self.schema).parquet(*folders)
            rows = rows if part is None else rows.filter(part)
            for low, high in hidden:
                rows = rows.filter(~self._within(low, high))
            out = out.unionByName(rows)
        return out

    def _within(self, low, high) -> Column:
        kind = self.spark.createDataFrame([], self.schema).schema[self.key].dataType
        k = F.col(self.key)
        inside = F.lit(True) if low is None else k >= F.lit(low).cast(kind)
        return F.coalesce(inside if high is None else inside & (k < F.lit(high).cast(kind)), F.lit(low is None))  # a null key lies below all

    def rows(self, version: int | None = None, part: Column | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The merged rows of the last or a given version.

        ``part`` is a condition on the key that reaches the files, ``keys`` a table with the keys that are wanted."""
        live = self._live(version, part)
        return self.merge(live if keys is None else live.join(keys.select(self.key).distinct(), self.key, "left_semi"))

    def compact(self, low=None, high=None) -> int:
        """Writes low <= key < high anew, merged and sorted; without bounds all keys.  -> the version.

        What a commit adds meanwhile is not hidden, as only commits before this one are."""
        part = None if low is None and high is None else self._within(low, high)
        rows = self.merge(self._live(None, part)).repartitionByRange(self.key).sortWithinPartitions(self.key)
        return self._commit("compact", rows, low=None if low is None else str(low), high=None if high is None else str(high))
