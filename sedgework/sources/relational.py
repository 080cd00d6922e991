"""Tables of a relational database over JDBC: partitioned reads, and writes that insert or update by key.

Reads are split by ranges of a numeric column, whose bounds the database itself finds; filters and columns that a query
asks for are pushed to it by Spark.  An upsert writes to a table of its own beside the target and then merges it in one
statement, so the target changes at once or not at all, and a task that runs again does no harm.  The statements are
standard SQL (MERGE, VALUES).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Relational:
    """A database by its JDBC ``url`` and further ``options`` (driver, user, password, fetchsize, ...)."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.options = spark, {"url": url, **options}

    def _read(self, **options) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, **{k: str(v) for k, v in options.items()}).load()

    def read(self, table: str, split: str | None = None, parts: int = 8) -> DataFrame:
        """A table in ``parts`` queries by ranges of the numeric column ``split`` (rows where it is null come with the first one)."""
        if split is None:
            return self._read(dbtable=_quoted(table))
        c = _quoted(split)
        low, high = self._read(dbtable=f"(select min({c}) as low, max({c}) as high from {_quoted(table)}) bounds").first()
        if low is None:
            return self._read(dbtable=_quoted(table))
        return self._read(dbtable=_quoted(table), partitionColumn=split, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts)

    def run(self, statement: str) -> None:
        """Runs a statement once, at the start of a session that then reads one row."""
        self._read(dbtable="(values (1)) one (n)", sessionInitStatement=statement).collect()

    def create(self, table: str, like: DataFrame, keys: list[str], types: str = "") -> None:
        """An empty table with the columns of ``like`` and a primary key; ``types`` names those of columns that can't be left to Spark."""
        options = {"createTableColumnTypes": types} if types else {}
        like.limit(0).write.format("jdbc").options(**self.options, dbtable=_quoted(table), **options).mode("error").save()
        for k in keys:
            self.run(f"alter table {_quoted(table)} alter column {_quoted(k)} not null")
        self.run(f"alter table {_quoted(table)} add primary key ({', '.join(map(_quoted, keys))})")

    def append(self, rows: DataFrame, table: str, parts: int = 8) -> None:
        """Inserts rows over at most ``parts`` connections."""
        rows.write.format("jdbc").options(**self.options, dbtable=_quoted(table), numPartitions=str(parts)).mode("append").save()

    def upsert(self, rows: DataFrame, table: str, keys: list[str], types: str = "", parts: int = 8) -> None:
        """Updates the rows of known keys and inserts the others; a key that comes twice fails and changes nothing."""
        stage, cols = f"{table}_{uuid.uuid4().hex[:8]}", rows.columns
        try:
            self.create(stage, rows, keys, types)
            self.append(rows, stage, parts)
            on = " and ".join(f"t.{_quoted(k)} = s.{_quoted(k)}" for k in keys)
            sets = ", ".join(f"{_quoted(c)} = s.{_quoted(c)}" for c in cols if c not in keys)
            update = f"when matched then update set {sets} " if sets else ""
            self.run(f"merge into {_quoted(table)} as t using {_quoted(stage)} as s on {on} {update}when not matched then insert ({', '.join(map(_quoted, cols))}) values ({', '.join(f's.{_quoted(c)}' for c in cols)})")
        finally:
            self.run(f"drop table {_quoted(stage)}")
