"""Holds queries against their SQL in DuckDB: python -m sedgework.plans.compare [sf_dir] [prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return str(v)


def differences(spark, sf_dir: str, names: list[str] | None = None) -> dict[str, str]:
    """What differs, by query; empty if all agree."""
    import duckdb

    from . import catalog

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"create view {p.stem} as select * from '{files}'")
    found, queries, sql = {}, catalog.queries(), catalog.oracle_sql()
    for name in names or sorted(queries):
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            cols = sorted(df.columns)
            got = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
            if name not in sql:
                print(f"{name}: {len(got)} rows, no SQL, {time.time() - began:.1f} s", flush=True)
                continue
            rel = con.sql(sql[name])
            if sorted(rel.columns) != cols:
                found[name] = f"columns {cols} and {sorted(rel.columns)}"
            else:
                at = [rel.columns.index(c) for c in cols]
                want = sorted(tuple(normal(r[i]) for i in at) for r in rel.fetchall())
                if got != want:
                    only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
                    found[name] = f"{len(got)} and {len(want)} rows of {cols}; only in Spark {only[0]}, only in SQL {only[1]}"[:900]
        except Exception as e:  # the report goes on with the other queries
            found[name] = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {'DIFFERS ' + found[name] if name in found else 'ok'}, {time.time() - began:.1f} s", flush=True)
    return found


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from . import catalog

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = [n for n in sorted(catalog.queries()) if any(n.startswith(p) for p in sys.argv[2:])] if len(sys.argv) > 2 else None
    bad = differences(session, folder, chosen)
    print(f"{len(bad)} differ: {sorted(bad)}")
