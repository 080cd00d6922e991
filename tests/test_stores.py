import json
import os

import pytest
from pyspark.sql import functions as F

from sedgework.sources import keyed_json
from sedgework.sources.relational import Relational

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    keyed_json.register(spark)
    folder = f"{tmp_path}/docs"
    write = lambda rows, mode="append": spark.createDataFrame(rows, "key string, document string").repartition(3, "key").write.format("keyed_json").mode(mode).save(folder)
    read = lambda: {r.key: r.document for r in spark.read.format("keyed_json").load(folder).collect()}
    return folder, write, read


def test_documents_are_replaced_one_by_one(store):
    folder, write, read = store
    write([("a/b", '{"v": 1}'), ("é?", "[1]"), ("..", "null"), ("", "0")])
    write([("a/b", '{"v": 2}'), ("new", '"x"')])
    assert read() == {"a/b": '{"v": 2}', "é?": "[1]", "..": "null", "": "0", "new": '"x"'}
    assert all(json.load(open(f"{folder}/{n}")) is not ... for n in os.listdir(folder)) and len(os.listdir(folder)) == 5
    write([("only", "{}")], "overwrite")
    assert read() == {"only": "{}"}


@pytest.mark.parametrize("bad", [[("b", "{broken")], [("b", None)], [(None, "{}")], [("b", "1"), ("b", "2")]])
def test_an_aborted_job_leaves_the_old_documents(store, bad):
    folder, write, read = store
    write([(k, '"old"') for k in "abc"])
    with pytest.raises(Exception):
        write([("a", '"new"'), ("c", '"new"'), *bad])
    assert read() == dict.fromkeys("abc", '"old"') and all(not n.startswith(".") for n in os.listdir(folder))


def test_empty_folder_and_empty_job(store):
    _, write, read = store
    assert read() == {}
    write([])
    assert read() == {}


@pytest.fixture(scope="module")
def base(spark):
    db = Relational(spark, "jdbc:derby:memory:stores;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return db


@pytest.mark.parametrize("table, key", [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")])
def test_tables_come_back_as_they_were_written(spark, base, table, key):
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    rows = rows.select(*[F.col(c).cast("timestamp").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes])
    base.create(table, rows, [key])
    base.append(rows, table)
    back = base.read(table, key, 4)
    assert back.rdd.getNumPartitions() in (4, min(4, rows.count()))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_filters_and_columns_reach_the_database(spark, base):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("x").alias("unused"))
    base.create("pushed", rows, ["k"])
    base.append(rows, "pushed")
    df = base.read("pushed", "k").filter("v > 190").select("k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(v), *GreaterThan(v,190)]" in plan and "unused" not in plan
    assert sorted(r.k for r in df.collect()) == [96, 97, 98, 99]


def test_upsert(spark, base):
    kind, types = "k string, n long, v string", "k VARCHAR(40)"
    make = lambda rows: spark.createDataFrame(rows, kind)
    base.create("upserted", make([]), ["k", "n"], types)
    base.upsert(make([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)]), "upserted", ["k", "n"], types)
    base.upsert(make([("a", 2, "new"), ("c", 1, "z")]), "upserted", ["k", "n"], types)
    read = lambda: sorted(tuple(r) for r in base.read("upserted", "n", 2).collect())
    want = [("a", 1, "x"), ("a", 2, "new"), ("b", 1, None), ("c", 1, "z")]
    assert read() == want
    base.upsert(make([("a", 2, "new"), ("c", 1, "z")]), "upserted", ["k", "n"], types)  # again
    base.upsert(make([]), "upserted", ["k", "n"], types)
    with pytest.raises(Exception):
        base.upsert(make([("d", 1, "1"), ("d", 1, "2")]), "upserted", ["k", "n"], types)
    assert read() == want
    assert base.read("upserted").count() == 4 and len(base._read(dbtable="(select tablename from sys.systables where tablename like 'upserted%') t").collect()) == 1
