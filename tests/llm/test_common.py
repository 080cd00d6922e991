from sedgework.llm import common


def test_work_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = common.shared_dir(spark, "x"), common.shared_dir(spark, "x")
    assert a.startswith(base) and a != b


def test_own_folder_only_where_none_is_set():
    class Unset:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            class _C:
                get = staticmethod(lambda k: None)

            getConf = staticmethod(lambda: Unset.sparkContext._C)

    assert common.shared_dir(Unset, "x").startswith(common._own_folder())


def test_slices():
    assert list(common.slices([3, 3, 3, 9, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(common.slices([], 6)) == []


def test_materialized_rows_keep_their_schema(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a long, b string")
    assert common.materialize(df, "t").schema == df.schema and common.materialize(df, "t").count() == 2


def test_tidy_gives_the_setting_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with common.tidy(spark):
        assert spark.conf.get(name) == "true"
        rows = common.materialize(spark.range(100).groupBy("id").count(), "t")
    assert spark.conf.get(name) == before and rows.count() == rows.count() == 100
