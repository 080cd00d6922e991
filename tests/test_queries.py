import pytest

import __spark_entry__ as entry
from sedgework.plans import catalog
from sedgework.plans.compare import differences


def test_all_queries_equal_their_sql(spark):
    assert differences(spark, "/root/testdata/sf0.001", sorted(catalog.oracle_sql())) == {}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "topic", "rank", "chunk_no", "score", "digest"] and df.count() > 0


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 170


@pytest.mark.parametrize("name", ["o80_evidence_topk"])
def test_rank_filter_runs_before_the_shuffle(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_upsert_invents_no_title(spark, tmp_path):
    customers = [(3, "kept by nobody"), (6, "replaced"), (4, "no order"), (1, "ordered"), (2, "ordered"), (5, ""), (7, None), (8, ""), (10, None), (12, None), (None, "no key")]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in (6, 6, 1, 2, 5, 7, 9, 20, None)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.k: r.title for r in catalog.queries()["o78_upsert_documents"](spark, str(tmp_path)).collect()}
    assert got[3] is None and got[6] == "n6" and got[9] == "n9" and got[1] == "ordered"
    assert differences(spark, str(tmp_path), ["o78_upsert_documents"]) == {}
