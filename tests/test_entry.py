import __spark_entry__
from shardloom.plans import catalogue


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and set(catalogue.QUERIES) <= set(q)
    assert __spark_entry__.entry(spark).count() == 20


def test_shard_predicates_and_top_k_reach_the_plan(spark):
    page = catalogue.QUERIES["global_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in page
    top = catalogue.QUERIES["per_shard_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in top
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)" in catalogue.QUERIES["agg_filtered"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
