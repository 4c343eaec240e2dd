"""Queries on the candidates of a search send few candidates to the chunks: no text is shuffled or broadcast to meet them."""

import pytest

from corpusq.catalog import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rnk10_budget", "cit8_extractive", "rnk4_adjacency", "rnk9_gate", "rnk3_lexical"])
def test_chunks_are_not_shuffled(spark, name):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100_000)  # less than the documents
    try:
        df = QUERIES[name](spark, DATA)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan, "the search would run for each place that reads its rows"
        assert "Exchange hashpartitioning(chunk_id" not in plan and "Exchange hashpartitioning(cast(chunk_id" not in plan, plan
        assert df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
