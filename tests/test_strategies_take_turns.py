"""EV15 keeps one strategy's chunks at a time, and paragraphs are put in order without their texts."""

import os

from corpusq.catalog import QUERIES
from corpusq.functions import structure
from corpusq.sources import streams


def test_chunks_go_when_their_strategy_is_measured(spark):
    base = os.path.dirname(streams.shared_path(spark, "x")).removeprefix("file://")
    tables = lambda: {f for f in os.listdir(base) if f.startswith("chunks-")} if os.path.isdir(base) else set()
    before = tables()
    assert QUERIES["ev15_strategies"](spark, "/root/testdata/sf0.001").count() == 3
    assert tables() == before


def test_paragraphs_are_shuffled_without_texts(spark):
    docs = spark.createDataFrame([(1, " a b\n\n\n  second one \n\nthird"), (2, ""), (3, None), (4, "\n\n x \n\n")], "doc_id long, text string")
    found = structure.paragraphs(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    at = plan.index("Exchange hashpartitioning(doc_id")
    below = plan[at:].split("\n")[1]
    assert "Project" in below and "token_count" in below and ".part AS" not in below, below
    assert sorted(map(tuple, found.collect())) == [(1, 1, 4, 1), (1, 9, 19, 1), (1, 22, 27, 0), (4, 3, 4, 0)]
