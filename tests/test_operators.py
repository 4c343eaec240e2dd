"""Hand-made cases of the library's own operators."""

from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.operators import keyword, lifecycle, ranking


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_tokens_and_counts(spark):
    assert one(spark, T.tokens, "A big_one, 2x: b é ok") == ["big_one", "2x", "ok"]
    assert one(spark, T.token_count, "one two  three four") == 3


def test_clean_text(spark):
    assert one(spark, T.clean_text, "a \r\nPage 3 of 9\n-----\n\n\n\nb c​") == "a\n\nb c"


def test_topic_and_markers(spark):
    assert one(spark, T.topic, "What is the warranty?") == "warranty"
    assert one(spark, T.markers, "x [2] y【3】[07]") == [2, 3, 7]


def test_query_terms_leave_stopwords_out_first(spark):
    assert one(spark, T.query_terms, "the refund of the window") == ["refund", "window", "refund_window"]


def test_bm25_rare_term_wins_and_stopwords_find_nothing(spark):
    c = spark.createDataFrame([(1, "common rare", 1), (2, "common common", 1), (3, "common other", 1)], "chunk_id int, text string, token_count int")
    q = spark.createDataFrame([(1, "rare common"), (2, "what is the")], "query_id int, query string")
    r = keyword.bm25(q, c).collect()
    assert {x.query_id for x in r} == {1} and min(r, key=lambda x: x.rank).chunk_id == 1


def test_fusion_uses_ranks(spark):
    rows = [(1, "a", 1, 1.0), (1, "b", 2, 1.0), (1, "b", 1, 1.0)]
    r = ranking.fuse(spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, weight double")).orderBy("rank").collect()
    assert [x.chunk_id for x in r] == ["b", "a"]


def test_budget_skips_what_does_not_fit(spark):
    rows = [(1, "a", 1, "x", 60), (1, "b", 2, "x", 60), (1, "c", 3, "x", 40)]
    r = ranking.budget(spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, text string, token_count int"), 100).collect()
    assert sorted(x.chunk_id for x in r) == ["a", "c"]


def test_gate_tests_the_top_only(spark):
    rows = [(1, "a", 1, 0.9, 10), (1, "b", 2, 0.1, 10), (1, "c", 3, 0.1, 3000), (2, "d", 1, 0.2, 10)]
    r = ranking.gate(spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, score double, token_count int"), 0.5).collect()
    assert sorted(x.chunk_id for x in r) == ["a", "b"]


def test_content_hash_separates_chunk_borders(spark):
    rows = [(1, 0, "ab"), (1, 1, "c"), (2, 0, "a"), (2, 1, "bc"), (3, 1, "c"), (3, 0, "ab")]
    h = {x.doc_id: x.content_hash for x in lifecycle.content_hash(spark.createDataFrame(rows, "doc_id int, chunk_index int, text string")).collect()}
    assert h[1] == h[3] != h[2]


def test_state_keeps_reason_only_while_failed(spark):
    rows = [(1, 1, "failed", "x"), (1, 2, "live", None), (2, 1, "failed", "y")]
    r = {x.doc_id: (x.state, x.error_reason) for x in lifecycle.current_state(spark.createDataFrame(rows, "doc_id int, seq int, state string, reason string")).collect()}
    assert r == {1: ("live", None), 2: ("failed", "y")}


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
