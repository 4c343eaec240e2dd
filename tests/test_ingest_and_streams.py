"""Hand-made cases of the ingest, streams with state, ablations, strategies, model scores and log rows."""

import json

from pyspark.sql import functions as F

from corpusq.operators import chunking, evaluation, ingest, lifecycle, retrieval
from corpusq.queries_logs import stateful_run
from corpusq.sources import files, streams
from corpusq.streaming import stateful

SIZES = {"target": 40, "overlap": 8, "least": 3}


def stream(spark, tmp_path, df):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return streams.read_stream(spark, str(tmp_path / "in"))


def test_ingest_outcomes(spark):
    body = lambda w: "# Head\n\n" + " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, "a.md", body("a")), (2, "b.md", body("a")), (3, "c.exe", body("c")), (4, "d.txt", " \n "), (5, "e.md", "one two"), (6, "f.md", body("f")), (7, "g.md", body("g")),
            (8, "h.md", body("h")), (9, "i.md", body("i")), (10, "j.md", body("j")), (11, "k.md", None)]
    d = spark.createDataFrame(rows, "doc_id long, filename string, text string").withColumn("uploaded_at", F.timestamp_seconds("doc_id"))
    of = lambda *ids: lifecycle.content_hash(chunking.chunk_documents(d.where(F.col("doc_id").isin(*ids)), **SIZES))
    states = spark.createDataFrame([(20, 6, "live"), (7, 7, "live"), (8, 8, "deleted"), (9, 9, "failed"), (21, 10, "deleted")], "doc_id long, of long, state string")
    registry = states.join(of(6, 7, 8, 9, 10).select(F.col("doc_id").alias("of"), "content_hash"), "of").drop("of").withColumn("uploaded_at", F.timestamp_seconds(F.lit(0)))
    got = ingest.ingest(d, registry, **SIZES)
    out = {r.doc_id: (r.state, r.chunks > 0, r.duplicate_of, r.detail) for r in got.outcomes.collect()}
    assert out == {
        1: ("live", True, None, None), 2: ("duplicate", False, 1, "duplicate of 1; not indexed"), 3: ("failed", False, None, "unsupported"), 4: ("failed", False, None, "no text"),
        5: ("failed", False, None, "no chunks"), 6: ("duplicate", False, 20, "duplicate of 20; not indexed"), 7: ("live", False, None, "already indexed"), 8: ("deleted", False, None, "tombstoned, not ingested"),
        9: ("live", True, None, None), 10: ("live", True, None, None), 11: ("failed", False, None, "no text"),
    }
    assert {r.doc_id for r in got.chunks.collect()} == {1, 9, 10}
    assert got.chunks.where("size(vector) <> 64").count() == 0
    assert got.terms.select("chunk_id").distinct().count() == got.chunks.count()


def test_ingest_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, filename string, text string, uploaded_at timestamp")
    registry = spark.createDataFrame([], "doc_id long, content_hash string, state string, uploaded_at timestamp")
    got = ingest.ingest(d, registry)
    assert got.outcomes.count() == got.chunks.count() == got.terms.count() == 0


def test_silence_is_told_once(spark, tmp_path):
    rows = [("a", m * 60) for m in (0, 5, 30, 40, 120)] + [("b", 60), ("c", 7000)]
    d = spark.createDataFrame(rows, "source string, s long").select("source", F.timestamp_seconds(F.col("s") + 864000).alias("created_at"))
    got = stateful_run(stateful.silence_stream(stream(spark, tmp_path, d))).select("source", ((F.unix_seconds("silent_from") - 864000) / 60).cast("int").alias("m")).collect()
    assert sorted((r.source, r.m) for r in got) == [("a", 5), ("a", 40), ("b", 1)]


def test_lifecycle_stream_rejects(spark, tmp_path):
    rows = [(1, 1, "pending", None), (1, 2, "live", None), (1, 3, "extracting", None), (1, 4, "failed", None), (1, 5, "failed", "why"), (2, 1, "live", None)]
    d = spark.createDataFrame(rows, "doc_id long, seq long, state string, reason string")
    got = {(r.doc_id, r.seq): (r.before, r.accepted) for r in stateful_run(stateful.lifecycle_stream(stream(spark, tmp_path, d))).collect()}
    assert got == {(1, 1): (None, True), (1, 2): ("pending", False), (1, 3): ("pending", True), (1, 4): ("extracting", False), (1, 5): ("extracting", True), (2, 1): (None, False)}


def test_answer_stream_gives_whole_sentences(spark, tmp_path):
    rows = [(1, 0, "One is", False), (1, 1, " here. Two", False), (1, 2, " is e.g. there [1]. Rest", True), (2, 0, "Not whole", False)]
    d = spark.createDataFrame(rows, "query_id long, seq long, delta string, done boolean")
    got = stateful_run(stateful.answer_sentences(stream(spark, tmp_path, d))).orderBy("query_id", "sent_idx").collect()
    assert [(r.query_id, r.sentence) for r in got] == [(1, "One is here."), (1, "Two is e.g. there [1]."), (1, "Rest")]


def test_feedback_joins_within_the_hour(spark, tmp_path):
    log = spark.createDataFrame([(1, 10**5), (2, 10**5), (3, 10**5), (9, 10**6)], "query_id long, s long").select("query_id", F.timestamp_seconds("s").alias("created_at"))
    votes = spark.createDataFrame([(1, 10**5 + 60, "up"), (2, 10**5 + 7200, "up"), (9, 10**6, "up")], "query_id long, s long, vote string").select("query_id", F.timestamp_seconds("s").alias("voted_at"), "vote")
    (tmp_path / "l").mkdir(), (tmp_path / "v").mkdir()
    out = streams.run_to_end(stateful.with_feedback(stream(spark, tmp_path / "l", log), stream(spark, tmp_path / "v", votes)))
    got = {r.query_id: r.vote for r in out.collect()}
    assert got == {1: "up", 2: None, 3: None, 9: "up"}


def test_ablation_and_strategies(spark):
    runs = spark.createDataFrame([("full", 0.75), ("keyword only", 0.5)], "config string, recall double")
    assert {r.config: r.delta for r in evaluation.ablation(runs).collect()} == {"full": 0.0, "keyword only": -0.25}
    labels = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "c"), ("s", 3, None), ("s", 4, "d")], "strategy string, query_id long, chunk_id string")
    ranked = spark.createDataFrame([("s", 1, "b", 1), ("s", 1, "a", 2), ("s", 2, "c", 4), ("s", 3, "z", 1)], "strategy string, query_id long, chunk_id string, rank int")
    chunks = spark.createDataFrame([("s", 10), ("s", 20)], "strategy string, token_count int")
    r = evaluation.strategies(labels, ranked, chunks).first()
    assert (r.chunks, r.mean_tokens, r.unlabelled) == (2, 15.0, 1)
    assert [round(x, 6) for x in (r.recall_1, r.recall_10, r.mrr)] == [0.333333, 0.666667, 0.416667]


def test_first_token_times(spark):
    d = spark.createDataFrame([("x", i % 50) for i in range(100)] + [("x", None), ("y", None)], "category string, ttft_ms int")
    assert [tuple(r) for r in evaluation.first_token_times(d).collect()] == [("x", 25, 47)]


def test_model_scores_and_log_rows(spark):
    pool = spark.createDataFrame([(1, "q", "a", "long text"), (1, "q", "b", "t")], "query_id long, query string, chunk_id string, text string")
    assert {r.chunk_id: r.score for r in retrieval.model_scores(pool, lambda q, t: [float(len(x)) for x in t]).collect()} == {"a": 9.0, "b": 1.0}
    found = spark.createDataFrame([(1, "a", 2.0, None, 0.5, 0.25)], "query_id long, chunk_id string, keyword double, vector double, fused double, reranked double")
    results = spark.createDataFrame([(1, False, 0.25), (2, True, None)], "query_id long, abstained boolean, top_score double")
    got = {r.query_id: r for r in files.log_rows(found, results).collect()}
    assert json.loads(got[1].scores["a"]) == {"keyword": 2.0, "fused": 0.5, "reranked": 0.25} and got[2].scores is None and got[2].abstained
