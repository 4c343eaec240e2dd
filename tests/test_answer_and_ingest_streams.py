"""Streams of answers, log rows and uploads against their batch forms, and gap classes from hand-made corpora."""

from pyspark.sql import functions as F

from corpusq.operators import answers, chunking, ingest, retrieval
from corpusq.plans import logs
from corpusq.queries_logs import stateful_run
from corpusq.sources import streams
from corpusq.streaming import stateful

DELTAS = "query_id long, seq long, delta string, done boolean, passages int"
ANSWERS = {
    1: ["Intro is he", "ld. Fact one [1", "]. Made up [9]. Fact two 【2】.", " End"],
    2: ["No citation. ", "None at all."],
    3: ["Only a wrong one [7]. ", "Again [0]."],
    4: ["A first sentence that is too long to hold. ", "Then a fact [1]."],
    5: ["[2] ", None, "e.g. this [1][3][4] ."],
    6: [""],
}


def test_answer_parts_equal_assembled_answers(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(q, i, d, i == len(ds) - 1, 3) for q, ds in ANSWERS.items() for i, d in enumerate(ds)]
    d = spark.createDataFrame(rows, DELTAS)
    d.coalesce(1).write.parquet(folder)
    out = stateful_run(stateful.answer_parts(streams.read_stream(spark, folder), 40)).orderBy("query_id", "part").collect()
    whole = spark.createDataFrame([(q, "".join(x for x in ds if x)) for q, ds in ANSWERS.items()], "query_id long, text string")
    said = chunking.sentences(whole, "query_id").withColumn("passages", F.lit(3))
    expected = {r.query_id: r for r in answers.assembled(answers.validated(said), 40).collect()}
    for q in ANSWERS:
        parts = [r for r in out if r.query_id == q]
        text = "".join(r.text for r in parts if r.kind == "token")
        ends = [(r.kind, r.stripped) for r in parts if r.kind != "token"]
        if q not in expected:  # without a sentence there is nothing to assemble
            assert ends == [("refusal", 0)] and not text
            continue
        e = expected[q]
        if e.abstained:
            assert ends == [("refusal", e.stripped)] and not text and parts[-1].text == e.answer
        else:
            assert text == e.answer and ends == ([("citation_warning", e.stripped)] if e.stripped else [])
    assert expected[2].abstained and expected[3].abstained and not expected[1].abstained
    assert expected[4].answer == "Then a fact [1]."


def test_answer_parts_over_several_batches(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i in range(4):
        rows = [(q, i, ds[i], i == len(ds) - 1, 3) for q, ds in ANSWERS.items() if i < len(ds)]
        spark.createDataFrame(rows, DELTAS).coalesce(1).write.mode("append").parquet(folder)
        parts = stateful.answer_parts(streams.read_stream(spark, folder), 40)
        parts.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).where("query_id = 1").orderBy("part").collect()
    assert [r.text for r in got] == ["Intro is held.", " Fact one [1].", " Made up.", " Fact two [2].", " End", ""]
    assert got[-1].kind == "citation_warning" and got[-1].stripped == 1
    assert [r.kind for r in spark.read.parquet(out).where("query_id = 3").collect()] == ["refusal"]


def test_late_log_rows_go_aside(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for part in ([(1, 1000), (2, 0), (3, None)], [(4, 400), (5, 399), (6, 2000)], [(7, 1400), (8, 1399), (9, None)]):
        d = spark.createDataFrame(part, "query_id long, s long").select("query_id", F.timestamp_seconds("s").alias("created_at"))
        d.coalesce(1).write.mode("append").parquet(folder)
        stateful.ingest_log(streams.read_stream(spark, folder), out, state, "10 minutes")
    got = {r.query_id: r.late for r in spark.read.parquet(f"{out}/rows").collect()}
    assert [q for q, late in sorted(got.items()) if late == "true"] == [5, 8] and len(got) == 9


def test_upload_stream_equals_one_batch(spark, tmp_path):
    body = lambda w: "# Head\n\n" + " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, "a.md", body("a")), (2, "b.md", body("b")), (3, "c.exe", body("c")), (4, "d.md", None), (5, "e.md", body("a")), (6, "f.md", body("f"))]
    d = spark.createDataFrame(rows, "doc_id long, filename string, text string").withColumn("uploaded_at", F.timestamp_seconds("doc_id"))
    sizes = {"target": 40, "overlap": 8, "least": 3}
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for part in ("doc_id <= 3", "doc_id > 3 or doc_id = 1"):
        d.where(part).coalesce(1).write.mode("append").parquet(folder)
        stateful.ingest_uploads(streams.read_stream(spark, folder), out, state, **sizes)
    nothing = spark.createDataFrame([], "doc_id long, content_hash string, state string, uploaded_at timestamp")
    one = ingest.ingest(d, nothing, **sizes)
    store = stateful.upload_store(spark, out)
    first = store.read("outcomes").groupBy("doc_id").agg(F.min_by(F.struct("state", "chunks", "duplicate_of", "detail"), "batch").alias("o")).select("doc_id", "o.*")
    assert sorted(map(str, first.collect())) == sorted(map(str, one.outcomes.collect()))
    for name, whole in (("chunks", one.chunks.select("chunk_id", "text")), ("terms", one.terms)):
        assert sorted(map(str, store.read(name).select(*whole.columns).collect())) == sorted(map(str, whole.collect())), name
    again = store.read("outcomes").where("doc_id = 1 and batch = 1").first()
    assert (again.state, again.detail) == ("live", "already indexed")


def test_gap_runs_tell_why_a_question_is_unanswered(spark):
    chunks = spark.createDataFrame(
        [("a", "alpha beta gamma", 3, [1.0, 0.0]), ("b", "delta only here", 3, None), ("c", "other words stand", 3, [0.0, 1.0])], "chunk_id string, text string, token_count int, vector array<double>")
    q = spark.createDataFrame([(1, "alpha beta gamma", [1.0, 0.0]), (2, "delta", None), (3, "zzz", [0.5, 0.5]), (4, "nothing qqq", None)], "query_id long, query string, vector array<double>")
    runs = retrieval.gap_runs(q, chunks, retrieval.Config(threshold=0.9, rerank=False))
    found = {r.query_id: r for r in logs.diagnoses(runs).collect()}
    assert all(r.abstained for r in found.values())
    assert {q: r.gap for q, r in found.items()} == {1: "ranking_gap", 2: "lexical_gap", 3: "semantic_gap", 4: "content_gap"}
    easy = {r.query_id: r for r in logs.diagnoses(retrieval.gap_runs(q, chunks, retrieval.Config(threshold=0.0, rerank=False))).collect()}
    assert easy[1].gap == "answer_gap" and easy[1].open_top is None and "passed at threshold 0.0" in easy[1].evidence
    counts = logs.gap_counts(spark.createDataFrame([("x",), ("x",), ("y",)], "gap string"))
    assert {r.gap: r.n for r in counts.collect()} == {"x": 2, "y": 1}
