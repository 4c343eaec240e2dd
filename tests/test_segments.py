"""The segment store: replaced and deleted keys, lookups, compaction, writers that stop half-way; and uploads that stop between a batch's tables and its manifest."""

import random

import pytest
from pyspark.sql import functions as F

from corpusq.operators import ingest
from corpusq.sources import segments, streams
from corpusq.streaming import stateful

SCHEMA = "doc_id long, tag string, n int"


def test_store_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 3)
    rng = random.Random(5)
    store = segments.Store(spark, str(tmp_path / "store"), "doc_id", indexed={"rows": ["doc_id", "tag"]}, logs=("log",), fan=3)
    want, log, levels = {}, [], []
    for n in range(10):
        if n == 6:
            gone = [k for k in want if k % 3 == 0]
            buried = store.delete(n, spark.createDataFrame([(k,) for k in gone], "doc_id long"))
            assert buried == sum(len(want.pop(k)) for k in gone)
        else:
            new = {rng.randint(0, 15): [f"t{rng.randint(0, 4)}" for _ in range(rng.randint(0, 3))] for _ in range(4)}
            rows = [(k, t, n) for k, ts in new.items() for t in ts]
            want |= {k: [(k, t, n) for t in ts] for k, ts in new.items()}
            log += [(k, "seen", n) for k in new]
            tables = {"rows": spark.createDataFrame(rows, SCHEMA), "log": spark.createDataFrame([(k, "seen", n) for k in new], SCHEMA)}
            assert store.commit(n, spark.createDataFrame([(k,) for k in new], "doc_id long"), tables)
            assert not store.commit(n, spark.createDataFrame([(99,)], "doc_id long"), tables)
        store.compact()
        levels.append(len(store.manifest().segments))
        whole = sorted(r for v in want.values() for r in v)
        if n in (0, 4, 6, 9):
            assert sorted(map(tuple, store.read("rows").collect())) == whole
            assert sorted(map(tuple, store.read("log").collect())) == sorted(log)
            some = spark.createDataFrame([("t1", 3), ("t9", 4), (None, 5)], "tag string, doc_id long")
            assert sorted(map(tuple, store.lookup("rows", "tag", some).select("doc_id", "tag", "n").collect())) == [r for r in whole if r[1] == "t1"]
            assert sorted(map(tuple, store.lookup("rows", "doc_id", some).select("doc_id", "tag", "n").collect())) == [r for r in whole if r[0] in (3, 4, 5)]
    assert max(levels) <= 2 * 3  # few segments, however many batches
    store.vacuum()
    assert sorted(map(tuple, store.read("rows").collect())) == whole


def test_readers_never_see_half_a_batch(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "store"), "doc_id")
    tables = lambda n: {"a": spark.createDataFrame([(1, "x", n)], SCHEMA), "b": spark.createDataFrame([(1, "y", n)], SCHEMA)}
    keys = spark.createDataFrame([(1,)], "doc_id long")
    store.commit(0, keys, tables(0))

    def stop():
        assert [store.read(t).first().n for t in ("a", "b")] == [0, 0]
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        store.commit(1, keys, tables(1), stop)
    assert [store.read(t).first().n for t in ("a", "b")] == [0, 0]
    assert store.commit(1, keys, tables(1)) and [store.read(t).first().n for t in ("a", "b")] == [1, 1]
    assert store.vacuum() == 1 and store.read("a").first().n == 1  # what the killed writer left
    # Of two writers of one version, the second gets an error and changes nothing.
    with pytest.raises(segments.Conflict):
        store._publish(segments.Manifest(store.manifest().version))
    assert store.read("a").first().n == 1


def test_lookups_read_only_their_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 50)
    store = segments.Store(spark, str(tmp_path / "store"), "doc_id", indexed={"rows": ["doc_id"]})
    d = spark.range(2000).selectExpr("id as doc_id", "'t' as tag", "1 as n")
    store.commit(0, d.select("doc_id"), {"rows": d})
    found = store.lookup("rows", "doc_id", spark.createDataFrame([(7,), (1234,)], "doc_id long"))
    assert found.count() == 2
    filters = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters: [" in x and "_bucket" in x]
    assert filters and store.manifest().segments[0].buckets["rows/doc_id"] == 40


def test_upload_stream_that_stops_before_its_manifest(spark, tmp_path):
    body = lambda w: "# Head\n\n" + " ".join(f"{w}{i}" for i in range(30))
    rows = [(1, "a.md", body("a")), (2, "b.md", None), (3, "c.md", body("a")), (2, "b.md", body("b")), (4, "d.md", body("d"))]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, filename string, text string, at long").withColumn("uploaded_at", F.timestamp_seconds("at"))
    sizes = {"target": 40, "overlap": 8, "least": 3}
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    store = stateful.upload_store(spark, out)

    def stop():
        raise RuntimeError("killed")

    for i, part in enumerate(("at < 2", "at >= 2")):
        d.where(part).drop("at").coalesce(1).write.mode("append").parquet(folder)
        before = store.manifest()
        with pytest.raises(Exception, match="killed"):
            stateful.ingest_uploads(streams.read_stream(spark, folder), out, state, stop, **sizes)
        assert store.manifest() == before
        if i:
            assert {r.doc_id for r in store.read("chunks").collect()} == {1}
        stateful.ingest_uploads(streams.read_stream(spark, folder), out, state, **sizes)
    states = {r.doc_id: r.state for r in store.read("registry").collect()}
    assert states == {1: "live", 2: "live", 3: "duplicate", 4: "live"}
    assert {r.doc_id for r in store.read("chunks").collect()} == {1, 2, 4} and store.read("outcomes").count() == 5
    last = d.groupBy("doc_id").agg(F.max_by(F.struct("filename", "text", "uploaded_at"), "at").alias("u")).select("doc_id", "u.*")
    one = ingest.ingest(last, spark.createDataFrame([], "doc_id long, content_hash string, state string, uploaded_at timestamp"), **sizes)
    for name, whole in (("chunks", one.chunks.select("chunk_id", "text")), ("terms", one.terms)):
        assert sorted(map(str, store.read(name).select(*whole.columns).collect())) == sorted(map(str, whole.collect())), name
