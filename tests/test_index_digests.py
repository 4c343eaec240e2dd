"""A derived index is compared by digests: unchanged ones without joining rows, changed ones bucket by bucket."""

from pyspark.sql import functions as F

from corpusq.operators import vectors


def rows(spark, n, skip=(), other=(), extra=()):
    data = [(i, [float(i), -1.0 if i in other else 1.0]) for i in range(n) if i not in skip] + [(i, [0.0]) for i in extra]
    return spark.createDataFrame(data, "chunk_id long, embedding array<double>").repartition(3)


def test_changes_by_digest(spark):
    live, index = rows(spark, 500).unionByName(spark.createDataFrame([(900, None)], "chunk_id long, embedding array<double>")), rows(spark, 500, {3, 77}, {5, 499}, {600})
    got = {r.chunk_id: r.action for r in vectors.index_changes(live, index, 50).collect()}
    assert got == {3: "insert", 77: "insert", 5: "update", 499: "update", 600: "remove"}
    a, b, both = vectors._unequal(live.where("chunk_id <> 900"), index, 50, "embedding")
    assert a.count() + b.count() < 200 and both.count() == 50
    d = vectors.divergence(live, index, 2, 50).first().asDict()
    assert d == {"table_count": 500, "index_count": 499, "missing": 2, "stale": 1, "malformed": 1, "empty": False}


def test_an_unchanged_index_is_not_joined(spark):
    live = rows(spark, 300)
    a, b, _ = vectors._unequal(live, live.orderBy(F.rand(1)), 20, "embedding")
    assert a.count() == b.count() == vectors.index_changes(live, live).count() == 0
    none = live.limit(0)
    assert vectors.divergence(live, none, 2).first().empty and not vectors.divergence(none, none, 2).first().empty
    assert vectors.index_changes(none, live).where("action = 'remove'").count() == 300
