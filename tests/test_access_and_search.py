"""Access, passages, adjacency and searches against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.operators import access, dense, evaluation, keyword, ranking, retrieval, vectors


def test_access_is_applied_before_the_best_are_taken(spark):
    rows = [(i, i, "apple pie " * (1 + i % 3) + f"w{i}", 2, ["a"] if i % 4 else ["b"], [1.0, float(i)]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string, token_count long, acl_tags array<string>, vector array<double>")
    registry = spark.createDataFrame([(i, "live" if i % 5 else "deleted") for i in range(40)], "doc_id long, state string")
    queries = spark.createDataFrame([(1, "apple", ["b"], [0.0, 1.0]), (2, "apple", [], [0.0, 1.0]), (3, "apple", None, [0.0, 1.0]), (4, "apple", ["c"], [0.0, 1.0])], "query_id long, query string, grants array<string>, vector array<double>")
    seen = access.live(chunks, registry)
    for found in (keyword.bm25(queries, seen, 3), keyword.lookup(queries, keyword.postings(seen), 3, seen), dense.cosine_top(queries, seen, 3), retrieval.candidates(queries, seen, retrieval.Config(fetch=3, rerank=False))):
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert set(got) == {1, 2, 3} and all(len(x) >= 3 for x in got.values())
        assert all(i % 4 == 0 and i % 5 for i in got[1]) and len(got[1]) >= 3
        assert all(i % 5 for i in got[2]) and got[2] == got[3]


def test_postings_of_asked_terms_are_those_of_all(spark):
    long = " ".join(f"t{i}" for i in range(3000)) + " t7 t7"
    chunks = spark.createDataFrame([(1, long, 5), (2, "t7 t8 T7 x", 4), (3, "", 0)], "chunk_id long, text string, token_count long")
    asked = spark.createDataFrame([(1, "t7"), (1, "t2999"), (2, "t7")], "query_id long, term string")
    for most in (2000, 5):
        want = keyword.postings(chunks, most).join(asked.select("term").distinct(), "term", "left_semi").select("chunk_id", "term", "term_count")
        assert sorted(keyword.asked_postings(chunks, asked, most).select("chunk_id", "term", "term_count").collect()) == sorted(want.collect())


def test_holding_against_contains(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 30, 60)) for _ in range(30)] + ["", None, "short one"]
    evidence = []
    for i in range(20):
        t = texts[i]
        a = int(rng.integers(0, 100))
        evidence.append(t[a : a + int(rng.integers(3, 90))].lower())
    evidence += [None, "Short", "not there at all but long enough to have a probe", "  ", "w1  w2"]
    q = spark.createDataFrame(list(enumerate(evidence)), "query_id long, evidence string")
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    want = sorted((i, j) for i, e in enumerate(evidence) for j, t in enumerate(texts) if e is not None and t is not None and e.lower() in t.lower())
    assert sorted(map(tuple, evaluation.holding(q, c).collect())) == want


def test_adjacency_against_plain_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(i, sorted(set(rng.integers(0, 40, int(n)).tolist()))) for i, n in enumerate(rng.integers(0, 15, 50))]
    got = dict(map(tuple, spark.createDataFrame(rows, "i int, p array<int>").select("i", ranking.adjacent(F.col("p"))).collect()))
    for i, p in rows:
        pairs = sum(0 < b - a <= 5 for a in p for b in p)
        assert got[i] == pytest.approx(min(1.0, pairs / (len(p) - 1)) if len(p) > 1 else 0.0)


def test_cosine_top_against_plain_search(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 5)), 1)
    x[::17] = 0.0
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    q, c = df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id")
    cos = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 9) if a.any() and b.any() else 0.0
    want = sorted((i, j, s, n + 1) for i in range(0, 300, 10) for n, (s, j) in enumerate(sorted(((cos(x[i], x[j]), j) for j in range(300) if j != i), key=lambda t: (-t[0], t[1]))[:7]))
    got = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in dense.cosine_top(q, c, 7, 9, others=True).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_approximate_search_compares_few_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.05
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    r = dense.recall(df.where("id % 50 = 0").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), 5).first()
    assert r.recall >= 0.9 and r.share <= 0.01


def test_approximate_search_without_rows_and_with_odd_ones(spark):
    kinds = ("query_id long, vector array<double>", "chunk_id long, vector array<double>")
    none = [spark.createDataFrame([], k) for k in kinds]
    one = [spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], k) for k in kinds]
    assert dense.approximate_top(*none).count() == dense.approximate_top(none[0], one[1]).count() == dense.approximate_top(one[0], none[1]).count() == 0
    got = dense.approximate_top(one[0].dropDuplicates(["query_id"]), one[1].dropDuplicates(["chunk_id"]), 2).collect()
    assert sorted((r.query_id, r.chunk_id, r.score) for r in got) == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0)]


def test_access_limits_approximate_search(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=6)], ["a"] if i % 3 else ["b"]) for i in range(200)]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>, acl_tags array<string>")
    q = spark.createDataFrame([(i, rows[i][1], g) for i, g in ((0, ["a"]), (1, ["b"]), (2, []), (3, None))], "query_id long, vector array<double>, grants array<string>")
    near, exact = (f(q, c, 5).collect() for f in (dense.approximate_top, dense.cosine_top))
    tags = {r[0]: r[2][0] for r in rows}
    assert all(tags[r.chunk_id] == {0: "a", 1: "b"}[r.query_id] for r in near if r.query_id < 2)
    assert len({(r.query_id, r.chunk_id) for r in near} & {(r.query_id, r.chunk_id) for r in exact}) >= 19


def test_scores_by_text(spark):
    ranked = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (1, 12, "a"), (1, 13, "c")], "query_id int, chunk_id int, text string")
    hits = spark.createDataFrame([(1, 2, "a", 0.5), (1, 1, "a", 0.9), (1, 3, "b", 0.4)], "query_id int, position int, text string, score double")
    assert sorted(map(tuple, retrieval.scores_by_text(ranked, hits).collect())) == [(1, 10, 0.9), (1, 11, 0.4), (1, 12, 0.9)]
