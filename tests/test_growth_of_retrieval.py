"""KW6 and the hybrid retrievals: neither words nor texts are shuffled, and each search runs once."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusq.catalog import QUERIES
from corpusq.operators import dense, evaluation, index, retrieval, vectors

TEXTS = {"b-1": "Apple pie apple tart", "b-0": "apple pie with cream, cream", "a-7": "plain bread x yy", "c-2": "", "c-3": None, "d-0": "common " * 300 + "pie", "é-1": "ünder_score apple " + "z" * 70, "f-0": "tart tart common", "b-2": "Apple pie apple tart"}
ASKED = {1: "apple apple pie", 2: "Cream tart common", 3: "nothing here", 4: None, 5: "the common common common bread"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [2, 40])
def test_repeated_bm25_is_summed_in_tasks(spark, monkeypatch, k):
    monkeypatch.setattr(index, "SEEDS", 1)
    chunks = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame(list(ASKED.items()), "query_id int, query string")
    found = index.search_repeated(queries, chunks, k)
    plan = _plan(found)
    assert not re.search(r"hashpartitioning\((chunk_id|term#\d+, \d)", plan), plan
    cut = lambda t: [w for w in re.findall(r"[a-z0-9_]+", (t or "").lower()) if 2 <= len(w) <= 64]
    words = {i: cut(t) for i, t in TEXTS.items()}
    mean = sum(map(len, words.values())) / (len(words) - 1)  # a null text has no length
    df = Counter(w for ws in words.values() for w in set(ws))
    expected = []
    for q, text in ASKED.items():
        scores = {}
        for i, ws in words.items():
            s = 0.0
            for w, times in Counter(cut(text)).items():
                if n := ws.count(w):
                    s += times * max(0.0, math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(ws) / mean))
            if round(s, 6) > 0:
                scores[i] = round(s, 6)
        best = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        expected += [(q, i, pytest.approx(scores[i], abs=2e-6), n + 1) for n, i in enumerate(best)]
    got = sorted(((r.query_id, r.chunk_id, r.score, r["rank"]) for r in found.collect()), key=lambda x: (x[0], x[3]))
    assert got == expected


def test_repeated_bm25_of_nothing(spark):
    queries = spark.createDataFrame([(1, "apple")], "query_id int, query string")
    chunks = spark.createDataFrame([], "chunk_id string, text string")
    assert index.search_repeated(queries, chunks).count() == 0
    assert index.search_repeated(queries, spark.createDataFrame([("a", None)], "chunk_id string, text string")).count() == 0


def _hybrid(spark):
    words = ["alpha", "beta", "gamma", "delta", "ünder"]
    chunks = spark.createDataFrame([(i, " ".join(words[(i * j) % 5] + str(i % 7) for j in range(1, 9)), 8) for i in range(60)], "chunk_id long, text string, token_count int").repartition(3)
    queries = spark.createDataFrame([(1, "alpha1 beta1"), (2, "zzz"), (3, "gamma3 delta3 alpha3")], "query_id long, query string")
    embedded = vectors.hash_embedding(chunks, "chunk_id", 16)
    return queries.join(vectors.hash_embedding(queries.withColumnRenamed("query", "text"), "query_id", 16), "query_id"), chunks, embedded


def test_embeddings_are_made_in_tasks(spark):
    _, _, embedded = _hybrid(spark)
    assert "hashpartitioning" not in _plan(embedded)
    texts = [(1, "a b"), (2, None), (3, ""), (4, "-"), (5, " Éa  b "), (6, "x" * 9_000_000 + " a")]
    got = {r.k: r.vector for r in vectors.hash_embedding(spark.createDataFrame(texts, "k int, text string"), "k", 8).collect()}
    axis = [1.0] + [0.0] * 7
    assert got[2] == got[3] == got[4] == axis and len(got) == 6
    assert all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values())


def test_each_search_runs_once(spark, monkeypatch):
    """LOG6's four runs and EV8's four configurations share their searches."""
    queries, chunks, embedded = _hybrid(spark)
    ran = []
    monkeypatch.setattr(index, "search", lambda *a, f=index.search, **b: ran.append("keyword") or f(*a, **b))
    monkeypatch.setattr(dense, "cosine_top", lambda *a, f=dense.cosine_top, **b: ran.append("vector") or f(*a, **b))
    runs = retrieval.gap_runs(queries, chunks, retrieval.Config(threshold=2.0), embedded=embedded).collect()
    assert sorted(ran) == ["keyword", "vector"] and len(runs) == 3 and all(r.abstained for r in runs)
    ran.clear()
    assert QUERIES["ev8_ablation"](spark, "/root/testdata/sf0.001").count() == 4
    assert sorted(ran) == ["keyword", "vector"]


def test_texts_come_to_few_candidates_unshuffled(spark, monkeypatch):
    queries, chunks, embedded = _hybrid(spark)
    plans = []
    monkeypatch.setattr(retrieval, "written", lambda df, name="table", f=retrieval.written: plans.append((name, _plan(df))) or f(df, name))
    retrieval.candidates(queries, chunks, retrieval.Config(), None, embedded)
    plan = dict(plans)["candidates"]
    assert "hashpartitioning(chunk_id" not in plan and "BroadcastHashJoin" in plan, plan


def test_texts_come_to_few_hits_unshuffled(spark):
    _, chunks, _ = _hybrid(spark)
    chunks = chunks.unionByName(spark.createDataFrame([(99, "before One two  three four after", 6)], chunks.schema))
    asked = spark.createDataFrame([(1, "one two  three four"), (2, "one three two four"), (3, None), (4, "wo")], "query_id long, evidence string")
    found = evaluation.holding(asked, chunks, once=True)
    assert "hashpartitioning(chunk_id" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 99), (4, 99)]
