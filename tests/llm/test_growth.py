"""Plans of steps whose rows grow beyond what Spark makes of them: nothing that is much larger than it looks is broadcast."""

import numpy as np
from pyspark.sql import functions as F

from corpusq.llm import simhash, topk
from corpusq.llm.common import stage


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicas_are_not_broadcast(spark):
    """A fingerprint has 34 replicas, which look no larger than it."""
    centers = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 40).tolist()
    near = [c ^ bits for c in centers for bits in (0, 1, 3, 7, 15)]
    found = simhash.links(stage(spark.createDataFrame([(x,) for x in near], "fp long")))
    assert "BroadcastHashJoin" not in _plan(found)
    groups = {}
    for r in simhash.components(stage(found.distinct())).collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(c ^ bits for bits in (0, 1, 3, 7, 15)) for c in centers)


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch):
    """Each query is sent to many pages; a page travels once with all its blocks."""
    monkeypatch.setattr(topk, "PAGE", 32)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(3)
    for longest in (2.0, float(1 << 23)):  # components travel in two and in eight bytes
        x = np.r_[rng.normal(size=(600, 6)), [[longest] + [0.0] * 5]]
        seen = {}
        got = topk.top_k(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, seen=seen)
        plan = _plan(got)
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoop" not in plan, plan
        assert seen["pairs1"] + seen["pairs2"] > 3 * seen["queries"]
        whole = np.array([[int(c) for c in np.floor(256 * r)] for r in x], object)
        found = {}
        for r in got.collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in range(0, 601, 3):
            s = whole @ whole[q]
            best = sorted((i for i in range(601) if i != q), key=lambda i: (-s[i], i))[:5]
            assert sorted(found[q]) == [(n + 1, i, s[i]) for n, i in enumerate(best)]
