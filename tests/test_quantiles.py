"""Percentiles by selection equal those of sorted values, in small groups, hot ones, and with ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.plans import quantiles

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def test_quantiles_of_hot_and_small_groups(spark):
    rng = np.random.default_rng(1)
    groups = {
        "hot": np.r_[rng.normal(size=20_000), rng.lognormal(6, 3, 10_000)], "ties": rng.integers(0, 3, 15_000).astype(float), "one": np.full(5000, 7.5), "outlier": np.r_[rng.normal(size=6000), 1e300, -1e300],
        None: rng.normal(size=300), "single": np.array([2.0]), "two": np.array([1.0, 4.0]),
    }
    rows = [(g, float(x), "k") for g, v in groups.items() for x in v] + [("none", None, "k"), ("two", None, "k")]
    d = spark.createDataFrame(rows, "g string, v double, name string").repartition(7)
    seen = []
    got = {r.g: r for r in quantiles.quantiles(d, ["g"], F.col("v"), SHARES, leaf=400, steps=100, seen=seen).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        for name, s in SHARES.items():
            assert got[g][name] == pytest.approx(float(np.percentile(v, 100 * s)), rel=1e-12), (g, name)
    assert len(seen) > 1 and seen[0] < 0.6 * 5 * sum(map(len, groups.values()))


def test_quantiles_of_a_whole_table(spark):
    d = spark.range(1, 5001).select((F.col("id") % 1000).alias("v"))
    r = quantiles.quantiles(d, [], F.col("v"), {"p95": 0.95}, leaf=100).collect()
    assert [x.p95 for x in r] == [pytest.approx(float(np.percentile(np.arange(1, 5001) % 1000, 95)))]
    assert quantiles.quantiles(d.limit(0), [], F.col("v"), {"p95": 0.95}).count() == 0
