"""As-of joins, pointer doubling, and what is built on them: rate limits and section paths of hot keys."""

import bisect
import random
import time

from pyspark.sql import functions as F

from corpusq.functions import structure as S
from corpusq.operators import asof
from corpusq.streaming import stateful


def test_last_and_next_marks_against_bisect(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-300, 300), i) for i in range(400)]
    marks = sorted({(rng.choice(["a", "a", None, "c"]), rng.randint(-250, 250)) for _ in range(60)}, key=str)
    r = spark.createDataFrame(rows, "k string, t long, name int").repartition(3)
    m = spark.createDataFrame(marks, "k string, t long")
    of = {k: sorted(t for g, t in marks if g == k) for k in ("a", "b", None)}
    for width in (7, 1000):
        last = {x.name: x.mark for x in asof.last_marks(r, m, ["k"], "t", width).collect()}
        after = {x.name: x.mark for x in asof.next_marks(r, m, ["k"], "t", width).collect()}
        for k, t, i in rows:
            j, n = bisect.bisect_right(of[k], t), bisect.bisect_left(of[k], t)
            assert last[i] == (of[k][j - 1] if j else None) and after[i] == (of[k][n] if n < len(of[k]) else None)


def test_reached_places(spark):
    jumps = [(1, i, i + 3) for i in range(0, 100)] + [(2, 0, 5), (2, 5, None)]
    got = asof.reached(spark.createDataFrame([(1, 0), (1, 7), (2, 0), (3, 4)], "k int, at long"), spark.createDataFrame(jumps, "k int, at long, to long"), ["k"]).collect()
    want = {(1, x) for x in [*range(0, 103, 3), *range(7, 103, 3)]} | {(2, 0), (2, 5), (3, 4)}
    assert {(r.k, r["at"]) for r in got} == want and len(got) == len(want)


def plain_limit(rows, limit, seconds):
    out, state = {}, {}
    for c, t, i in sorted(rows):
        began, n = state.get(c, (None, 0))
        if began is None or t - began >= seconds:
            began, n = t, 0
        ok = limit == 0 or n < limit
        state[c] = began, n + ok
        out[i] = (ok, 0.0 if ok else float(began + seconds - t))
    return out


def test_rate_limit_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randint(0, 3000), i) for i in range(1500)]
    d = spark.createDataFrame(rows, "client string, t long, request_id long").withColumn("created_at", F.timestamp_seconds("t"))
    for limit, seconds in ((2, 10), (0, 10), (3, 97)):
        got = {r.request_id: (r.allowed, r.retry_after) for r in stateful.rate_limit(d, limit, seconds).collect()}
        assert got == plain_limit(rows, limit, seconds)


def test_one_busy_client(spark):
    d = spark.range(60_000).select(F.lit("hot").alias("client"), F.col("id").alias("request_id"), F.timestamp_millis(F.col("id") * 100).alias("created_at"))
    r = stateful.rate_limit(d, 30, 60).agg(F.count("*").alias("n"), F.count_if("allowed").alias("ok")).first()
    assert r.n == 60_000 and r.ok == 30 * 100


def plain_paths(heads, places):
    out = {}
    for p in places:
        stack = []
        for at, level, text in heads:
            if at <= p:
                stack = [s for s in stack if s[0] < level] + [(level, text)]
        out[p] = [t for _, t in stack]
    return out


def test_section_paths_against_a_stack(spark):
    rng = random.Random(3)
    heads = {d: [(at, rng.choice([1, 2, 2, 3, 4, 7]), f"h{at}") for at in sorted(rng.sample(range(500), 40))] for d in (1, 2)}
    found = spark.createDataFrame([(d, i, level, text, at) for d, hs in heads.items() for i, (at, level, text) in enumerate(hs)], "doc_id long, line int, level int, heading string, char_start int")
    places = spark.createDataFrame([(d, p, "x") for d in (1, 2, 3) for p in range(0, 520, 13)], "doc_id long, char_start int, path string")
    got = {(r.doc_id, r.char_start): r.section_path for r in S.section_paths(places, found, bucket=64).collect()}
    for d in (1, 2, 3):
        want = plain_paths(heads.get(d, []), range(0, 520, 13))
        assert {p: x for (g, p), x in got.items() if g == d} == want
    assert S.section_paths(places, found.limit(0)).where("size(section_path) = 0").count() == places.count()


def test_document_of_very_many_headings(spark):
    n, began = 100_000, time.time()
    found = spark.range(n).selectExpr("1L as doc_id", "cast(id as int) as line", "cast(1 + id % 5 as int) as level", "concat('h', id) as heading", "cast(id * 20 as int) as char_start")
    places = spark.range(n).selectExpr("1L as doc_id", "cast(id * 20 + 7 as int) as char_start")
    r = S.section_paths(places, found).agg(F.count("*").alias("n"), F.sum(F.size("section_path")).alias("s"), F.max_by("section_path", "char_start").alias("last")).first()
    assert r.n == n and r.s == n * 3 and r.last == [f"h{n - 5 + i}" for i in range(5)]
    assert time.time() - began < 300
