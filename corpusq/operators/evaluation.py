"""Retrieval and generation metrics over tables of questions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.sources.streams import written

RECALL, REFUSAL, NOISE = 0.85, (0.10, 0.30), 0.01
#: Smallest shares of kinds of questions in a dataset.
LEAST_SHARES = {"abstain": 0.20, "multiturn": 0.10, "identifier": 0.10}


def nearest_rank(values: DataFrame, by: list[str], column: str, share: float) -> DataFrame:
    """by, value: the element at floor(n * share) of the sorted values, counted from 0, the last at most (EV7)."""
    # Equal values are counted before the shuffle, so a group's window has one row for each distinct value.
    c = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    c = c.withColumn("upto", F.sum("c").over(w.orderBy(column))).withColumn("n", F.sum("c").over(w))
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return c.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*by, F.col(column).alias("value"))


def reference_id(text: Column) -> tuple[Column, Column]:
    """The code and number of a text's first reference of the form POL-ABC-123, else null (EV2)."""
    form = r"POL-([A-Z]{3})-(\d{3})"
    code = F.regexp_extract(text, form, 1)
    return F.when(code != "", code), F.when(code != "", F.regexp_extract(text, form, 2).cast("int"))


def class_shares(dataset: DataFrame) -> DataFrame:
    """category, n, share, enough (EV3)."""
    g = dataset.groupBy("category").agg(F.count("*").alias("n"))
    g = g.crossJoin(F.broadcast(dataset.agg(F.count("*").alias("total"))))  # one row
    least = F.create_map(*[x for k, v in LEAST_SHARES.items() for x in (F.lit(k), F.lit(v))])
    return g.select("category", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), (F.col("n") / F.col("total") >= F.coalesce(least[F.col("category")], F.lit(0.0))).alias("enough"))


def hit_ranks(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, rank of relevant candidates (EV4)."""
    return ranked.join(labels.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").select("query_id", "rank")


def outcomes(questions: DataFrame, hits: DataFrame, final: DataFrame) -> DataFrame:
    """query_id, category, expect_abstain, first_hit, abstained, correct (EV6): abstaining is right where it is expected, a relevant candidate elsewhere."""
    h = hits.groupBy("query_id").agg(F.min("rank").alias("first_hit"))
    f = final.select("query_id").distinct().withColumn("answered", F.lit(True))
    o = questions.join(h, "query_id", "left").join(f, "query_id", "left").withColumn("abstained", F.col("answered").isNull())
    right = F.when(F.col("expect_abstain"), F.col("abstained")).otherwise(F.col("first_hit").isNotNull())
    return o.select("query_id", "category", "expect_abstain", "first_hit", "abstained", right.alias("correct"))


def accuracy(done: DataFrame) -> DataFrame:
    """category, n, accuracy, refusal_rate (EV6)."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 9)
    return done.groupBy("category").agg(F.count("*").alias("n"), mean("correct").alias("accuracy"), mean("abstained").alias("refusal_rate"))


def failures(done: DataFrame) -> DataFrame:
    """One row: retrieval_gaps and returned_nothing among wrong answers to answerable questions (EV17)."""
    bad = ~F.col("correct") & ~F.col("expect_abstain")
    return done.agg(F.count_if(bad & ~F.col("abstained")).alias("retrieval_gaps"), F.count_if(bad & F.col("abstained")).alias("returned_nothing"))


def sweep(questions: DataFrame, found: DataFrame, labels: DataFrame, thresholds: list[float], depth: int = 10) -> DataFrame:
    """threshold, recall, refusal_rate, joint (EV9): retrieved once; only the gate differs. found: query_id, chunk_id, rank, best."""
    points = questions.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")  # the caller's short list
    top = found.groupBy("query_id").agg(F.min_by("best", "rank").alias("top_score"))
    hit = hit_ranks(found.where(F.col("rank") <= depth), labels).select("query_id").distinct().withColumn("hit", F.lit(True))
    q = questions.join(top, "query_id", "left").join(hit, "query_id", "left").crossJoin(F.broadcast(points))
    ok = F.coalesce(F.col("top_score") >= F.col("threshold"), F.lit(False))
    can = ~F.col("expect_abstain")
    g = q.groupBy("threshold").agg(F.avg(F.when(can, (ok & F.col("hit").isNotNull()).cast("double"))).alias("recall"), F.avg((~ok).cast("double")).alias("refusal_rate"))
    joint = (F.col("recall") >= RECALL) & F.col("refusal_rate").between(*REFUSAL)
    return g.select("threshold", F.round("recall", 9).alias("recall"), F.round("refusal_rate", 9).alias("refusal_rate"), F.coalesce(joint, F.lit(False)).alias("joint"))


def recommended(points: DataFrame) -> DataFrame:
    """One row: threshold with the best recall among joint points, the smallest of equals, else null; joint_points (EV10)."""
    j = F.col("joint")
    return points.agg(F.max_by(F.when(j, F.col("threshold")), F.when(j, F.struct(F.col("recall"), -F.col("threshold")))).alias("threshold"), F.count_if(j).alias("joint_points"))


def ablation(runs: DataFrame, base: str = "full") -> DataFrame:
    """config, recall, delta to the base configuration (EV8). runs: config, recall."""
    b = runs.where(F.col("config") == base).agg(F.first("recall").alias("b"))  # one row
    return runs.crossJoin(F.broadcast(b)).select("config", "recall", F.round(F.col("recall") - F.col("b"), 9).alias("delta"))


def snapshot_delta(points: DataFrame) -> DataFrame:
    """One row for each threshold of two consecutive snapshots (EV11): comparable (same size and dataset), recall_delta, moved, lost_joint, cause.
    points: seq, n, dataset, corpus, code, threshold, recall, joint."""
    w = Window.partitionBy("threshold").orderBy("seq")
    p = points.withColumn("b", F.lag(F.struct("n", "dataset", "corpus", "code", "recall", "joint")).over(w)).where("b is not null")
    same = (F.col("n") == F.col("b.n")) & (F.col("dataset") == F.col("b.dataset"))
    d = F.round(F.col("recall") - F.col("b.recall"), 9)
    moved = F.when(~same, "refused").when(d > NOISE, "improved").when(d < -NOISE, "regressed").otherwise("steady")
    cause = F.when(F.col("corpus") != F.col("b.corpus"), "corpus").when(F.col("code") != F.col("b.code"), "code").otherwise("none")
    return p.select("seq", "threshold", same.alias("comparable"), F.when(same, d).alias("recall_delta"), moved.alias("moved"), (same & F.col("b.joint") & ~F.col("joint")).alias("lost_joint"), cause.alias("cause"))


def trend(snapshots: DataFrame) -> DataFrame:
    """seq, recommended, recall, refusal_rate, joint_points of each snapshot at its recommended threshold (EV12). snapshots: seq, recommended, points."""
    p = snapshots.select("seq", F.explode("points").alias("p"))
    joint = p.groupBy("seq").agg(F.count_if("p.joint").alias("joint_points"))
    at = p.select("seq", F.col("p.threshold").alias("recommended"), "p.recall", "p.refusal_rate")
    return snapshots.select("seq", "recommended").join(at, ["seq", "recommended"], "left").join(joint, "seq", "left").na.fill(0, ["joint_points"])


def dataset_fingerprint(questions: DataFrame) -> DataFrame:
    """One row: n, fingerprint: 12 hex digits of the SHA-256 of the questions, one a line in order (EV13). A digest has an order, so one task reads the sorted rows, as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, first = hashlib.sha256(), 0, True
        for b in batches:
            n += b.num_rows
            for q in b.column(0).drop_null().to_pylist():
                h.update(("" if first else "\n").encode() + q.encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([h.hexdigest()[:12]])], ["n", "fingerprint"])

    q = questions.select("query_id", "query").repartition(1).sortWithinPartitions("query_id", "query")
    return q.select("query").mapInArrow(digest, "n long, fingerprint string")


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents (EV14)."""
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


def strategies(labels: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """strategy, chunks, mean_tokens, recall_1, recall_10, mrr, unlabelled (EV15). labels: strategy, query_id, chunk_id or null; ranked: the same with rank."""
    first = labels.join(ranked, ["strategy", "query_id", "chunk_id"], "left").groupBy("strategy", "query_id").agg(F.min("rank").alias("r"), F.count("chunk_id").alias("l"))
    can = F.col("l") > 0
    at = lambda k: F.round(F.avg(F.when(can, F.when(F.col("r") <= k, 1.0).otherwise(0.0))), 9).alias(f"recall_{k}")
    m = first.groupBy("strategy").agg(at(1), at(10), F.round(F.avg(F.when(can, F.coalesce(1 / F.col("r"), F.lit(0.0)))), 9).alias("mrr"), F.count_if(~can).alias("unlabelled"))
    return chunks.groupBy("strategy").agg(F.count("*").alias("chunks"), F.round(F.avg("token_count"), 9).alias("mean_tokens")).join(m, "strategy", "left")


def generation(answers: DataFrame) -> DataFrame:
    """category, n, groundedness_ref, groundedness_strict, resolvable_rate, strip_rate, refusal_rate (EV16).
    answers: query_id, category, expect_abstain, retrieved, abstained, emitted, stripped, supported (all sentences)."""
    g, can = ~F.col("abstained") & F.col("supported"), F.col("retrieved") & ~F.col("expect_abstain")
    share = lambda a, b: F.round(F.when(b > 0, a / b), 9)
    marks = F.sum("emitted") + F.sum("stripped")
    return answers.groupBy("category").agg(
        F.count("*").alias("n"), share(F.count_if(g), F.count_if(can)).alias("groundedness_ref"), share(F.count_if(g & can), F.count_if(can)).alias("groundedness_strict"),
        share(F.sum("emitted"), marks).alias("resolvable_rate"), share(F.sum("stripped"), marks).alias("strip_rate"), F.round(F.avg(F.col("abstained").cast("double")), 9).alias("refusal_rate"),
    )


def first_token_times(answers: DataFrame) -> DataFrame:
    """category, ttft_p50, ttft_p95 by nearest rank (EV16). answers: category, ttft_ms (null where no token came)."""
    at = lambda share, name: nearest_rank(answers, ["category"], "ttft_ms", share).withColumnRenamed("value", name)
    return at(0.5, "ttft_p50").join(at(0.95, "ttft_p95"), "category")


#: Characters of texts whose runs of words are hashed at once.
BLOCK = 4_000_000


def word_runs(texts: DataFrame, id_: str, sizes: list[int]) -> DataFrame:
    """id, size, key: a 64-bit hash for each run of so many words between single spaces, at each place of a text. texts: the id's column, text without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1).tolist(), b.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                words = [t.split(" ") for t in b.column("text").slice(first, last - first).to_pylist()]
                lengths = np.array([len(w) for w in words], dtype="int64")
                codes, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
                if not len(codes):
                    continue
                h = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes]
                text = np.repeat(np.arange(len(words)), lengths)
                left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(h))  # words from here to the text's end
                for n in sizes:
                    at = np.flatnonzero(left >= n)
                    mixed = np.zeros(len(at), "uint64")
                    for j in range(n):
                        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
                    ids = b.column(id_).slice(first, last - first).take(pa.array(text[at]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(at), n, "int32")), pa.array(mixed.view("int64"))], [id_, "size", "key"])

    return texts.select(id_, "text").mapInArrow(run, f"{id_} {dict(texts.dtypes)[id_]}, size int, key long")


#: Words of a probe.
PROBE = 6


def holding(queries: DataFrame, chunks: DataFrame, probe: int = PROBE, once: bool = False) -> DataFrame:
    """query_id, chunk_id of all chunks whose text holds the query's evidence, in any case of letters (EV1, JN6). queries: query_id, evidence.

    Evidence of three words or more is looked up by a run of up to `probe` whole words from its middle, which a text that holds it must have; only ids travel to
    that join, and texts come to its hits, where the whole is compared. Evidence of one or two words has no word that must be whole and is compared with all texts.
    once: the join's hits are written; while they are few, they are sent to the texts then, and no text is shuffled."""
    of = queries.select("query_id", F.lower("evidence").alias("evidence")).where("evidence is not null").withColumn("w", F.split("evidence", " ", -1))
    of = of.withColumn("size", F.least(F.size("w") - 2, F.lit(probe)))
    middle = F.slice("w", F.greatest(F.lit(2), F.floor((F.size("w") - F.col("size")) / 2).cast("int") + 1), F.col("size"))
    probes = of.where("size >= 1").select("query_id", "evidence", "size", F.array_join(middle, " ").alias("run"))
    text = chunks.where("text is not null").select("chunk_id", F.lower("text").alias("text"))
    sizes = [r[0] for r in probes.select("size").distinct().collect()]  # `probe` numbers at most
    short = text.join(of.where("size < 1").select("query_id", "evidence"), F.contains("text", "evidence")).select("query_id", "chunk_id")
    if not sizes:
        return short
    keys = word_runs(probes.select("query_id", F.col("run").alias("text")), "query_id", sizes).withColumnRenamed("size", "n")
    keys = keys.join(probes.select("query_id", "size"), "query_id").where("n = size").select("query_id", "key").distinct()
    met = word_runs(text, "chunk_id", sizes).join(F.broadcast(keys), "key").select("query_id", "chunk_id").distinct()
    asked = probes.select("query_id", "evidence")
    met = written(met, "met").join(text, "chunk_id").join(asked, "query_id") if once else met.join(asked, "query_id").join(text, "chunk_id")
    met = met.where(F.contains("text", "evidence"))
    return met.select("query_id", "chunk_id").unionByName(short)
