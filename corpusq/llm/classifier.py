"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features: words are runs of letters and digits or runs of other signs, lower-cased, besides a mark for each
word's shape (capitals, digits, length). Single words, pairs of neighbours and shapes are hashed into 2^18
weights; a text's vector has the square root of each count, scaled to length 1. A score is the sparse dot
product of that vector with the weights, through the logistic function.

Training rows are a sample of at most about SAMPLE labelled rows, drawn by a hash of doc_id, so it is the same
in every run. They train one model in one task of bounded size; its weights (1 MB) are sent to all tasks.
Every document is scored over its whole text, in one pass without a shuffle.

Defined cases: null or empty text has no features and gets the score of the intercept; without labelled rows all
scores are 0.5; labels for unknown documents and null labels are ignored; a null doc_id is held out of training and
is not marked held_out; repeated rows give one output row per input row; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import small_batches

#: Labelled rows to train on, about; weights; passes over the sample.
SAMPLE, BITS, EPOCHS = 10_000, 18, 3
#: Follow-the-regularised-leader: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
#: Words that a worker remembers, and how long they may be.
REMEMBER, LONGEST = 250_000, 64

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Features:
    """Sparse vectors of texts; a worker remembers the hashes of words it has met."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, tuple[int, int]] = {}

    def _hash(self, w: str) -> tuple[int, int]:
        shape = ("A" if w.isupper() and len(w) > 1 else "a" if w.isalpha() else "0" if w.isalnum() else "#") + str(min(len(w), 20) // 2)
        out = xxhash.xxh64_intdigest(w.lower().encode("utf-8", "replace"), 7), xxhash.xxh64_intdigest(shape, 11)
        # What is remembered is bounded in bytes too.
        if len(w) <= LONGEST:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[w] = out
        return out

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _TOKEN.findall(text or "")
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        get, add = self.known.get, self._hash
        h = np.array([get(w) or add(w) for w in words], np.uint64)
        one, shape = h[:, 0], h[:, 1]
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(3))
        at = np.concatenate([one, two >> np.uint64(17), shape]) & self.mask
        at, n = np.unique(at.astype(np.int64), return_counts=True)
        x = np.sqrt(n)
        return at, x / np.sqrt((x * x).sum())


@functools.lru_cache(maxsize=1)
def features_of(bits: int) -> Features:
    return Features(bits)


class Leader:
    """Follow-the-regularised-leader for logistic loss; the last weight is the intercept, without penalties."""

    def __init__(self, bits: int):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0.0
        return w

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the model; the last one is the intercept."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    n = known.count()
    part = min(1.0, sample / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(part * (1 << 20)))
    # The sample's size is bounded by `sample`, so its ids may be broadcast; texts stay where they are.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality", "h")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features_of(bits)
        for b in batches:
            got = [f.of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))],
                ["doc_id", "quality", "h", "at", "x"],
            )

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        model = Leader(bits)
        # Rows that repeat a doc_id have an order of their own, so every run learns alike.
        df = df.sort_values(["doc_id", "h", "quality"], kind="stable")
        at, x, y = df["at"].tolist(), df["x"].tolist(), df["quality"].tolist()
        # Both labels weigh the same: the rarer one is shown more often.
        times = {v: max(1, round(len(y) / 2 / max(1, y.count(v)))) for v in (0, 1)}
        show = np.repeat(np.arange(len(y)), [times[v] for v in y])
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for i in rng.permutation(show).tolist():
                model.learn(np.asarray(at[i], np.int64), np.asarray(x[i], float), y[i])
        w = model.weights(np.arange(len(model.z)))
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()]})

    kind = dict(docs.dtypes)["doc_id"]
    got = rows.mapInArrow(vectors, f"doc_id {kind}, quality {dict(labels.dtypes)['quality']}, h long, at array<int>, x array<float>")
    model = got.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "w binary").collect()
    return np.frombuffer(bytes(model[0].w), "<f4").astype(float) if model else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with their score, in a column of that name."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w = features_of(bits), shared.value
        for b in batches:
            dots = []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                at, x = f.of(t)
                dots.append(w[at] @ x + w[-1])
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(dots), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, name])

    schema = docs.schema.fields
    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{name}` double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score threshold or more; docs may have a column named score itself."""
    name, taken = "score", {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return score(docs, weights, name).where(F.col(name) >= threshold).drop(name)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), train(docs, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
