"""Embeddings of whole tables: hash embedding, normal form, checks and upkeep."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.sources.streams import written


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(vectors: DataFrame, width: int, vector: str = "vector") -> DataFrame:
    """With unit = vector / length, or null and the reason in error: wrong width, null or zero (VEC5)."""
    n = norm(F.col(vector))
    error = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != width, "width").when(n.isNull() | F.isnan(n), "malformed").when(n == 0, "zero")
    out = vectors.withColumn("error", error)
    return out.withColumn("unit", F.when(F.col("error").isNull(), F.transform(vector, lambda x: x.cast("double") / n)))


#: Bytes of texts whose words are counted at once, or one text's.
PIECE = 4 << 20


def _sums(words: pa.Array, width: int) -> np.ndarray:
    """A row for each text of words between single spaces: the sums of its words' signs at their places."""
    lists = pc.split_pattern(words.cast("large_string"), " ")
    n = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    # The first 26 digits of a word's SHA-256: two places of eight, and a sign of two behind each.
    digests = [hashlib.sha256(w.encode()).digest() if w else b"" for w in coded.dictionary.to_pylist()]
    out = np.zeros((len(words), width))
    code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(words)), n)
    for at in (0, 8):
        place = np.array([int.from_bytes(d[at : at + 4], "big") % width if d else 0 for d in digests], "int64")
        sign = np.array([(-1.0 if d[at + 4] % 2 else 1.0) if d else 0.0 for d in digests])
        out += np.bincount(row * width + place[code], sign[code], len(words) * width).reshape(len(words), width)
    return out


def hash_embedding(texts: DataFrame, key: str, width: int) -> DataFrame:
    """key, vector: each token adds a sign to two places that its SHA-256 names, then length 1; texts without tokens: the first axis (VEC4). Words are summed within their text's task: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.binary_length(b.column(1)).to_numpy(), dtype="int64")
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PIECE, "right")))
                sums = _sums(b.column(1).slice(first, last - first), width)
                size = np.sqrt((sums * sums).sum(axis=1))
                unit = np.divide(sums, size[:, None], out=np.zeros_like(sums), where=size[:, None] > 0)
                unit[size == 0, 0] = 1.0
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, width), pa.int32()), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), vectors], [key, "vector"])
                first = last

    words = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return texts.select(key, words.alias("words")).mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, vector array<double>")


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """chunk_id, vector by the caller's model, `batch` texts a call; each text follows its breadcrumb (VEC6)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), batch):
                some = p.iloc[at : at + batch]
                yield pd.DataFrame({"chunk_id": some["chunk_id"].to_numpy(), "vector": [list(map(float, v)) for v in model(some["input"].tolist())]})

    told = F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat("breadcrumb", F.lit("\n"), "text")).otherwise(F.coalesce("text", F.lit("")))
    kind = dict(chunks.dtypes)["chunk_id"]
    return chunks.select("chunk_id", told.alias("input")).mapInPandas(run, f"chunk_id {kind}, vector array<double>")


def survey(chunks: DataFrame) -> DataFrame:
    """embedding_model, width, n (VEC10); null models are labelled."""
    return chunks.where("embedding is not null").groupBy(F.coalesce("embedding_model", F.lit("<null>")).alias("embedding_model"), F.size("embedding").alias("width")).agg(F.count("*").alias("n"))


def pending(chunks: DataFrame, model: str, width: int) -> DataFrame:
    """Rows that are not at the wanted model and width; null is not (VEC11)."""
    done = F.col("embedding_model").eqNullSafe(model) & F.when(F.col("embedding").isNotNull(), F.size("embedding")).eqNullSafe(width)
    return chunks.where(~done)


def reembed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], name: str, width: int) -> DataFrame:
    """All rows at the wanted model: pending ones are embedded, vector and label together; others pass unread by the model (VEC12)."""
    todo = pending(chunks, name, width)
    new = embed(todo, model).withColumnRenamed("vector", "new")
    return chunks.join(new, "chunk_id", "left").withColumn("embedding_model", F.when(F.col("new").isNotNull(), F.lit(name)).otherwise(F.col("embedding_model"))).withColumn(
        "embedding", F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("embedding").cast("array<double>"))
    ).drop("new")


def health(live: DataFrame, width: int) -> DataFrame:
    """One row: live_embedded, wrong_width (nulls are not), missing (VEC7, VEC8)."""
    has = F.col("embedding").isNotNull()
    return live.agg(F.count_if(has).alias("live_embedded"), F.count_if(has & (F.size("embedding") != width)).alias("wrong_width"), F.count_if(~has).alias("missing"))


#: Rows of a bucket whose digest is compared, about.
DIGESTED = 10_000


def digests(rows: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """bucket, n, x, s: the number of rows whose chunk_id falls into each bucket, and two sums of hashes over chunk_id and `columns` that equal rows have alike in any order. A pass without a shuffle of rows."""
    h = [F.xxhash64(F.lit(seed), "chunk_id", *[F.struct(F.col(c).isNull(), c) for c in columns]) for seed in (1, 2)]
    b = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).alias("bucket")
    return rows.select(b, *[x.alias(n) for x, n in zip(h, "xs", strict=True)]).groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.sum(F.col("s").cast("decimal(20, 0)")).alias("s"))


def _unequal(live: DataFrame, index: DataFrame, buckets: int, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides' rows of the buckets that differ, with their bucket, and the digests side by side. Where no bucket differs, neither side has rows and nothing is joined."""
    a, b = (digests(df, buckets, *columns) for df in (live, index))
    both = written(a.join(b.select("bucket", *[F.col(c).alias(f"{c}_of_index") for c in ("n", "x", "s")]), "bucket", "full_outer"), "digests")
    differ = both.where(~(F.col("n").eqNullSafe(F.col("n_of_index")) & F.col("x").eqNullSafe(F.col("x_of_index")) & F.col("s").eqNullSafe(F.col("s_of_index")))).select("bucket")
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets))
    if differ.isEmpty():
        sides = [df.limit(0) for df in (live, index)]
    else:
        sides = [df.withColumn("bucket", place).join(differ, "bucket", "left_semi").drop("bucket") for df in (live, index)]
    return sides[0], sides[1], both


def _buckets(live: DataFrame) -> int:
    return max(1, live.count() // DIGESTED)


def index_changes(live: DataFrame, index: DataFrame, buckets: int | None = None) -> DataFrame:
    """chunk_id, action: what makes a derived index equal to the live rows with vectors (SNK6): insert, update (another vector) or remove. Only rows of buckets whose digests differ are joined. live, index: chunk_id (once each), embedding."""
    have = live.where("embedding is not null").select("chunk_id", "embedding")
    a, b, _ = _unequal(have, index.select("chunk_id", "embedding"), buckets or _buckets(have), "embedding")
    j = a.withColumn("l", F.lit(True)).join(b.select("chunk_id", F.col("embedding").alias("other"), F.lit(True).alias("i")), "chunk_id", "full_outer")
    action = F.when(F.col("l").isNull(), "remove").when(F.col("i").isNull(), "insert").when(~F.col("embedding").eqNullSafe(F.col("other")), "update")
    return j.select("chunk_id", action.alias("action")).where("action is not null")


def divergence(live: DataFrame, index: DataFrame, width: int, buckets: int | None = None) -> DataFrame:
    """One row on a derived index against the table: counts, missing, stale and malformed ids, empty (VEC9). index: chunk_id, embedding. Ids are joined only where the digests of a bucket's ids differ."""
    have = live.where("embedding is not null").select("chunk_id")
    a, b, both = _unequal(have, index.select("chunk_id"), buckets or _buckets(have))
    j = a.withColumn("in_table", F.lit(True)).join(b.withColumn("in_index", F.lit(True)), "chunk_id", "full_outer")
    apart = j.agg(F.count_if(F.col("in_index").isNull()).alias("missing"), F.count_if(F.col("in_table").isNull()).alias("stale"))
    counts = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("table_count"), F.coalesce(F.sum("n_of_index"), F.lit(0)).alias("index_count"))
    bad = index.agg(F.count_if(F.size("embedding") != width).alias("malformed"))
    out = counts.crossJoin(apart).crossJoin(bad)  # one row each
    return out.select("table_count", "index_count", "missing", "stale", "malformed", ((F.col("index_count") == 0) & (F.col("table_count") > 0)).alias("empty"))


def verify(chunks: DataFrame, model: str, width: int) -> DataFrame:
    """One row: total, at_target, complete (VEC13)."""
    at = F.col("embedding_model").eqNullSafe(model) & (F.coalesce(F.size("embedding"), F.lit(-1)) == width)
    return chunks.agg(F.count("*").alias("total"), F.count_if(at).alias("at_target")).withColumn("complete", F.col("total") == F.col("at_target"))


def bad_width_purge(chunks: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, bad_chunks, at_risk, delete (VEC14): documents with vectors of a wrong width are deleted only if every one of them has
    a clean live copy: another document of its content_hash without such vectors. docs: doc_id, content_hash, state."""
    bad = chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") != width)).groupBy("doc_id").agg(F.count("*").alias("bad_chunks"))
    clean = docs.where("state = 'live'").join(bad.select("doc_id"), "doc_id", "left_anti").select("content_hash").distinct().withColumn("has_copy", F.lit(True))
    rows = bad.join(docs.select("doc_id", "content_hash"), "doc_id").join(clean, "content_hash", "left").select("doc_id", "bad_chunks", F.col("has_copy").isNull().alias("at_risk"))
    blocked = rows.agg(F.coalesce(F.bool_or("at_risk"), F.lit(False)).alias("blocked"))  # one row
    return rows.crossJoin(F.broadcast(blocked)).select("doc_id", "bad_chunks", "at_risk", (~F.col("blocked")).alias("delete"))


def index_sync(live: DataFrame, index: DataFrame) -> DataFrame:
    """chunk_id, action (SNK6): upsert live chunks with a vector, skip those without, remove what is in the index but not live."""
    j = live.select("chunk_id", F.lit(True).alias("l"), F.col("embedding").isNotNull().alias("has")).join(index.select("chunk_id", F.lit(True).alias("i")), "chunk_id", "full_outer")
    return j.select("chunk_id", F.when(F.col("l").isNull(), "remove").when(F.col("has"), "upsert").otherwise("skip").alias("action"))
