"""Fusion, duplicates, gate and budget over tables of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.operators.keyword import top
from corpusq.sources.streams import written


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion (RNK1). lists: query_id, chunk_id, rank, weight."""
    s = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w))


def drop_duplicates(ranked: DataFrame) -> DataFrame:
    """Keeps the best-ranked of candidates with one fingerprint; empty fingerprints all stay (RNK2)."""
    f = ranked.withColumn("fp", T.fingerprint(F.col("text")))
    w = Window.partitionBy("query_id", "fp").orderBy("rank")
    return f.withColumn("nth", F.row_number().over(w)).where("nth = 1 or fp = ''").drop("nth", "fp")


def gate(ranked: DataFrame, threshold: float, most_tokens: int = 2000) -> DataFrame:
    """Candidates of queries whose top score reaches the threshold, without oversized ones (RNK9)."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("best", F.first("score").over(w)).where((F.col("best") >= threshold) & (F.coalesce("token_count", F.lit(0)) <= most_tokens)).drop("best")


def budget(ranked: DataFrame, available: int = 3500) -> DataFrame:
    """In rank order, candidates that still fit; one that does not is skipped (RNK10)."""
    cost = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    items = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", cost.cast("long").alias("cost")))).alias("items"))
    fold = F.expr(
        f"""aggregate(items, named_struct('used', 0L, 'kept', filter(items, x -> false)),
            (a, x) -> if(a.used + x.cost <= {available}, named_struct('used', a.used + x.cost, 'kept', concat(a.kept, array(x))), a), a -> a.kept)"""
    )
    return items.select("query_id", F.explode(fold).alias("x")).select("query_id", "x.chunk_id", "x.rank", "x.cost")


def once(df: DataFrame, name: str) -> DataFrame:
    """df, with the column computed before what uses it: Spark would put its expression in every place that names it, inside of lambdas once for each element."""
    return df.withColumn(name, F.explode(F.array(name)))


def adjacent(positions: Column, distance: int = 5) -> Column:
    """Pairs of ascending positions at most `distance` apart, per position but one, at most 1."""
    moved = lambda d: F.transform(positions, lambda p: p + d)
    pairs = sum((F.size(F.array_intersect(positions, moved(d))) for d in range(1, distance + 1)), F.lit(0))
    return F.when(F.size(positions) > 1, F.least(F.lit(1.0), pairs / (F.size(positions) - 1))).otherwise(0.0)


def near_positions(pool: DataFrame, distance: int = 5) -> DataFrame:
    """query_id, chunk_id, adjacency: pairs of query-term places at most `distance` apart, per place but one, at most 1 (RNK4); only rows with such places. pool: query_id, query, chunk_id, text."""
    at = once(pool.select("query_id", "chunk_id", F.struct(T.query_terms(F.col("query"), 1).alias("q"), T.tokens(F.col("text")).alias("tok")).alias("x")), "x")
    places = F.filter(F.transform("x.tok", lambda t, i: F.when(F.array_contains("x.q", t), i)), lambda i: i.isNotNull())
    at = once(at.select("query_id", "chunk_id", places.alias("places")), "places").where(F.size("places") > 0)
    return at.select("query_id", "chunk_id", F.round(adjacent(F.col("places"), distance), 9).alias("adjacency"))
