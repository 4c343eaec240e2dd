"""Keyword index and BM25 for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.operators.access import permitted
from corpusq.sources.streams import written

MOST_TERMS = 2000


def postings(chunks: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """chunk_id, term, term_count: each chunk's most frequent terms, ties by first place (KW1)."""
    at = chunks.select("chunk_id", F.posexplode_outer(T.tokens(F.col("text"))).alias("pos", "term")).where("term is not null")
    counts = at.groupBy("chunk_id", "term").agg(F.count("*").alias("term_count"), F.min("pos").alias("first"))
    w = Window.partitionBy("chunk_id").orderBy(F.col("term_count").desc(), "first")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("chunk_id", "term", "term_count")


def statistics(terms: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n, avgdl) (KW4). Computed once for all queries."""
    totals = terms.agg(F.countDistinct("chunk_id").alias("n")).crossJoin(
        chunks.agg(F.avg("token_count").alias("a")).select(F.when(F.col("a") > 0, F.col("a")).otherwise(1.0).alias("avgdl"))
    )
    df = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))  # one row
    idf = F.greatest(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    return df.select("term", "df", idf.alias("idf")), totals


#: A text has a token if it matches; cheaper than cutting it into tokens.
HAS_TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{2,64}(?![A-Za-z0-9_])"


def asked_postings(chunks: DataFrame, asked: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """chunk_id, token_count, term, term_count of asked terms only: the rows that postings() has for them. Texts are read once; other terms end before they are shuffled."""
    wanted = asked.select("term").distinct()
    # A term takes two characters and what parts it from the next one: texts this short can't have more terms than are kept.
    short = F.length("text") <= 3 * most
    at = chunks.where(short).select("chunk_id", "token_count", F.explode(T.tokens(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    counts = at.groupBy("chunk_id", "token_count", "term").agg(F.count("*").alias("term_count"))
    long = postings(chunks.where(~short).select("chunk_id", "text"), most).join(wanted, "term", "left_semi")
    return counts.unionByName(long.join(chunks.where(~short).select("chunk_id", "token_count"), "chunk_id").select(*counts.columns))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank (KW5). queries: query_id, query, and grants if access is limited; chunks: chunk_id, text, token_count, and then acl_tags.

    Statistics are those of all chunks given (the live ones); what a query may not see goes before its best k are taken."""
    asked = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))
    terms = written(asked_postings(chunks, asked), "postings")
    has = F.count_if(F.lower("text").rlike(HAS_TOKEN)).alias("n")
    totals = chunks.agg(has, F.avg("token_count").alias("a")).select("n", F.when(F.col("a") > 0, F.col("a")).otherwise(1.0).alias("avgdl"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals))  # one row
    idf = F.greatest(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    hits = terms.join(df.select("term", idf.alias("idf"), "avgdl"), "term")
    length = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(1)
    tf = F.col("term_count")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avgdl")))
    # Weights are per posting; queries that share a term reuse them.
    scored = hits.select("term", "chunk_id", part.alias("part")).join(asked, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(permitted(scored, queries, chunks), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lookup(queries: DataFrame, terms: DataFrame, k: int = 50, chunks: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, matched, rank: sums of counts over distinct matched terms (KW2). terms: postings of live chunks; chunks: their acl_tags, if queries have grants."""
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    got = terms.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("term_count").alias("score"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("matched"))
    return top(got if chunks is None else permitted(got, queries, chunks), k)
