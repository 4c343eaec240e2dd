"""Lexical rerank and the whole hybrid retrieval over tables of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusq.functions import text as T
from corpusq.operators import dense, index, ranking
from corpusq.sources.streams import written

#: Words that the rerank leaves out.
RERANK_STOPWORDS = "the a an of to in on for and or is are was were be been this that these those it its as at by with from not but".split()
COMMON = 0.90


def lexical_scores(pool: DataFrame) -> DataFrame:
    """query_id, chunk_id, score (RNK3): coverage of the query's terms weighted by rarity in the pool, adjacency, a mild preference for short texts.

    Terms in over 90 % of a pool do not count; if all are such, all count alike. pool: query_id, query, chunk_id, text."""
    q = F.array_distinct(F.filter(T.tokens(F.col("query")), lambda x: ~x.isin(RERANK_STOPWORDS)))
    p = pool.select("query_id", "chunk_id", q.alias("q"), T.tokens(F.col("text")).alias("tok"))
    sizes = p.groupBy("query_id").agg(F.count("*").alias("pool"), F.first("q").alias("q"))
    hit = p.select("query_id", "chunk_id", F.explode(F.array_intersect("q", "tok")).alias("term"))
    df = hit.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    w = sizes.select("query_id", "pool", F.explode("q").alias("term")).join(df, ["query_id", "term"], "left").na.fill(0, ["df"])
    w = w.withColumn("kept", F.col("df") / F.col("pool") <= COMMON).withColumn("any", F.bool_or("kept").over(Window.partitionBy("query_id")))
    w = w.where("kept or not any").select("query_id", "term", F.when(F.col("any"), F.log(1 + F.col("pool") / (1 + F.col("df")))).otherwise(1.0).alias("weight"))
    of_query = w.groupBy("query_id").agg(F.sum("weight").alias("all"), F.collect_set("term").alias("terms"))
    matched = hit.join(w, ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("matched"))
    # Places stay arrays in their row: no row for each token.
    places = F.filter(F.transform("tok", lambda t, i: F.when(F.array_contains("terms", t), i)), lambda i: i.isNotNull())
    rows = p.join(of_query, "query_id", "left").select("query_id", "chunk_id", "all", F.size("tok").alias("len"), places.alias("places"))
    rows = ranking.once(rows, "places").select("query_id", "chunk_id", "all", "len", F.coalesce(ranking.adjacent(F.col("places")), F.lit(0.0)).alias("adjacency"))
    rows = rows.join(matched, ["query_id", "chunk_id"], "left").na.fill(0.0, ["matched"])
    penalty = 1 / (1 + F.log1p(F.col("len") / 200))
    score = F.least(F.lit(1.0), F.col("matched") / F.col("all") * 0.8 + F.col("adjacency") * 0.2) * (0.6 + 0.4 * penalty)
    return rows.select("query_id", "chunk_id", F.round(F.when((F.col("len") == 0) | F.col("all").isNull(), 0.0).otherwise(score), 9).alias("score"))


def null_scores(pool: DataFrame) -> DataFrame:
    return pool.select("query_id", "chunk_id", F.lit(0.0).alias("score"))


def model_scores(pool: DataFrame, model: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """query_id, chunk_id, score by the caller's model of (query, text) (RNK7)."""

    @pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(model(query.tolist(), text.tolist()), dtype="float64")

    return pool.select("query_id", "chunk_id", score("query", "text").alias("score"))


def reranked(ranked: DataFrame, scores: DataFrame, depth: int = 40) -> DataFrame:
    """The first `depth` candidates with reranked and a new rank; ones without a score are dropped (RNK5). ranked: query_id, chunk_id, rank, ..."""
    r = ranked.where(F.col("rank") <= depth).join(scores.withColumnRenamed("score", "reranked"), ["query_id", "chunk_id"]).withColumnRenamed("rank", "fused_rank")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("reranked").desc(), "fused_rank")))


def scores_by_text(ranked: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, score for reranked() from a reranker that answers with texts (JN8): candidates of one text share its first hit's score; others have none.

    ranked: query_id, chunk_id, text; hits: query_id, position, text, score."""
    first = hits.groupBy("query_id", "text").agg(F.min_by("score", "position").alias("score"))
    return ranked.select("query_id", "chunk_id", "text").join(first, ["query_id", "text"]).select("query_id", "chunk_id", "score")


STAGES = ["reranked", "fused", "vector", "keyword"]


def best_score() -> Column:
    """The score of the last stage that gave one (RNK8)."""
    return F.coalesce(*STAGES)


def gating_stage() -> Column:
    out = F.when(F.col(STAGES[0]).isNotNull(), STAGES[0])
    for s in STAGES[1:]:
        out = out.when(F.col(s).isNotNull(), s)
    return out.otherwise("none")


@dataclass(frozen=True)
class Config:
    """What a retrieval does; the defaults are the production ones."""

    keyword: bool = True
    vector: bool = True
    rerank: bool = True
    fetch: int = 40
    depth: int = 40
    top: int = 8
    threshold: float = 0.0
    chunk_tokens: int = 2000
    available: int = 3500


def searches(queries: DataFrame, chunks: DataFrame, config: Config = Config(), kept: index.Index | None = None, embedded: DataFrame | None = None) -> dict[str, DataFrame]:
    """keyword, vector: the `fetch` best chunks of each query by each search that the configuration has (query_id, chunk_id, score, rank), written once. For arguments see candidates()."""
    lists, limited = {}, "grants" in queries.columns
    if config.keyword:
        lists["keyword"] = index.search(kept or index.build(chunks), queries, config.fetch, chunks if limited else None)
    if config.vector:
        have = chunks if embedded is None or limited else embedded
        have = have.where("vector is not null").select("chunk_id", "vector", *(["acl_tags"] if limited else []))
        lists["vector"] = dense.cosine_top(queries.where("vector is not null").select("query_id", "vector", *(["grants"] if limited else [])), have, config.fetch, 6)
    return {name: written(found, name) for name, found in lists.items()}


def texts_of(lists: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """chunk_id, text, token_count of the chunks in the lists, written: several runs over the same lists read them there. They grow with the queries, not with the chunks."""
    ids = None
    for found in lists.values():
        ids = found.select("chunk_id") if ids is None else ids.unionByName(found.select("chunk_id"))
    return written(chunks.select("chunk_id", "text", "token_count").join(written(ids.distinct(), "ids"), "chunk_id", "left_semi"), "texts")


def fused(lists: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, keyword, vector, fused, rank, text, token_count: the lists in one order without near duplicates, written. Its size is known before texts meet it: while candidates are few, they are sent to the chunks, and no text is shuffled for that."""
    found = None
    for name, df in lists.items():
        df = df.withColumn("stage", F.lit(name))
        found = df if found is None else found.unionByName(df)
    of = lambda s: F.max(F.when(F.col("stage") == s, F.col("score"))).alias(s)
    both = found.groupBy("query_id", "chunk_id").agg(of("keyword"), of("vector"), F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("fused"))
    both = written(both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "chunk_id"))), "fused")
    pool = both.join(chunks.select("chunk_id", "text", "token_count"), "chunk_id")
    return written(ranking.drop_duplicates(pool), "candidates")  # the rerank reads it several times


def rescored(pool: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:
    """The pool of fused() with reranked, best and stage."""
    if config.rerank:
        scores = lexical_scores(pool.where(F.col("rank") <= config.depth).join(queries.select("query_id", "query"), "query_id"))
        pool = reranked(pool, scores, config.depth).drop("fused_rank")
    else:
        pool = pool.withColumn("reranked", F.lit(None).cast("double"))
    return pool.withColumn("best", best_score()).withColumn("stage", gating_stage())


def candidates(queries: DataFrame, chunks: DataFrame, config: Config = Config(), kept: index.Index | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, keyword, vector, fused, reranked, rank, best: fused, without near duplicates, reranked; no gate yet.

    queries: query_id, query, vector (unused without the vector stage; queries without one are searched by keywords alone), and grants if access is limited; chunks: live ones, with chunk_id, text, token_count, vector, and then acl_tags.
    What a query may not see is left out of both searches before their best are taken. kept: an index over these chunks; one is built if it is needed and not given. embedded: chunk_id, vector of these chunks, if they have no vectors themselves; access must not be limited then."""
    return rescored(fused(searches(queries, chunks, config, kept, embedded), chunks), queries, config)


def gated(found: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidates that pass gate and budget, at most `top` for a query (RNK9 to RNK11)."""
    ok = ranking.gate(found.withColumnRenamed("best", "score"), config.threshold, config.chunk_tokens)
    kept = ranking.budget(ok, config.available).select("query_id", "chunk_id")
    kept = ok.join(kept, ["query_id", "chunk_id"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return kept.where(F.col("nth") <= config.top).select("query_id", "chunk_id", "score", F.col("nth").alias("rank"))


def results(queries: DataFrame, found: DataFrame, final: DataFrame, threshold: float) -> DataFrame:
    """One row for each query: stage counts, top score, abstained and why (RNK12)."""
    c = found.groupBy("query_id").agg(
        F.count("keyword").alias("keyword_n"), F.count("vector").alias("vector_n"), F.count("*").alias("candidates_n"), F.count("reranked").alias("reranked_n"),
        F.min_by("best", "rank").alias("top_score"),
    )
    f = final.groupBy("query_id").agg(F.count("*").alias("final_n"))
    r = queries.select("query_id").join(c, "query_id", "left").join(f, "query_id", "left").na.fill(0, ["keyword_n", "vector_n", "candidates_n", "reranked_n", "final_n"])
    reason = F.when(F.col("candidates_n") == 0, "no_candidates").when(F.col("top_score") < threshold, "below_threshold").when(F.col("final_n") == 0, "nothing_fits")
    return r.withColumn("reason", reason).withColumn("abstained", F.col("reason").isNotNull())


def retrieve(queries: DataFrame, chunks: DataFrame, config: Config = Config(), kept: index.Index | None = None, embedded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, one row for each query) of the whole retrieval (RNK13)."""
    found = written(candidates(queries, chunks, config, kept, embedded), "found")
    final = gated(found, config)
    return final, results(queries, found, final, config.threshold)


def gap_runs(queries: DataFrame, chunks: DataFrame, config: Config = Config(), fetch: int = 100, top: int = 50, kept: index.Index | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """query_id, abstained, passed, open_top, keyword_top, vector_top, threshold (LOG6): the production run of each query, and for those that it abstains
    from the best scores of three runs without threshold: whole, by keywords only, by vectors only. Answered ones have null there."""
    # Each search runs once, as deep as the deepest run needs it.
    lists = searches(queries, chunks, replace(config, keyword=True, vector=True, fetch=max(fetch, config.fetch)), kept, embedded)
    texts = texts_of(lists, chunks)
    of_run = lambda c, asked=None: {
        name: (found if asked is None else found.join(asked.select("query_id"), "query_id", "left_semi")).where(F.col("rank") <= c.fetch) for name, found in lists.items() if getattr(c, name)
    }
    found = written(rescored(fused(of_run(config), texts), queries, config), "found")
    final = gated(found, config)
    r = written(results(queries, found, final, config.threshold).select("query_id", "abstained", F.col("final_n").alias("passed")), "production")
    asked = written(queries.join(r.where("abstained").select("query_id"), "query_id", "left_semi"), "unanswered")
    wide = replace(config, threshold=0.0, fetch=fetch, top=top)
    for name, flags in {"open_top": {}, "keyword_top": {"vector": False}, "vector_top": {"keyword": False}}.items():
        run = replace(wide, **flags)
        best = gated(rescored(fused(of_run(run, asked), texts), asked, run), run).groupBy("query_id").agg(F.max("score").alias(name))
        r = r.join(best, "query_id", "left").withColumn(name, F.when(F.col("abstained"), F.coalesce(name, F.lit(0.0))))
    return r.withColumn("threshold", F.lit(config.threshold))
