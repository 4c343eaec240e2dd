"""Query-log analytics: counts, gate metrics, review queue, dashboard panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.plans.quantiles import with_quantiles

HELPFUL, REFUSAL, UNANSWERED, TTFT_MS = 0.70, (0.10, 0.30), 0.15, 5000.0


def counts(log: DataFrame) -> DataFrame:
    """One row of pilot counts (LOG1)."""
    voted = F.col("feedback").isNotNull()
    return log.agg(
        F.count("*").alias("total"), F.countDistinct("original_query").alias("distinct_queries"), F.count_if("abstained").alias("abstained"),
        F.count_if(F.col("feedback") == "up").alias("up_votes"), F.count_if(F.col("feedback") == "down").alias("down_votes"),
        F.count("ttft_ms").alias("ttft_count"), F.countDistinct(F.when(voted, F.col("original_query"))).alias("voted_queries"),
    )


def gate_metrics(log: DataFrame, least: int = 20) -> DataFrame:
    """name, value, state, samples (LOG3): four rows from one aggregation."""
    c = with_quantiles(counts(log), log, [], F.col("ttft_ms"), {"p95": 0.95}, 12)
    votes = F.col("up_votes") + F.col("down_votes")
    helpful, refused = F.col("up_votes") / votes, F.col("abstained") / F.col("distinct_queries")
    state = lambda ok, enough: F.when(~enough, "unmeasured").when(ok, "pass").otherwise("fail")
    many = F.col("distinct_queries") >= least
    row = lambda name, value, s, n: F.struct(F.lit(name).alias("name"), F.round(value.cast("double"), 6).alias("value"), s.alias("state"), n.alias("samples"))
    rows = F.array(
        row("answered-helpfully", F.when(votes > 0, helpful), state(helpful >= HELPFUL, (votes > 0) & (F.col("voted_queries") >= least)), F.col("voted_queries")),
        row("refusal rate", F.when(many, refused), state(refused.between(*REFUSAL), many), F.col("distinct_queries")),
        row("unanswered-question rate", F.when(many, refused), state(refused <= UNANSWERED, many), F.col("distinct_queries")),
        row("TTFT p95", F.when(F.col("ttft_count") >= least, F.col("p95")), state(F.col("p95") <= TTFT_MS, F.col("ttft_count") >= least), F.col("ttft_count")),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*")


def review_queue(log: DataFrame, limit: int = 50, refusals_first: bool = True) -> DataFrame:
    """Refused or down-voted questions with their counts (LOG4; LOG5 with refusals_first=False)."""
    bad = log.where(F.col("abstained") | (F.col("feedback") == "down"))
    g = bad.groupBy("original_query").agg(F.count("*").alias("occurrences"), F.count_if("abstained").alias("refusals"), F.count_if(F.col("feedback") == "down").alias("down_votes"))
    first = F.col("refusals").desc() if refusals_first else F.col("refusals").asc()
    return g.orderBy(first, F.col("occurrences").desc(), "original_query").limit(limit)


@dataclass(frozen=True)
class Share:
    """A percentile of a column, where buckets() expects an aggregate."""

    column: Column
    share: float


def buckets(log: DataFrame, width: str, aggregates: dict[str, Column | Share], at: str = "created_at") -> DataFrame:
    """Time buckets with aggregates (DSH1 to DSH13)."""
    plain, shares = ({n: c for n, c in aggregates.items() if isinstance(c, Share) == of} for of in (False, True))
    log = log.withColumn("bucket", F.window(at, width).start)
    out = log.groupBy("bucket").agg(*[c.alias(n) for n, c in plain.items()]) if plain else log.select("bucket").distinct()
    # Percentiles of one column are found together.
    for value in {id(c.column): c.column for c in shares.values()}.values():
        out = with_quantiles(out, log, ["bucket"], value, {n: c.share for n, c in shares.items() if c.column is value})
    return out.where("bucket is not null").select("bucket", *aggregates)


def percentiles(column: str | Column, *shares: float) -> dict[str, Share]:
    of = F.col(column) if isinstance(column, str) else column
    return {f"p{round(100 * s)}": Share(of, s) for s in shares}


def feedback(log: DataFrame, events: DataFrame) -> DataFrame:
    """query_id, feedback: the last vote of each logged query; none clears it (LOG7). events: query_id, value, ts, event_id."""
    last = events.groupBy("query_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return log.select("query_id").join(last, "query_id", "left").select("query_id", F.coalesce("value", F.lit("none")).alias("feedback"))


STRONG, NOISE = 0.05, 1e-6


def gaps(runs: DataFrame) -> DataFrame:
    """query_id, gap, confidence (LOG6): why a question went unanswered, from the best scores of four retrievals.
    runs: query_id, abstained, open_top, keyword_top, vector_top; null scores are 0."""
    s = lambda c: F.coalesce(c, F.lit(0.0))
    o, k, v = s("open_top"), s("keyword_top"), s("vector_top")
    gap = (
        F.when(~F.col("abstained"), "answer_gap").when(o <= NOISE, "content_gap").when((k > NOISE) & (v <= NOISE), "lexical_gap")
        .when((v > NOISE) & (k <= NOISE), "semantic_gap").when(o >= STRONG, "threshold_gap").otherwise("ranking_gap")
    )
    return runs.select("query_id", gap.alias("gap"), F.when(gap == "ranking_gap", "low").otherwise("high").alias("confidence"))


def diagnoses(runs: DataFrame) -> DataFrame:
    """runs (as for `gaps`, with passed and threshold) with gap, confidence and the figures it rests on as text."""
    of = lambda c, n: F.format_string(f"%.{n}f", F.coalesce(c, F.lit(0.0)))
    says = {
        "answer_gap": F.concat(F.col("passed"), F.lit(" candidate(s) passed at threshold "), F.col("threshold")),
        "lexical_gap": F.concat(F.lit("keyword "), of("keyword_top", 4), F.lit(" vs vector "), of("vector_top", 6)),
        "semantic_gap": F.concat(F.lit("vector "), of("vector_top", 4), F.lit(" vs keyword "), of("keyword_top", 6)),
        "threshold_gap": F.concat(F.lit("best "), of("open_top", 4), F.lit(" with the gate removed vs threshold "), F.col("threshold")),
    }
    evidence = F.concat(F.lit("best score "), of("open_top", 6), F.lit(" with the gate removed"))
    for gap, text in says.items():
        evidence = F.when(F.col("gap") == gap, text).otherwise(evidence)
    return runs.join(gaps(runs), "query_id").withColumn("evidence", evidence)


def gap_counts(found: DataFrame) -> DataFrame:
    """gap, n: how many questions each class has."""
    return found.groupBy("gap").agg(F.count("*").alias("n"))


def load_summary(requests: DataFrame, by: list[str]) -> DataFrame:
    """One row, or one for each group (LOG8, LOG9): ok, failed, truncated, requests a second, TTFT of answered ones. requests: at, status, ttft_ms, answered."""
    ok = F.col("status") == "ok"
    span = F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))
    good = ok & F.col("answered")
    out = requests.groupBy(*by).agg(
        F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "truncated").alias("truncated"),
        F.round(F.when(span > 0, F.count("*") / (span / 1e6)), 6).alias("rps"), F.round(F.avg(F.when(good, F.col("ttft_ms"))), 6).alias("mean"), F.max(F.when(good, F.col("ttft_ms"))).alias("most"), F.count_if(good).alias("answered"),
    )
    return with_quantiles(out, requests.where(good), by, F.col("ttft_ms"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def stage_profile(log: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """stage, n, p50, p95, most, mean, over_budget for each stage with a budget; stages without a row count 0 (LOG10). log: timings (map of stage to ms)."""
    each = log.select(F.explode("timings").alias("stage", "ms"))
    t = each.groupBy("stage").agg(F.count("ms").alias("n"), F.max("ms").alias("most"), F.round(F.avg("ms"), 6).alias("mean"))
    t = with_quantiles(t, each, ["stage"], F.col("ms"), {"p50": 0.5, "p95": 0.95})
    b = log.sparkSession.createDataFrame([(k, float(v)) for k, v in budgets.items()], "stage string, budget double")
    return F.broadcast(b).join(t, "stage", "left").na.fill(0, ["n"]).select("stage", "n", "p50", "p95", "most", "mean", (F.col("p95") > F.col("budget")).alias("over_budget"))
