"""Answers: citations, assembly, support, extraction, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.functions.structure import strip
from corpusq.operators.chunking import sentences

LONGEST_HELD, COVERED = 4000, 0.8
#: What is answered where an answer is withheld.
REFUSALS = {
    "no_evidence": "I couldn't find anything in the documents I have access to that answers that. Try rephrasing, or check the sources below.",
    "ungrounded_answer": "I found documents that look related, but I couldn't ground an answer in them, so I'm not going to guess. The closest sources are below.",
    "store_unavailable": "Search is temporarily unavailable, so I can't answer right now. Please try again shortly.",
}


def tidy(text: Column) -> Column:
    """Without spaces before punctuation, doubled ones or ones at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"(?U)\s+([.,;:!?])", "$1"))


def validated(said: DataFrame) -> DataFrame:
    """said (sentence, passages: how many there are) with valid, stripped and text without invalid markers (CIT2)."""
    folded = T.fold_markers(F.col("sentence"))
    raw = F.regexp_extract_all(folded, F.lit(r"\[(\d+)\]"), F.lit(1))
    good = lambda x: x.cast("decimal(38,0)").between(F.lit(1), F.col("passages"))
    bad = F.array_distinct(F.filter(raw, lambda x: ~F.coalesce(good(x), F.lit(False))))
    text = F.aggregate(bad, folded, lambda t, x: F.replace(t, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    n = F.size(F.filter(raw, lambda x: F.coalesce(good(x), F.lit(False))))
    return said.withColumn("valid", n).withColumn("stripped", F.size(raw) - n).withColumn("text", tidy(text))


def totals(checked: DataFrame) -> DataFrame:
    """query_id, grounded, emitted, stripped (CIT3)."""
    return checked.groupBy("query_id").agg((F.sum("valid") > 0).alias("grounded"), F.sum("valid").alias("emitted"), F.sum("stripped").alias("stripped"))


def assembled(checked: DataFrame, longest: int = LONGEST_HELD) -> DataFrame:
    """query_id, answer, abstained, stripped (CIT4): sentences before the first citation are held; more than `longest` held characters are
    discarded; without any citation the refusal is the answer. checked: query_id, sent_idx, text, valid, stripped."""
    s = F.array_sort(F.collect_list(F.struct("sent_idx", "text", "valid")))
    g = checked.groupBy("query_id").agg(s.alias("s"), F.sum("stripped").alias("stripped"))
    fold = f"""aggregate(s, named_struct('out', '', 'held', '', 'n', 0, 'ok', false),
        (a, x) -> case
            when a.ok or x.valid > 0 then named_struct('out', concat_ws(' ', nullif(a.out, ''), nullif(a.held, ''), nullif(x.text, '')), 'held', '', 'n', 0, 'ok', true)
            when x.text = '' then a
            when a.n + length(x.text) > {longest} then named_struct('out', '', 'held', '', 'n', 0, 'ok', false)
            else named_struct('out', '', 'held', concat_ws(' ', nullif(a.held, ''), x.text), 'n', a.n + length(x.text), 'ok', false) end)"""
    out = g.select("query_id", F.expr(fold).alias("a"), "stripped")
    return out.select("query_id", F.when(F.col("a.ok"), F.col("a.out")).otherwise(REFUSALS["ungrounded_answer"]).alias("answer"), (~F.col("a.ok")).alias("abstained"), "stripped")


def sources(ranked: DataFrame) -> DataFrame:
    """query_id, sources: chunk ids numbered from 1 in rank order (CIT6)."""
    w = Window.partitionBy("query_id").orderBy("rank")
    r = ranked.withColumn("index", F.row_number().over(w))
    return r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "chunk_id"))).alias("sources"))


def supported(said: DataFrame, passages: DataFrame, least: float = COVERED) -> DataFrame:
    """key columns query_id, sent_idx with supported (CIT7): at least 80 % of a sentence's tokens occur in passages it cites; none: true.
    said: query_id, sent_idx, sentence; passages: query_id, index, text."""
    s = said.withColumn("cited", T.markers(F.col("sentence"))).withColumn("tok", T.tokens(F.regexp_replace(T.fold_markers(F.col("sentence")), r"\[\d+\]", "")))
    asked = s.select("query_id", "sent_idx", F.explode("tok").alias("term")).groupBy("query_id", "sent_idx", "term").agg(F.count("*").alias("n"))
    have = s.select("query_id", "sent_idx", F.explode(F.array_distinct("cited")).alias("index")).join(passages, ["query_id", "index"])
    have = have.select("query_id", "sent_idx", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct().withColumn("hit", F.lit(1))
    share = asked.join(have, ["query_id", "sent_idx", "term"], "left").groupBy("query_id", "sent_idx").agg((F.sum(F.col("n") * F.coalesce("hit", F.lit(0))) / F.sum("n")).alias("share"))
    return said.select("query_id", "sent_idx").join(share, ["query_id", "sent_idx"], "left").select("query_id", "sent_idx", F.coalesce(F.col("share") >= least, F.lit(True)).alias("supported"))


def extractive(queries: DataFrame, passages: DataFrame, most: int = 2) -> DataFrame:
    """query_id, answer (CIT8): the best sentence of each of the two passages that share most terms with the query, with their numbers; else no row."""
    q = queries.select("query_id", T.query_terms(F.col("query"), 1).alias("q"))
    shared = lambda t: F.size(F.array_intersect("q", T.tokens(t)))
    p = passages.join(q, "query_id").withColumn("n", shared(F.col("text"))).where("n > 0")
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), "index"))).where(F.col("r") <= most)
    p = p.withColumn("key", F.to_json(F.struct("query_id", "index", "r"))).select("key", "query_id", "r", "index", "q", "text")
    s = sentences(p, "key").join(p.drop("text"), "key").withColumn("n", shared(F.col("sentence")))
    best = s.groupBy("query_id", "r", "index").agg(F.max_by("sentence", F.struct("n", -F.col("sent_idx"))).alias("s"))
    part = F.concat("s", F.lit(" ["), "index", F.lit("]"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", part.alias("t")))), lambda x: x["t"]), " ").alias("answer"))


def prompts(ranked: DataFrame, longest: int | None = None) -> DataFrame:
    """query_id, prompt (TXT21): numbered passages in rank order, `&` and `<` escaped, cut with a mark. ranked: query_id, rank, text, breadcrumb."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    r = ranked.withColumn("n", n)
    origin = F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.concat(F.lit(' source="'), safe(F.col("breadcrumb")), F.lit('"'))).otherwise("")
    item = F.concat(F.lit('<passage n="'), "n", F.lit('"'), origin, F.lit(">\n"), safe(F.coalesce("text", F.lit(""))), F.lit("\n</passage>"))
    out = r.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("t")))), lambda x: x["t"]), "\n").alias("prompt"))
    if longest is None:
        return out
    return out.withColumn("prompt", F.when(F.length("prompt") > longest, F.concat(F.substring("prompt", 1, longest), F.lit("\n[context truncated]"))).otherwise(F.col("prompt")))


def token_totals(log: DataFrame) -> DataFrame:
    """query_id, tokens_in, tokens_out (CIT10). log: query_id, prompt, answer."""
    n = lambda c: F.size(T.tokens(F.coalesce(F.col(c), F.lit(""))))
    return log.select("query_id", n("prompt").alias("tokens_in"), n("answer").alias("tokens_out"))
