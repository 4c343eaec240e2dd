"""The registered queries of the library's own operators, and DuckDB SQL for each. Names start with the operator's name in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq import fixtures as X
from corpusq.functions import text as T
from corpusq.operators import access, dense, evaluation, index, keyword, lifecycle, ranking
from corpusq.plans import logs
from corpusq.sources import streams
from corpusq.sources.streams import written
from corpusq.streaming import alerts

QUERIES, SQL = {}, {}

_TOK = "list_filter(regexp_extract_all(lower({0}), '[A-Za-z0-9_]+'), lambda x: length(x) between 2 and 64)"
_COUNT = r"len(regexp_extract_all(text, '[\s\x0b\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'))".replace("{{", "{").replace("}}", "}")
CHUNKS = f"""starts as (select doc_id, coalesce(text, '') as whole, lang, source, unnest(range(0, greatest(length(coalesce(text, '')), 1), {X.STEP})) as s from documents),
    cut as (select doc_id * {X.MOST_CHUNKS} + s // {X.STEP} as chunk_id, doc_id, cast(s // {X.STEP} as integer) as chunk_index, substring(whole, s + 1, {X.WINDOW}) as text, lang, source from starts),
    chunks as (select *, {_COUNT} as token_count from cut)"""
WHOLE = f"chunks as (select doc_id as chunk_id, doc_id, text, lang, source, {_COUNT} as token_count from documents)"
ASKED = "queries as (select item_id as query_id, text as query, text as evidence from benchmark)"
_STATE = "case when doc_id % 10 <= 5 then 'live' when doc_id % 10 = 6 then 'disabled' when doc_id % 10 = 7 then 'failed' when doc_id % 10 = 8 then 'duplicate' else 'deleted' end"
REGISTRY = f"""registry as (select *, {_STATE} as state, timestamp '2024-01-01' + to_minutes(doc_id) as uploaded_at,
    case when doc_id % 10 <= 6 then timestamp '2024-01-01' + to_minutes(doc_id) + to_seconds(doc_id % 97) end as indexed_at from documents)"""
LOG = """log as (
    select event_id as query_id, ts as created_at, user_id as client, 'q' || (event_id % 60) as original_query, event_type = 'error' as abstained,
        case event_type when 'purchase' then 'up' when 'view' then 'down' end as feedback,
        case when event_type <> 'signup' then cast(floor(value * 20) as integer) end as ttft_ms,
        case when event_type <> 'signup' then cast(floor(value * 20) as integer) end + k as total_ms, k as tokens_in, k % 17 as tokens_out,
        case when day(ts) = 15 then 0 when day(ts) = 20 then 1 when k % 5 = 0 then 1 else 0 end as citations_stripped
    from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events))"""
_STOP = ", ".join(f"'{x}'" for x in T.QUERY_STOPWORDS)
POSTINGS = f"""places as (select chunk_id, unnest({_TOK.format('text')}) as term, generate_subscripts({_TOK.format('text')}, 1) as pos from chunks),
    counted as (select chunk_id, term, count(*) as term_count, min(pos) as first from places group by all),
    terms as (select chunk_id, term, term_count from counted qualify row_number() over (partition by chunk_id order by term_count desc, first) <= 2000)"""
_Q = f"list_filter({_TOK.format('query')}, lambda x: not list_contains([{_STOP}], x))"
GRAMS = f"""content as (select query_id, {_Q} as w from queries),
    asked as (
        select distinct query_id, unnest(list_concat(w,
            list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '_' || w[i + 1]),
            list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2]))) as term from content)"""
BM25 = """totals as (select (select count(distinct chunk_id) from terms) as n, (select case when avg(token_count) > 0 then avg(token_count) else 1.0 end from chunks) as avgdl),
    idf as (select term, greatest(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 0.0) as idf from terms, totals group by term, n),
    bm as (
        select query_id, chunk_id, round(sum(idf * term_count * 2.2 / (term_count + 1.2 * (1 - 0.75 + 0.75 * (case when token_count > 0 then token_count else 1 end) / avgdl))), 6) as score
        from asked join terms using (term) join idf using (term) join chunks using (chunk_id), totals group by all),
    keyword as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm qualify rank <= 40)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return index.search(X.index(spark, sf_dir), X.queries(spark, sf_dir), k)


def found(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    """The k best chunks of each query, searched once and written. Their size is known then: while they are few, what joins them sends them to the chunks and shuffles no text."""
    return written(_bm25(spark, sf_dir, k), "found")


def pool(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """Candidates with their texts and queries."""
    return ranked.join(X.chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").join(X.queries(spark, sf_dir).select("query_id", "query"), "query_id")


@query(f"with {CHUNKS} select chunk_id, token_count, len({_TOK.format('text')}) as n_tokens from chunks")
def txt4_txt5_tokens(spark, sf_dir):
    return X.chunks(spark, sf_dir).select("chunk_id", F.col("token_count").cast("long"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"with {CHUNKS}, {POSTINGS} select * from terms")
def kw1_postings(spark, sf_dir):
    return X.index(spark, sf_dir).postings.select("chunk_id", "term", F.col("term_count").cast("long"))


@query(f"""with {CHUNKS}, {ASKED}, {POSTINGS},
    q as (select distinct query_id, unnest({_TOK.format('query')}) as term from queries),
    s as (select query_id, chunk_id, cast(sum(term_count) as bigint) as score, string_agg(term, ',' order by term) as matched from q join terms using (term) group by all)
    select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from s qualify rank <= 50""")
def kw2_lookup(spark, sf_dir):
    return index.lookup(X.queries(spark, sf_dir), X.index(spark, sf_dir))


@query(f"with {ASKED}, {GRAMS} select query_id, term from asked")
def kw3_query_terms(spark, sf_dir):
    return X.queries(spark, sf_dir).select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))


@query(f"with {CHUNKS}, {POSTINGS}, {BM25.split('bm as')[0].rstrip().rstrip(',')} select term, count(*) as df, round(any_value(idf), 9) as idf from terms join idf using (term) group by term")
def kw4_statistics(spark, sf_dir):
    c = X.chunks(spark, sf_dir)
    return keyword.statistics(keyword.postings(c), c)[0].select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25} select query_id, chunk_id, score, cast(rank as integer) as rank from keyword where rank <= 10")
def kw5_bm25(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


@query("""with v as (select vec_id, list_transform(embedding, lambda c: cast(c as double)) as v from embeddings),
    s as (select q.vec_id as query_id, c.vec_id as chunk_id, round(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))
        / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(c.v, lambda x: x * x)))), 6) as score
        from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
    select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from s qualify rank <= 10""")
def vec2_cosine_top(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return dense.cosine_top(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id"), 10, 6, others=True)


@query(f"""with {CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25},
    q as (select distinct query_id, unnest({_TOK.format('query')}) as term from queries),
    l as (select query_id, chunk_id, sum(term_count) as s from q join terms using (term) group by all),
    lists as (select query_id, chunk_id, rank, 1.0::double as weight from keyword union all
        select query_id, chunk_id, row_number() over (partition by query_id order by s desc, chunk_id) as rank, 0.5::double from l qualify rank <= 40),
    f as (select query_id, chunk_id, round(sum(weight / (60 + rank)), 9) as score from lists group by all)
    select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from f""")
def rnk1_fusion(spark, sf_dir):
    lists = index.search_and_lookup(X.index(spark, sf_dir), X.queries(spark, sf_dir), 40)
    return ranking.fuse(lists.withColumn("weight", F.when(F.col("searched"), 1.0).otherwise(0.5)))


@query(f"""with {CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25},
    f as (select k.*, trim(regexp_replace(lower(substring(text, 1, 400)), '[^a-z0-9]+', ' ', 'g')) as fp from keyword k join chunks using (chunk_id)),
    n as (select *, row_number() over (partition by query_id, fp order by rank) as nth from f)
    select query_id, chunk_id, cast(rank as integer) as rank from n where nth = 1 or fp = ''""")
def rnk2_drop_duplicates(spark, sf_dir):
    c = X.chunks(spark, sf_dir).select("chunk_id", "text")
    return ranking.drop_duplicates(found(spark, sf_dir).join(c, "chunk_id")).select("query_id", "chunk_id", "rank")


@query(f"""with {CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25},
    q as (select query_id, {_Q} as w from queries),
    p as (select query_id, chunk_id, w, text from keyword join chunks using (chunk_id) join q using (query_id)),
    pos as (select query_id, chunk_id, w, unnest({_TOK.format('text')}) as term, generate_subscripts({_TOK.format('text')}, 1) as i from p),
    hit as (select query_id, chunk_id, i from pos where list_contains(w, term)),
    near as (select *, count(*) over (partition by query_id, chunk_id order by i range between 1 following and 5 following) as c from hit)
    select query_id, chunk_id, case when count(*) > 1 then round(least(1.0, sum(c) / (count(*) - 1)), 9) else 0.0 end as adjacency from near group by all""")
def rnk4_adjacency(spark, sf_dir):
    return ranking.near_positions(pool(spark, sf_dir, found(spark, sf_dir)))


@query(f"""with {CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25}, b as (select *, max(score) over (partition by query_id) as best from keyword)
    select query_id, chunk_id, score, cast(rank as integer) as rank from b join chunks using (chunk_id) where best >= 12 and token_count <= 2000""")
def rnk9_gate(spark, sf_dir):
    c = X.index(spark, sf_dir).rows.select("chunk_id", "token_count")  # the index has them: no text is read again
    return ranking.gate(found(spark, sf_dir).join(c, "chunk_id"), 12.0).select("query_id", "chunk_id", "score", "rank")


@query(f"""with recursive {CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25},
    r as (select query_id, chunk_id, rank, cast(case when token_count > 0 then token_count else greatest(1, length(text) // 4) end as bigint) as cost from keyword join chunks using (chunk_id)),
    fold as (
        select query_id, chunk_id, rank, cost, cost <= 3500 as kept, case when cost <= 3500 then cost else 0 end as used from r where rank = 1
        union all
        select r.query_id, r.chunk_id, r.rank, r.cost, f.used + r.cost <= 3500, f.used + case when f.used + r.cost <= 3500 then r.cost else 0 end
        from fold f join r on r.query_id = f.query_id and r.rank = f.rank + 1)
    select query_id, chunk_id, cast(rank as integer) as rank, cost from fold where kept""")
def rnk10_budget(spark, sf_dir):
    c = X.chunks(spark, sf_dir).select("chunk_id", "text", "token_count")
    return ranking.budget(found(spark, sf_dir).join(c, "chunk_id"))


@query(f"with {REGISTRY}, {CHUNKS} select chunk_id from chunks semi join (select doc_id from registry where state = 'live') l using (doc_id)")
def flt1_retrievable(spark, sf_dir):
    return access.live(X.chunks(spark, sf_dir), X.registry(spark, sf_dir)).select("chunk_id")


#: Queries with grants by number: none, one language, or a language and a source.
_GRANTS = "case query_id % 3 when 0 then {0} when 1 then {1} else {2} end"
_SEEN = f"""granted as (select *, {_GRANTS.format('[]', "['fr']", "['en', 'src3']")} as grants from queries),
    open as (select query_id, chunk_id from granted, lively where len(grants) = 0 or list_contains(grants, lang) or list_contains(grants, source))"""
_LIVE = f"{CHUNKS.replace('chunks as', 'every as')}, {REGISTRY}, chunks as (select every.* from every semi join (select doc_id from registry where state = 'live') l using (doc_id)), lively as (select * from chunks)"


def _granted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries with grants, and live chunks."""
    q = X.queries(spark, sf_dir).withColumn("grants", F.expr(_GRANTS.format("cast(array() as array<string>)", "array('fr')", "array('en', 'src3')")))
    return q, access.live(X.chunks(spark, sf_dir), X.registry(spark, sf_dir))


@query(f"""with {_LIVE}, {ASKED}, {_SEEN}, {POSTINGS}, {GRAMS}, {BM25.split('keyword as')[0].rstrip().rstrip(',')}
    select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank
    from bm semi join open using (query_id, chunk_id) qualify rank <= 10""")
def kw5_flt1_flt2_bm25(spark, sf_dir):
    q, c = _granted(spark, sf_dir)
    return index.search(X.index(spark, sf_dir, live=True), q, 10, c)


@query(f"""with {_LIVE}, {ASKED}, {_SEEN}, {POSTINGS},
    q as (select distinct query_id, unnest({_TOK.format('query')}) as term from queries),
    s as (select query_id, chunk_id, cast(sum(term_count) as bigint) as score, string_agg(term, ',' order by term) as matched from q join terms using (term) group by all)
    select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from s semi join open using (query_id, chunk_id) qualify rank <= 50""")
def kw2_flt1_flt2_lookup(spark, sf_dir):
    q, c = _granted(spark, sf_dir)
    return index.lookup(q, X.index(spark, sf_dir, live=True), 50, c)


@query(f"""with v as (select vec_id, list_transform(embedding, lambda c: cast(c as double)) as v, label, {_STATE.replace('doc_id', 'vec_id')} as state from embeddings),
    s as (select q.vec_id as query_id, c.vec_id as chunk_id, round(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))
        / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(c.v, lambda x: x * x)))), 6) as score
        from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and c.state = 'live' and (q.vec_id % 40 = 0 or c.label % 2 = 1))
    select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from s qualify rank <= 10""")
def vec2_flt1_flt2_cosine_top(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.array(F.when(F.col("label") % 2 == 1, "odd").otherwise("even")).alias("acl_tags"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector", F.expr("if(vec_id % 40 = 0, cast(array() as array<string>), array('odd'))").alias("grants"))
    registry = e.select(F.col("vec_id").alias("doc_id")).withColumn("state", F.expr(_STATE))
    c = access.live(e.withColumn("doc_id", F.col("vec_id")), registry).withColumnRenamed("vec_id", "chunk_id")
    return dense.cosine_top(q, c, 10, 6, others=True)


@query("select doc_id from documents where lang in ('fr', 'src3') or source in ('fr', 'src3')")
def flt2_access(spark, sf_dir):
    grants = F.array(F.lit("fr"), F.lit("src3"))
    return X.table(spark, sf_dir, "documents").where(access.permits(grants, F.array("lang", "source"))).select("doc_id")


@query("""with w as (select doc_id, text, unnest(range(0, length(text), 320)) as s from documents)
    select doc_id, cast(s // 320 as integer) as chunk_index, cast(s as integer) as char_start, substring(text, cast(s + 1 as bigint), 400) as text from w""")
def txt13_fixed_windows(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").where(F.length("text") > 0)
    w = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(320))).alias("char_start"))
    return w.select("doc_id", F.floor(F.col("char_start") / 320).cast("int").alias("chunk_index"), "char_start", F.expr("substring(text, char_start + 1, 400)").alias("text"))


@query("select sha256(text) as h, min(doc_id) as first, count(*) as copies from documents group by 1")
def dup3_copies(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))


@query(f"with {REGISTRY} select state, count(*) as documents, cast(sum(n_chars) as bigint) as bytes from registry group by state")
def lif8_dsh9_states(spark, sf_dir):
    return X.registry(spark, sf_dir).groupBy("state").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("bytes"))


@query("select conv_id, turn, role, cast(row_number() over (partition by conv_id order by turn) as integer) as nth from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 6)")
def cnv1_recent_turns(spark, sf_dir):
    return lifecycle.recent_turns(X.table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role", "nth")


@query("""select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as history
    from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 6) group by conv_id""")
def cnv2_history(spark, sf_dir):
    return lifecycle.history(X.table(spark, sf_dir, "conversations"))


@query("select conv_id, max(turn) + 1 as next_index from conversations group by conv_id")
def cnv4_next_turn(spark, sf_dir):
    return lifecycle.next_turn_index(X.table(spark, sf_dir, "conversations"))


_ANSWERS = "a as (select conv_id, turn, text || ' [' || (turn % 5) || ']' as text from conversations where role = 'assistant')"


@query(f"""with {_ANSWERS}, m as (select conv_id, turn, list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: cast(x as integer)) as m from a)
    select conv_id, turn, len(list_filter(m, lambda x: x between 1 and 3)) as valid, len(list_filter(m, lambda x: x not between 1 and 3)) as stripped from m""")
def cit2_markers(spark, sf_dir):
    a = X.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    a = a.select("conv_id", "turn", T.markers(F.concat("text", F.lit(" ["), F.col("turn") % 5, F.lit("]"))).alias("m"))
    count = lambda f: F.size(F.filter("m", f)).cast("long")
    return a.select("conv_id", "turn", count(lambda x: x.between(1, 3)).alias("valid"), count(lambda x: ~x.between(1, 3)).alias("stripped"))


@query(f"""with {CHUNKS}, {ASKED} select query_id, count(chunk_id) as relevant, min(chunk_id) as first
    from queries left join chunks on contains(lower(text), lower(evidence)) group by query_id""")
def ev1_labels(spark, sf_dir):
    q, c = X.queries(spark, sf_dir), X.chunks(spark, sf_dir)
    hits = evaluation.holding(q, c)
    return q.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("relevant"), F.min("chunk_id").alias("first")), "query_id", "left").na.fill(0, ["relevant"])


@query(f"""with {CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25},
    rel as (select query_id, chunk_id from queries join chunks on contains(lower(text), lower(evidence))),
    best as (select query_id, min(rank) as r from rel left join keyword using (query_id, chunk_id) group by query_id)
    select count(*) as questions, round(avg(case when r <= 1 then 1.0 else 0.0 end), 9) as recall_1, round(avg(case when r <= 5 then 1.0 else 0.0 end), 9) as recall_5,
        round(avg(case when r <= 10 then 1.0 else 0.0 end), 9) as recall_10, round(avg(case when r <= 10 then 1.0 / r else 0.0 end), 9) as mrr_10 from best""")
def ev5_recall(spark, sf_dir):
    q, c = X.queries(spark, sf_dir), X.chunks(spark, sf_dir)
    best = evaluation.holding(q, c).join(_bm25(spark, sf_dir, 10), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    at = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 9).alias(f"recall_{k}")
    return best.agg(F.count("*").alias("questions"), at(1), at(5), at(10), F.round(F.avg(F.when(F.col("r") <= 10, 1 / F.col("r")).otherwise(0.0)), 9).alias("mrr_10"))


@query(f"""with {LOG} select count(*) as total, count(distinct original_query) as distinct_queries, count(*) filter (abstained) as abstained, count(*) filter (feedback = 'up') as up_votes,
    count(*) filter (feedback = 'down') as down_votes, count(ttft_ms) as ttft_count, count(distinct case when feedback is not null then original_query end) as voted_queries from log""")
def log1_counts(spark, sf_dir):
    return logs.counts(X.query_log(spark, sf_dir))


@query(f"""with {LOG}, c as (select count(distinct original_query) as d, count(*) filter (abstained) as a, count(*) filter (feedback = 'up') as up, count(*) filter (feedback = 'down') as down,
        count(ttft_ms) as timed, count(distinct case when feedback is not null then original_query end) as voted, quantile_cont(ttft_ms, 0.95) as p95 from log)
    select 'answered-helpfully' as name, case when up + down > 0 then round(up / (up + down), 6) end as value, case when up + down = 0 or voted < 20 then 'unmeasured' when up / (up + down) >= 0.7 then 'pass' else 'fail' end as state, voted as samples from c
    union all select 'refusal rate', case when d >= 20 then round(a / d, 6) end, case when d < 20 then 'unmeasured' when a / d between 0.1 and 0.3 then 'pass' else 'fail' end, d from c
    union all select 'unanswered-question rate', case when d >= 20 then round(a / d, 6) end, case when d < 20 then 'unmeasured' when a / d <= 0.15 then 'pass' else 'fail' end, d from c
    union all select 'TTFT p95', case when timed >= 20 then round(p95, 6) end, case when timed < 20 then 'unmeasured' when p95 <= 5000 then 'pass' else 'fail' end, timed from c""")
def log3_gate(spark, sf_dir):
    return logs.gate_metrics(X.query_log(spark, sf_dir))


@query(f"""with {LOG} select original_query, count(*) as occurrences, count(*) filter (abstained) as refusals, count(*) filter (feedback = 'down') as down_votes
    from log where abstained or feedback = 'down' group by 1 order by refusals desc, occurrences desc, original_query limit 50""")
def log4_review(spark, sf_dir):
    return logs.review_queue(X.query_log(spark, sf_dir))


@query(f"""with {LOG} select original_query, count(*) as occurrences, count(*) filter (abstained) as refusals, count(*) filter (feedback = 'down') as down_votes
    from log where abstained or feedback = 'down' group by 1 order by refusals, occurrences desc, original_query limit 50""")
def log5_review_ascending(spark, sf_dir):
    return logs.review_queue(X.query_log(spark, sf_dir), refusals_first=False)


@query(f"""with {LOG}, f as (select event_id % 500 as query_id, case event_id % 3 when 0 then 'up' when 1 then 'down' else 'none' end as value, ts, event_id from events where event_type in ('click', 'view', 'purchase')),
    l as (select query_id, value from f qualify row_number() over (partition by query_id order by ts desc, event_id desc) = 1)
    select log.query_id, coalesce(value, 'none') as feedback from log left join l using (query_id)""")
def log7_feedback(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    e = e.select((F.col("event_id") % 500).alias("query_id"), F.expr("case event_id % 3 when 0 then 'up' when 1 then 'down' else 'none' end").alias("value"), "ts", "event_id")
    return logs.feedback(X.query_log(spark, sf_dir), e)


def _panel(name: str, width: str, columns: Callable[[], dict], sql: str, where: str = "true") -> None:
    def panel(spark, sf_dir):
        out = logs.buckets(X.query_log(spark, sf_dir).where(where), width, columns())
        return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))

    QUERIES[name] = panel
    n = int(width.split()[0]) * (1 if "minute" in width else 60)
    SQL[name] = f"with {LOG} select strftime(time_bucket(interval '{n} minutes', created_at), '%Y-%m-%d %H:%M:%S') as bucket, {sql} from log where {where} group by 1"


_panel("dsh1_ttft", "5 minutes", lambda: logs.percentiles("ttft_ms", 0.5, 0.95, 0.99), "round(quantile_cont(ttft_ms, 0.5), 6) as p50, round(quantile_cont(ttft_ms, 0.95), 6) as p95, round(quantile_cont(ttft_ms, 0.99), 6) as p99")
_panel("dsh2_refusals", "1 hour", lambda: {"rate": F.round(F.avg(F.col("abstained").cast("double")), 9)}, "round(avg(case when abstained then 1.0 else 0.0 end), 9) as rate")
_panel("dsh3_total", "5 minutes", lambda: logs.percentiles("total_ms", 0.5, 0.95), "round(quantile_cont(total_ms, 0.5), 6) as p50, round(quantile_cont(total_ms, 0.95), 6) as p95")
_panel("dsh4_refused_ttft", "5 minutes", lambda: logs.percentiles("ttft_ms", 0.5, 0.95), "round(quantile_cont(ttft_ms, 0.5), 6) as p50, round(quantile_cont(ttft_ms, 0.95), 6) as p95", "abstained")
_panel("dsh5_strip", "5 minutes", lambda: {"mean": F.round(F.avg("citations_stripped"), 9), "most": F.max("citations_stripped")}, "round(avg(citations_stripped), 9) as mean, max(citations_stripped) as most")
_panel("dsh6_votes", "15 minutes", lambda: {"up": F.round(F.avg(F.when(F.col("feedback") == "up", 1.0).when(F.col("feedback") == "down", 0.0)), 9)}, "round(avg(case feedback when 'up' then 1.0 when 'down' then 0.0 end), 9) as up")
_panel("dsh7_tokens", "1 minute", lambda: {"tokens_in": F.sum("tokens_in"), "tokens_out": F.sum("tokens_out")}, "cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out")
_panel("dsh8_volume", "1 minute", lambda: {"total": F.count("*"), "answered": F.count_if(~F.col("abstained"))}, "count(*) as total, count(*) filter (not abstained) as answered")


def _stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log as a stream over the events' files."""
    events = streams.read_stream(spark, f"{sf_dir}/event[s].parquet")  # a pattern: it may be a file or a folder
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("ts").cast("timestamp").alias("created_at"), F.expr("case when event_type <> 'signup' then cast(floor(value * 20) as int) end").alias("ttft_ms"),
        F.when(F.dayofmonth("ts") == 15, 0).when(F.dayofmonth("ts") == 20, 1).when(k % 5 == 0, 1).otherwise(0).alias("citations_stripped"),
    )


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


_AT = "strftime(time_bucket(interval '{0} minutes', created_at), '%Y-%m-%d %H:%M:%S') as bucket"
_P95 = f"""with {LOG}, w as (select {_AT.format(5)}, quantile_cont(ttft_ms, 0.95) as p from log where ttft_ms is not null group by 1)
    select bucket, round(p, 6) as p95, case when p > 5000 then 'critical' else 'warn' end as level from w where p > 4000"""
_SPIKE = f"""with {LOG}, w as (select {_AT.format(360)}, count(*) as n, avg(citations_stripped) as r from log group by 1) select bucket, n, round(r, 9) as strip_rate from w where n >= 20 and r > 0.2"""


@query(_P95)
def str1_ttft_alert_batch(spark, sf_dir):
    return _named(alerts.ttft_alert(X.query_log(spark, sf_dir)))


@query()
def str1_ttft_alert_stream(spark, sf_dir):
    return _named(streams.run_to_end(alerts.ttft_alert(_stream_log(spark, sf_dir))))


@query(f"with {LOG}, s as (select distinct time_bucket(interval '15 minutes', created_at) as b from log), a as (select unnest(generate_series(min(b), max(b), interval '15 minutes')) as b from s) select strftime(b, '%Y-%m-%d %H:%M:%S') as bucket from a anti join s using (b)")
def str2_silent_windows(spark, sf_dir):
    return _named(alerts.silent_windows(X.query_log(spark, sf_dir)))


@query(_SPIKE)
def str3_strip_spike_batch(spark, sf_dir):
    return _named(alerts.strip_rate_spike(X.query_log(spark, sf_dir)))


@query()
def str3_strip_spike_stream(spark, sf_dir):
    return _named(streams.run_to_end(alerts.strip_rate_spike(_stream_log(spark, sf_dir))))


@query(f"""with {LOG}, s as (select unnest(range(0, 48)) as i, created_at, citations_stripped from log),
    w as (select time_bucket(interval '30 minutes', created_at) - to_minutes(cast(30 * i as bigint)) as b, count(*) as n, avg(citations_stripped) as r from s group by 1)
    select strftime(b, '%Y-%m-%d %H:%M:%S') as bucket, n from w where n >= 50 and r = 0""")
def str4_strip_zero_batch(spark, sf_dir):
    return _named(alerts.strip_rate_zero(X.query_log(spark, sf_dir)))
