"""Queries of the operators on conversations, lifecycles, logs and streams, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import fixtures as X
from corpusq.operators import chunking, evaluation, ingest, intake, lifecycle
from corpusq.plans import logs
from corpusq.queries import _TOK, LOG, QUERIES, REGISTRY, SQL, _named, query
from corpusq.queries_text import _CLEAN, HEADINGS, PARAGRAPHS, SECTIONS, STRIP, WS, outlined
from corpusq.sources import streams
from corpusq.streaming import alerts, stateful


@query("""with u as (select * from conversations where role = 'user' qualify row_number() over (partition by conv_id order by turn desc) <= 10)
    select conv_id, string_agg(text, '|' order by turn) as questions from u group by conv_id""")
def cnv3_questions(spark, sf_dir):
    return lifecycle.question_history(X.table(spark, sf_dir, "conversations")).select("conv_id", F.array_join("questions", "|").alias("questions"))


_SQUEEZED = "trim(regexp_replace(t, '\\s+', ' ', 'g'))"


@query(f"""with g as (select conv_id, max(conv_id * 1000 + turn) as last_activity, count(*) as turns, coalesce(arg_min(text, turn) filter (role = 'user'), '') as t from conversations group by conv_id),
    p as (select *, {_SQUEEZED} as s, substring({_SQUEEZED}, 1, 72) as head from g)
    select conv_id, turns, case when length(s) <= 72 then s when contains(head, ' ') then regexp_replace(head, ' [^ ]*$', '') || '…' else head || '…' end as preview
    from p order by last_activity desc, conv_id limit 50 offset 5""")
def cnv5_list(spark, sf_dir):
    t = X.table(spark, sf_dir, "conversations").withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    return lifecycle.conversation_list(t, 50, 5).select("conv_id", "turns", "preview")


@query("select conv_id, string_agg(turn || role, ',' order by turn) as detail from conversations group by conv_id")
def cnv6_detail(spark, sf_dir):
    d = lifecycle.conversation_detail(X.table(spark, sf_dir, "conversations"))
    return d.select("conv_id", F.array_join(F.transform("detail", lambda x: F.concat(x["turn"], x["role"])), ",").alias("detail"))


@query("select conv_id, turn from conversations where conv_id % 4 <> 1")
def cnv7_deleted(spark, sf_dir):
    t = X.table(spark, sf_dir, "conversations")
    return lifecycle.without_conversations(t, t.where("conv_id % 4 = 1").select("conv_id").distinct()).select("conv_id", "turn")


@query("""with c as (select conv_id as doc_id, turn, encode(text) as t from conversations),
    h as (select doc_id, sha256(unhex(string_agg(lpad(printf('%x', octet_length(t)), 16, '0') || hex(t), '' order by turn))) as content_hash from c group by 1) select * from h""")
def dup1_content_hash(spark, sf_dir):
    return lifecycle.content_hash(X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text"))


@query(f"""with {REGISTRY}, r as (select doc_id, sha256(text) as h, state, uploaded_at from registry where doc_id % 3 <> 0), i as (select doc_id, sha256(text) as h from documents where doc_id % 2 = 0),
    j as (select i.doc_id, r.doc_id as other, state, row_number() over (partition by i.doc_id order by (r.doc_id is not distinct from i.doc_id) desc, (state is not distinct from 'live') desc, uploaded_at desc, r.doc_id desc) as n
        from i left join r using (h))
    select doc_id, case when other = doc_id and state = 'live' then 'same_document' when other = doc_id then 'newer_version' when state = 'live' then 'duplicate' else 'new' end as verdict,
        case when other = doc_id or state = 'live' then other end as existing from j where n = 1""")
def dup2_verdicts(spark, sf_dir):
    r = X.registry(spark, sf_dir).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    return lifecycle.verdicts(r.where("doc_id % 2 = 0"), r.where("doc_id % 3 <> 0").select("doc_id", "content_hash", "state", "uploaded_at"))


_STATES = ["pending", "extracting", "chunking", "embedding", "indexing", "live", "failed"]
STEPS = f"steps as (select user_id as doc_id, event_id as seq, ([{', '.join(repr(s) for s in _STATES)}])[1 + (row_number() over (partition by user_id order by event_id) - 1 + event_id % 2)::int % 7] as state, case when event_id % 3 > 0 then 'x' end as reason from events)"


def steps(spark, sf_dir):
    n = "row_number() over (partition by user_id order by event_id) - 1 + event_id % 2"
    names = ", ".join(repr(s) for s in _STATES)
    return X.table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id as seq", f"array({names})[cast(({n}) % 7 as int)] as state", "case when event_id % 3 > 0 then 'x' end as reason")


_LEGAL = ", ".join(f"'{a}>{b}'" for a, bs in lifecycle.TRANSITIONS.items() for b in bs)


@query(f"""with {STEPS}, b as (select *, lag(state) over (partition by doc_id order by seq) as before from steps)
    select doc_id, seq, before, state from b where not coalesce(before || '>' || state in ({_LEGAL}), state = 'pending') or (state = 'failed' and reason is null)""")
def lif1_illegal(spark, sf_dir):
    return lifecycle.illegal_transitions(steps(spark, sf_dir))


@query(f"with {STEPS} select doc_id, arg_max(state, seq) as state, case when arg_max(state, seq) = 'failed' then arg_max(coalesce(reason, ''), seq) end as error_reason from steps group by 1")
def lif2_current(spark, sf_dir):
    return lifecycle.current_state(steps(spark, sf_dir).na.fill("", ["reason"]))


@query()
def lif3_lifecycle_stream(spark, sf_dir):
    e = streams.read_stream(spark, f"{sf_dir}/event[s].parquet")
    names = ", ".join(repr(s) for s in _STATES)
    s = e.selectExpr("user_id as doc_id", "event_id as seq", f"array({names})[cast(event_id % 7 as int)] as state", "case when event_id % 3 > 0 then 'x' end as reason")
    return stateful_run(stateful.lifecycle_stream(s))


def stateful_run(out):
    spark = out.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return streams.run_to_end(out)


_ACT = "case event_id % 4 when 0 then 'disable' when 1 then 'enable' when 2 then 'supersede' else 'delete' end"


@query(f"""with recursive {REGISTRY}, a as (select event_id % 700 as doc_id, event_id as seq, {_ACT} as action, event_id % 50 as successor from events where event_id % 5 > 0),
    o as (select *, row_number() over (partition by doc_id order by seq) as n from a),
    f as (select doc_id, state, null::bigint as successor, 0::bigint as n from registry union all
        select f.doc_id, case when action = 'disable' and state = 'live' then 'disabled' when action = 'enable' and state = 'disabled' then 'live' when action = 'supersede' and state = 'live' then 'superseded'
            when action = 'delete' and state <> 'deleted' then 'deleted' else state end,
            case when action = 'supersede' and state = 'live' and o.successor <> f.doc_id then o.successor else f.successor end, o.n from f join o on o.doc_id = f.doc_id and o.n = f.n + 1)
    select doc_id, state, successor from f qualify row_number() over (partition by doc_id order by n desc) = 1""")
def lif4_admin(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").where("event_id % 5 > 0")
    a = e.selectExpr("event_id % 700 as doc_id", "event_id as seq", f"{_ACT} as action", "event_id % 50 as successor")
    return lifecycle.after_actions(X.registry(spark, sf_dir), a)


@query(f"""with {REGISTRY}, c as (select doc_id, doc_id % 10 as char_start, doc_id % 10 + 20 as char_end, substring(text, (doc_id % 10)::int + 1, 20 - (doc_id % 50 = 0)::int) as text, doc_id % 9 = 0 as bare, state, length(r.text) as whole, substring(r.text, (doc_id % 10)::int + 1, 20) as cut
        from registry r where doc_id % 8 > 0)
    select 'offset mismatch' as rule, count(*) filter (cut <> text) as violations from c union all select 'offset out of range', count(*) filter (char_end > whole) from c
    union all select 'missing vector', count(*) filter (state = 'live' and bare) from c union all select 'vector width', 0 from c group by 1
    union all select 'live without chunks', count(*) from registry where state = 'live' and doc_id % 8 = 0""")
def lif7_invariants(spark, sf_dir):
    r = X.registry(spark, sf_dir)
    c = r.where("doc_id % 8 > 0").selectExpr("doc_id", "doc_id as chunk_id", "cast(doc_id % 10 as int) as char_start", "cast(doc_id % 10 + 20 as int) as char_end",
        "substring(text, cast(doc_id % 10 as int) + 1, if(doc_id % 50 = 0, 19, 20)) as text", "if(doc_id % 9 = 0, null, array(1.0, 2.0)) as embedding")
    return lifecycle.invariants(r.select("doc_id", "text", "state"), c, 2)


REQUESTS = """requests as (select ts as came, case when event_id % 20 = 0 then 'failed' when event_id % 20 = 1 then 'truncated' else 'ok' end as status, cast(floor(value * 20) as integer) as ttft_ms, event_type <> 'error' as answered, event_id % 4 as vus from events)"""


def requests(spark, sf_dir):
    return X.table(spark, sf_dir, "events").selectExpr("cast(ts as timestamp) as at", "case when event_id % 20 = 0 then 'failed' when event_id % 20 = 1 then 'truncated' else 'ok' end as status",
        "cast(floor(value * 20) as int) as ttft_ms", "event_type <> 'error' as answered", "event_id % 4 as vus")


_LOAD = """count(*) filter (status = 'ok') as ok, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'truncated') as truncated, round(count(*) / ((epoch_us(max(came)) - epoch_us(min(came))) / 1e6), 6) as rps,
    round(quantile_cont(ttft_ms, 0.5) filter (status = 'ok' and answered), 6) as p50, round(quantile_cont(ttft_ms, 0.95) filter (status = 'ok' and answered), 6) as p95, round(quantile_cont(ttft_ms, 0.99) filter (status = 'ok' and answered), 6) as p99,
    round(avg(ttft_ms) filter (status = 'ok' and answered), 6) as mean, max(ttft_ms) filter (status = 'ok' and answered) as most, count(*) filter (status = 'ok' and answered) as answered"""


@query(f"with {REQUESTS} select {_LOAD} from requests")
def log2_log8_load(spark, sf_dir):
    return logs.load_summary(requests(spark, sf_dir), [])


@query(f"with {REQUESTS} select vus, {_LOAD} from requests group by vus")
def log9_saturation(spark, sf_dir):
    return logs.load_summary(requests(spark, sf_dir), ["vus"])


_RUNS = "event_type = 'error' as abstained, case when event_id % 7 = 0 then 0.0 else value / 200 end as open_top, case when event_id % 3 = 0 then null else value / 100 end as keyword_top, case when event_id % 5 = 0 then 0.0 else value / 300 end as vector_top"


@query(f"""with r as (select event_id as query_id, {_RUNS} from events),
    g as (select query_id, case when not abstained then 'answer_gap' when open_top <= 1e-6 then 'content_gap' when coalesce(keyword_top, 0) > 1e-6 and vector_top <= 1e-6 then 'lexical_gap'
        when vector_top > 1e-6 and coalesce(keyword_top, 0) <= 1e-6 then 'semantic_gap' when open_top >= 0.05 then 'threshold_gap' else 'ranking_gap' end as gap from r)
    select *, case when gap = 'ranking_gap' then 'low' else 'high' end as confidence from g""")
def log6_gaps(spark, sf_dir):
    return logs.gaps(X.table(spark, sf_dir, "events").selectExpr("event_id as query_id", *_scores()))


def _scores():
    return [f"{x} as {n}" for x, n in (("event_type = 'error'", "abstained"), ("case when event_id % 7 = 0 then 0D else value / 200 end", "open_top"),
        ("case when event_id % 3 = 0 then null else value / 100 end", "keyword_top"), ("case when event_id % 5 = 0 then 0D else value / 300 end", "vector_top"))]


@query(f"""with {LOG}, t as (select 'ttft' as stage, ttft_ms as ms from log union all select 'total', total_ms from log),
    b as (select * from (values ('ttft', 1500.0), ('total', 2500.0), ('rerank', 10.0)) v(stage, budget)),
    s as (select stage, count(ms) as n, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95, max(ms) as most, round(avg(ms), 6) as mean from t group by 1)
    select stage, coalesce(n, 0) as n, p50, p95, most, mean, p95 > budget as over_budget from b left join s using (stage)""")
def log10_stages(spark, sf_dir):
    log = X.query_log(spark, sf_dir).select(F.create_map(F.lit("ttft"), F.col("ttft_ms"), F.lit("total"), F.col("total_ms")).alias("timings"))
    return logs.stage_profile(log, {"ttft": 1500, "total": 2500, "rerank": 10})


_NEAREST = "list_sort(list({0}) filter ({0} is not null))[1 + least(cast(floor(count({0}) * 0.95) as bigint), count({0}) - 1)]"


@query(f"with {LOG} select abstained, {_NEAREST.format('ttft_ms')} as value from log group by 1")
def ev7_log11_latency(spark, sf_dir):
    return evaluation.nearest_rank(X.query_log(spark, sf_dir), ["abstained"], "ttft_ms", 0.95)


def _hourly(name, at, aggregates, sql, where="true"):
    def panel(spark, sf_dir):
        return _named(logs.buckets(X.registry(spark, sf_dir).where(where), "1 hour", aggregates(), at))

    QUERIES[name], panel.__module__ = panel, __name__
    SQL[name] = f"with {REGISTRY} select strftime(time_bucket(interval '1 hour', {at}), '%Y-%m-%d %H:%M:%S') as bucket, {sql} from registry where {where} group by 1"


_hourly("dsh10_failures", "uploaded_at", lambda: {"rate": F.round(F.avg((F.col("state") == "failed").cast("double")), 9)}, "round(avg(case when state = 'failed' then 1.0 else 0.0 end), 9) as rate")
_hourly("dsh11_indexed", "indexed_at", lambda: {"documents": F.count("*"), "bytes": F.sum("n_chars")}, "count(*) as documents, cast(sum(n_chars) as bigint) as bytes", "indexed_at is not null")
_hourly(
    "dsh12_latency", "uploaded_at",
    lambda: logs.percentiles((F.unix_micros("indexed_at") - F.unix_micros("uploaded_at")) / 1e6, 0.5, 0.95),
    "round(quantile_cont((epoch_us(indexed_at) - epoch_us(uploaded_at)) / 1e6, 0.5), 6) as p50, round(quantile_cont((epoch_us(indexed_at) - epoch_us(uploaded_at)) / 1e6, 0.95), 6) as p95", "indexed_at is not null",
)


@query(f"""with {REGISTRY}, c as (select doc_id, len(regexp_extract_all(text, '\\s+')) as token_count from documents)
    select strftime(time_bucket(interval '1 hour', uploaded_at), '%Y-%m-%d %H:%M:%S') as bucket, count(*) as chunks, round(avg(token_count), 6) as mean_tokens from registry join c using (doc_id) group by 1""")
def dsh13_chunks(spark, sf_dir):
    c = X.whole(spark, sf_dir).select("doc_id", "token_count").join(X.registry(spark, sf_dir).select("doc_id", "uploaded_at"), "doc_id")
    return _named(logs.buckets(c, "1 hour", {"chunks": F.count("*"), "mean_tokens": F.round(F.avg("token_count"), 6)}, "uploaded_at"))


@query(f"with {REGISTRY} select doc_id from registry where state = 'failed' order by uploaded_at desc, doc_id limit 25")
def dsh14_recent_failures(spark, sf_dir):
    return X.registry(spark, sf_dir).where("state = 'failed'").orderBy(F.col("uploaded_at").desc(), "doc_id").limit(25).select("doc_id")


@query(f"""with {LOG}, w as (select time_bucket(interval '1 hour', created_at) as b from log group by 1 having avg(citations_stripped) > 0.2), l as (select b, lag(b, 2) over (order by b) as first from w)
    select strftime(b, '%Y-%m-%d %H:%M:%S') as bucket from l where first = b - interval 2 hours""")
def str5_held(spark, sf_dir):
    w = alerts.strip_rate_spike(X.query_log(spark, sf_dir), "1 hour", 1)
    return _named(alerts.held(w.select("bucket"), "1 hour", 3))


@query(f"""with recursive r as (select event_id as request_id, user_id as client, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
    f as (select request_id, client, t, i, t as began, 1 as n from r where i = 1 union all
        select r.request_id, r.client, r.t, r.i, case when r.t - f.began >= 86400000000 then r.t else f.began end, case when r.t - f.began >= 86400000000 then 1 else f.n + 1 end from f join r on r.client = f.client and r.i = f.i + 1)
    select request_id, 'c' || client as client, n <= 2 as allowed, round(case when n <= 2 then 0.0 else (began + 86400000000 - t) / 1e6 end, 6) as retry_after from f""")
def str6_rate_limit(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("c"), "user_id").alias("client"), F.col("ts").cast("timestamp").alias("created_at"))
    return stateful.rate_limit(e, 2, 86_400).withColumn("retry_after", F.round("retry_after", 6))


@query(SQL["str6_rate_limit"])
def str6_rate_limit_stream(spark, sf_dir):
    e = streams.read_stream(spark, f"{sf_dir}/event[s].parquet")
    e = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("c"), "user_id").alias("client"), F.col("ts").cast("timestamp").alias("created_at"))
    return stateful_run(stateful.rate_limit_stream(e, 2, 86_400)).withColumn("retry_after", F.round("retry_after", 6))


@query("select count(distinct event_id % 900) as deliveries from events")
def dup4_redelivery_stream(spark, sf_dir):
    e = streams.read_stream(spark, f"{sf_dir}/event[s].parquet").select((F.col("event_id") % 900).alias("doc_id"), F.col("ts").cast("timestamp").alias("created_at"))
    return streams.run_to_end(stateful.deliveries(e, "400 days")).agg(F.count("*").alias("deliveries"))


@query()
def str8_feedback_stream(spark, sf_dir):
    e = streams.read_stream(spark, f"{sf_dir}/event[s].parquet")
    log = e.select(F.col("event_id").alias("query_id"), F.col("ts").cast("timestamp").alias("created_at"))
    votes = e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("query_id"), F.col("ts").cast("timestamp").alias("voted_at"))
    return streams.run_to_end(stateful.with_feedback(log, votes))


@query("select count(*) as documents, cast(sum(case when page_id % 2 = 0 then 1 else 0 end) as bigint) as accepted from pages")
def src6_ingest_stream(spark, sf_dir):
    u = streams.read_stream(spark, f"{sf_dir}/page[s].parquet")
    out = streams.shared_path(spark, "ingest")
    admit = lambda df: intake.admit_uploads(df.select("page_id", F.expr("concat('p', page_id, if(page_id % 2 = 0, '.html', '.exe'))").alias("raw_name"), F.lit(1).alias("size")))
    stateful.ingest(u, admit, out, streams.shared_path(spark, "state"))
    return spark.read.parquet(out).agg(F.count("*").alias("documents"), F.count_if(F.col("error").isNull()).alias("accepted"))


@query()
def cit9_answer_stream(spark, sf_dir):
    of = "role = 'assistant'"
    last = X.table(spark, sf_dir, "conversations").where(of).groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = streams.read_stream(spark, f"{sf_dir}/conversation[s].parquet").where(of).join(last, "conv_id")
    return stateful_run(stateful.answer_sentences(c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.col("text").alias("delta"), (F.col("turn") == F.col("last")).alias("done"))))


def answer_deltas(spark, sf_dir):
    """A stream of answers, a turn of the assistant at a time, each with a citation of passage turn % 5 of 3."""
    of = "role = 'assistant'"
    last = X.table(spark, sf_dir, "conversations").where(of).groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = streams.read_stream(spark, f"{sf_dir}/conversation[s].parquet").where(of).join(last, "conv_id")
    delta = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("turn") % 5, F.lit("]. "))
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), delta.alias("delta"), (F.col("turn") == F.col("last")).alias("done"), F.lit(3).alias("passages"))


@query("""with a as (select conv_id as query_id, turn % 5 between 1 and 3 as good from conversations where role = 'assistant')
    select query_id, case when bool_or(good) then 'citation_warning' else 'refusal' end as kind, cast(count(*) filter (not good) as integer) as stripped
    from a group by 1 having bool_or(not good)""")
def cit9_answer_ends_stream(spark, sf_dir):
    """What each streamed answer with a bad citation ends with."""
    return stateful_run(stateful.answer_parts(answer_deltas(spark, sf_dir))).where("kind <> 'token'").select("query_id", "kind", "stripped")


@query()
def cit9_answer_parts_stream(spark, sf_dir):
    return stateful_run(stateful.answer_parts(answer_deltas(spark, sf_dir)))


def _arriving(rows, part, parts: int):
    """Calls back with a stream over a folder after each part of the rows has come into it."""
    spark, folder = rows.sparkSession, streams.shared_path(rows.sparkSession, "arriving")
    for i in range(parts):
        rows.where(F.expr(part) == i).write.mode("append").parquet(folder)
        yield streams.read_stream(spark, folder)


_PART = "least(3, (day(ts) - 1) div 8 + if(event_id % 10 = 0, 1, 0))"


@query(f"""with p as (select event_id as query_id, ts, {_PART.replace('div', '//').replace('if(event_id % 10 = 0, 1, 0)', 'case when event_id % 10 = 0 then 1 else 0 end')} as part from events),
    m as (select part, max(ts) as latest from p group by 1), h as (select p.part, max(m.latest) - interval 2 days as horizon from (select distinct part from p) p left join m on m.part < p.part group by 1)
    select query_id, coalesce(ts < horizon, false) as late from p join h using (part)""")
def str7_late_rows_stream(spark, sf_dir):
    """The log comes in four parts of eight days; every tenth row comes with the part after its own."""
    e = X.table(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp"))
    out, state = streams.shared_path(spark, "log"), streams.shared_path(spark, "state")
    for s in _arriving(e, _PART, 4):
        stateful.ingest_log(s.select(F.col("event_id").alias("query_id"), "created_at"), out, state, "2 days")
    return spark.read.parquet(f"{out}/rows").select("query_id", F.col("late").cast("boolean").alias("late"))


def uploads_in_two(spark, sf_dir):
    """All pages as uploads; every tenth of the first half comes again with the second."""
    p = X.table(spark, sf_dir, "pages")
    again = p.where("page_id % 20 = 0").withColumn("part", F.lit(1))
    both = p.withColumn("part", (F.col("page_id") % 2).cast("int")).unionByName(again)
    name = F.format_string("p%d.%s", "page_id", F.when(F.col("page_id") % 7 == 0, "exe").otherwise("html"))
    for s in _arriving(both, "part", 2):
        yield intake.html_text(s).select(F.col("page_id").alias("doc_id"), name.alias("filename"), "text", F.timestamp_seconds("page_id").alias("uploaded_at"))


# Text nodes of the pages (TXT1), with the character references that they have.
_PAGE_TEXTS = "html"
for _t in ("script", "style", "nav", "header", "footer", "aside", "noscript"):
    _PAGE_TEXTS = rf"regexp_replace({_PAGE_TEXTS}, '(?is)<{_t}(\s[^>]*)?>.*?(</{_t}\s*>|$)', '<>', 'g')"
_PAGE_TEXTS = rf"list_filter(string_split_regex(regexp_replace(coalesce({_PAGE_TEXTS}, ''), '(?s)<!--.*?-->', '<>', 'g'), '<[^>]*(>|$)'), lambda x: x <> '')"
for _t, _c in (("quot", 34), ("copy", 169), ("middot", 183), ("lt", 60), ("gt", 62), ("amp", 38)):
    _PAGE_TEXTS = f"list_transform({_PAGE_TEXTS}, lambda x: regexp_replace(x, '&{_t};?', chr({_c}), 'g'))"
# TXT14's fold of units into windows, and a document's content: the texts of its chunks in order (DUP1).
_FOLD = f"""units as (select *, row_number() over (partition by doc_id order by char_start, char_end, token_count) as i from (
        select doc_id, char_start, char_end, cast(len(regexp_extract_all(part, '{WS}+')) as integer) as token_count from secs where {STRIP.format('part')} <> ''
        union all select * from paragraphs where doc_id not in (select doc_id from heads))),
    fold as (select doc_id, 0::bigint as i, null::integer as s, 0 as e, 0 as t, []::struct(s integer, e integer)[] as done from docs union all
        select f.doc_id, u.i, case when f.s is null then u.char_start when u.token_count > 120 then null when f.t + u.token_count > 120 then f.back else f.s end,
            case when f.s is not null and u.token_count > 120 then 0 else u.char_end end,
            case when f.s is null then u.token_count when u.token_count > 120 then 0
                when f.t + u.token_count > 120 then u.token_count + cast(len(regexp_extract_all(substring(d.text, f.back + 1, f.e - f.back), '{WS}+')) as integer) else f.t + u.token_count end,
            case when f.s is null then done when u.token_count > 120 then list_concat(done, [{{'s': f.s, 'e': f.e}}, {{'s': u.char_start, 'e': u.char_end}}])
                when f.t + u.token_count > 120 then list_append(done, {{'s': f.s, 'e': f.e}}) else done end
        from (select *, greatest(s, e - cast(floor((e - s) * (24::double / 120)) as integer)) as back from fold) f join units u on u.doc_id = f.doc_id and u.i = f.i + 1 join docs d on d.doc_id = f.doc_id),
    cuts_of as (select doc_id, unnest(case when s is null then done else list_append(done, {{'s': s, 'e': e}}) end) as w, generate_subscripts(case when s is null then done else list_append(done, {{'s': s, 'e': e}}) end, 1) as n
        from (select * from fold qualify row_number() over (partition by doc_id order by i desc) = 1)),
    pieces as (select doc_id, n, substring(text, w.s + 1, w.e - w.s) as part from cuts_of join docs using (doc_id)),
    contents as (select doc_id, list(part order by n) as content, bool_or(len({_TOK.format('part')}) > 0) as has_terms from pieces where len(regexp_extract_all(part, '{WS}+')) >= 8 group by 1)"""
# Even pages come first, then odd ones and every twentieth again. Of equal contents the first upload of its batch stays, unless an earlier batch's is live; a copy
# that comes again is its own newer version. Of live ones a later delivery changes nothing.
_INGESTED = f"""d as (select page_id as doc_id, 'p' || page_id || case when page_id % 7 = 0 then '.exe' else '.html' end as filename, nfc_normalize(array_to_string({_PAGE_TEXTS}, chr(10))) as t from pages),
    {_CLEAN.split(chr(10), 1)[1]}, docs as (select doc_id, text from why where error_reason is null), {HEADINGS}, {PARAGRAPHS}, {SECTIONS}, {_FOLD},
    known as (select w.doc_id, coalesce(w.error_reason, case when content is null then 'no chunks' end) as reason, content, has_terms from why w left join contents c using (doc_id)),
    one as (select *, min(doc_id) over (partition by content) as first from known where reason is null and doc_id % 2 = 0),
    two as (select k.*, o.first as earlier from known k left join (select distinct content, first from one) o on o.content = k.content and k.doc_id % 2 <> 0
        where reason is null and (k.doc_id % 2 <> 0 or k.doc_id % 20 = 0 and k.doc_id not in (select first from one))),
    judged as (select doc_id, content, has_terms, nullif(first, doc_id) as copy_of from one where not (doc_id % 20 = 0 and doc_id <> first)
        union all select doc_id, content, has_terms, coalesce(earlier, nullif(min(doc_id) over (partition by content, earlier is null), doc_id)) from two)"""


@query(f"""with recursive {_INGESTED}
    select k.doc_id, case when reason is not null then 'failed' when copy_of is not null then 'duplicate' else 'live' end as state, reason is null and copy_of is null as has_chunks, reason is null and copy_of is null and k.has_terms as has_terms,
        case when reason is not null then reason when copy_of is not null then 'duplicate of ' || copy_of || '; not indexed' when k.doc_id % 20 = 0 and k.doc_id in (select first from one) then 'already indexed' end as detail
    from known k left join judged j on j.doc_id = k.doc_id""")
def str9_ingest_stream(spark, sf_dir):
    """Each page's last outcome, and whether the tables of chunks and terms hold it."""
    out, state = streams.shared_path(spark, "ingest"), streams.shared_path(spark, "state")
    for u in uploads_in_two(spark, sf_dir):
        stateful.ingest_uploads(u, out, state, target=120, overlap=24, least=8)
    store = stateful.upload_store(spark, out)
    last = store.read("outcomes").groupBy("doc_id").agg(F.max_by("state", "batch").alias("state"), F.max_by(F.struct("detail"), "batch").alias("d"))
    c, t = store.read("chunks"), store.read("terms")
    c = c.groupBy("doc_id").agg(F.count("*").alias("n")).join(c.join(t, "chunk_id", "left_semi").select("doc_id").distinct().withColumn("t", F.lit(True)), "doc_id", "left")
    return last.join(c, "doc_id", "left").select("doc_id", "state", F.col("n").isNotNull().alias("has_chunks"), F.col("t").isNotNull().alias("has_terms"), "d.detail")


@query()
def str2_silence_stream(spark, sf_dir):
    e = streams.read_stream(spark, f"{sf_dir}/event[s].parquet")
    return stateful_run(stateful.silence_stream(e.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("created_at"))))


@query()
def lif6_ingest(spark, sf_dir):
    """All documents against a registry that knows every fourth of them, in the states live, failed and deleted by turns."""
    d = outlined(spark, sf_dir).withColumn("uploaded_at", F.timestamp_seconds("doc_id"))
    sizes = {"target": 120, "overlap": 24, "least": 8}
    old = d.where("doc_id % 4 = 0")
    known = lifecycle.content_hash(chunking.chunk_documents(old, **sizes))
    state = F.expr("element_at(array('live', 'failed', 'deleted'), cast(doc_id div 4 % 3 as int) + 1)")
    registry = old.select("doc_id", state.alias("state"), "uploaded_at").join(known, "doc_id", "left")
    return ingest.ingest(d, streams.written(registry, "registry"), **sizes).outcomes
