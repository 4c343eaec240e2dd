"""Queries of the operators on retrieval, rewriting, answers and evaluation, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import fixtures as X
from corpusq.functions import structure
from corpusq.operators import answers, chunking, evaluation, index, retrieval, rewrite, vectors
from corpusq.plans import logs
from corpusq.queries import _TOK, ASKED, BM25, CHUNKS, GRAMS, POSTINGS, found, pool, query
from corpusq.queries_text import outlined
from corpusq.sources import files
from corpusq.sources.streams import discard, written

FOUND = f"{CHUNKS}, {ASKED}, {POSTINGS}, {GRAMS}, {BM25}"
_RW = ", ".join(f"'{w}'" for w in retrieval.RERANK_STOPWORDS)
RERANK = f"""pool as (select query_id, chunk_id, rank, list_distinct(list_filter({_TOK.format('query')}, lambda x: not list_contains([{_RW}], x))) as q, {_TOK.format('text')} as tok
        from keyword join chunks using (chunk_id) join queries using (query_id)),
    sizes as (select query_id, count(*) as pool, any_value(q) as q from pool group by 1), hit as (select query_id, chunk_id, unnest(list_intersect(q, tok)) as term from pool),
    df as (select query_id, term, count(*) as df from hit group by all), qt as (select query_id, pool, unnest(q) as term from sizes),
    kept as (select query_id, term, pool, coalesce(df, 0) as df, coalesce(df, 0) / pool <= 0.9 as kept from qt left join df using (query_id, term)),
    known as (select *, bool_or(kept) over (partition by query_id) as any_kept from kept),
    w as (select query_id, term, case when any_kept then ln(1 + pool / (1 + df)) else 1.0 end as weight from known where kept or not any_kept),
    total as (select query_id, sum(weight) as total, list(term) as terms from w group by 1), m as (select query_id, chunk_id, sum(weight) as matched from hit join w using (query_id, term) group by all),
    pos as (select query_id, chunk_id, unnest(tok) as term, generate_subscripts(tok, 1) as i from pool), ph as (select pos.* from pos join w using (query_id, term)),
    near as (select *, count(*) over (partition by query_id, chunk_id order by i range between 1 following and 5 following) as c from ph),
    adj as (select query_id, chunk_id, case when count(*) > 1 then least(1.0, sum(c) / (count(*) - 1)) else 0.0 end as adjacency from near group by all),
    scored as (select query_id, chunk_id, rank, round(case when len(tok) = 0 or total is null then 0.0 else least(1.0, coalesce(matched, 0) / total * 0.8 + coalesce(adjacency, 0) * 0.2) * (0.6 + 0.4 / (1 + ln(1 + len(tok) / 200))) end, 9) as score
        from pool left join total using (query_id) left join m using (query_id, chunk_id) left join adj using (query_id, chunk_id))"""


def _bm25(spark, sf_dir):
    return index.search(X.index(spark, sf_dir), X.queries(spark, sf_dir), 40)


@query(f"with {FOUND}, {RERANK} select query_id, chunk_id, score from scored")
def rnk3_lexical(spark, sf_dir):
    return retrieval.lexical_scores(written(pool(spark, sf_dir, found(spark, sf_dir)), "pool"))  # read several times


@query(f"with {FOUND}, {RERANK} select query_id, chunk_id, score as reranked, cast(row_number() over (partition by query_id order by score desc, rank) as integer) as rank from scored where rank <= 20")
def rnk5_reranked(spark, sf_dir):
    r = found(spark, sf_dir).drop("score")
    scores = retrieval.lexical_scores(written(pool(spark, sf_dir, r), "pool"))
    return retrieval.reranked(r, scores, 20).select("query_id", "chunk_id", "reranked", "rank")


@query(f"""with {FOUND}, {RERANK}, t as (select query_id, text, arg_min(score, rank) as score from scored join chunks using (chunk_id) where rank <= 20 group by all)
    select k.query_id, k.chunk_id, t.score as reranked, cast(row_number() over (partition by k.query_id order by t.score desc, k.rank) as integer) as rank
    from keyword k join chunks using (chunk_id) join t on t.query_id = k.query_id and t.text = chunks.text where k.rank <= 20""")
def rnk5_jn8_by_text(spark, sf_dir):
    """The reranker answers with texts, in the order of the candidates."""
    r = found(spark, sf_dir).drop("score")
    p = written(pool(spark, sf_dir, r), "pool")
    hits = retrieval.lexical_scores(p).join(p.where("rank <= 20"), ["query_id", "chunk_id"]).select("query_id", F.col("rank").alias("position"), "text", "score")
    return retrieval.reranked(r, retrieval.scores_by_text(p, hits), 20).select("query_id", "chunk_id", "reranked", "rank")


@query()
def rnk7_model(spark, sf_dir):
    return retrieval.model_scores(pool(spark, sf_dir, found(spark, sf_dir)), lambda q, t: [len(set(a.split()) & set(b.split())) / (1 + len(a)) for a, b in zip(q, t)])


@query("""select event_id, coalesce(case when event_id % 2 = 0 then value end, case when event_id % 3 = 0 then value + 1 end, case when event_id % 5 = 0 then value + 2 end, case when event_id % 7 = 0 then value + 3 end) as best,
    case when event_id % 2 = 0 then 'reranked' when event_id % 3 = 0 then 'fused' when event_id % 5 = 0 then 'vector' when event_id % 7 = 0 then 'keyword' else 'none' end as stage from events""")
def rnk8_best(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    cols = [F.when(F.col("event_id") % m == 0, F.col("value") + i).alias(s) for i, (m, s) in enumerate(zip((2, 3, 5, 7), retrieval.STAGES))]
    return e.select("event_id", *cols).select("event_id", retrieval.best_score().alias("best"), retrieval.gating_stage().alias("stage"))


def hybrid(spark, sf_dir, config=None):
    """Arguments of the retrievals: queries and chunks, the configuration, the index, and the chunks' hash embeddings. Vectors are written without texts."""
    c = X.chunks(spark, sf_dir)
    q = X.queries(spark, sf_dir).select("query_id", "query")
    q = q.join(vectors.hash_embedding(q.select("query_id", F.col("query").alias("text")), "query_id", 64), "query_id")
    return written(q, "queries"), c, config or retrieval.Config(threshold=0.2), X.index(spark, sf_dir), written(vectors.hash_embedding(c, "chunk_id", 64), "vectors")


@query()
def rnk11_rnk13_retrieve(spark, sf_dir):
    return retrieval.retrieve(*hybrid(spark, sf_dir))[0]


@query()
def rnk12_trace(spark, sf_dir):
    return retrieval.retrieve(*hybrid(spark, sf_dir))[1]


@query()
def log6_diagnoses(spark, sf_dir):
    q, c, config, kept, embedded = hybrid(spark, sf_dir)
    return logs.diagnoses(retrieval.gap_runs(q, c, config, kept=kept, embedded=embedded))


@query()
def snk5_log_rows(spark, sf_dir):
    q, c, config, kept, embedded = hybrid(spark, sf_dir)
    found = written(retrieval.candidates(q, c, config, kept, embedded), "found")
    return files.log_rows(found, retrieval.results(q, found, retrieval.gated(found, config), config.threshold)).withColumn("scores", F.to_json("scores"))


@query()
def ev8_ablation(spark, sf_dir):
    labels = written(_labels(spark, sf_dir), "labels")
    q, c, _, kept, embedded = hybrid(spark, sf_dir)
    # The four configurations differ in what they do with two searches, and two of them in the rerank alone.
    lists = retrieval.searches(q, c, retrieval.Config(), kept, embedded)
    texts = retrieval.texts_of(lists, c)
    pools = {names: retrieval.fused({n: lists[n] for n in names}, texts) for names in (("keyword", "vector"), ("keyword",), ("vector",))}
    runs = None
    for name, flags in {"full": {}, "keyword only": {"vector": False}, "vector only": {"keyword": False}, "no rerank": {"rerank": False}}.items():
        config = retrieval.Config(**flags)
        pool = pools[tuple(n for n in lists if getattr(config, n))]
        hit = evaluation.hit_ranks(retrieval.rescored(pool, q, config).where("rank <= 10"), labels).select("query_id").distinct()
        run = hit.agg(F.count("*").alias("hits")).crossJoin(labels.agg(F.countDistinct("query_id").alias("n"))).select(F.lit(name).alias("config"), F.round(F.col("hits") / F.col("n"), 9).alias("recall"))
        runs = run if runs is None else runs.unionByName(run)
    return evaluation.ablation(runs)


def rewrites(spark, sf_dir):
    t = X.table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") > 0, F.expr("case conv_id % 3 when 0 then concat('What about ', substring(text, 1, 20), '?') when 1 then concat('Does it ', substring(text, 1, 20)) else text end")).otherwise(F.col("text")))
    return rewrite.with_antecedent(t).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"), "antecedent")


_GLOSS = "select term, position, synonym from (select item_id as position, lower(regexp_extract(text, '[A-Za-z0-9_]+', 0)) as term, regexp_extract(text, '[A-Za-z0-9_]+ ([A-Za-z0-9_]+)', 1) as synonym from benchmark)"


def glossary(spark, sf_dir):
    return X.table(spark, sf_dir, "benchmark").selectExpr("item_id as position", "lower(regexp_extract(text, '[A-Za-z0-9_]+', 0)) as term", "regexp_extract(text, '[A-Za-z0-9_]+ ([A-Za-z0-9_]+)', 1) as synonym")


_WORDS = "regexp_extract_all(lower({}), '[A-Za-z0-9_]+')"
_PRONOUNS = "[" + ", ".join(f"'{w}'" for w in rewrite.PRONOUNS) + "]"
_ASKS = r"(?i)^\s*(do|does|did|is|are|was|were|can|could|would|should|will|shall|may|might|tell\s+me\s+about|explain|describe|what\s+is|what\s+are|what''?s)\s+"
_BARE = r"trim(regexp_replace(trim({}), '[?.]+\s*$', ''))"
_TOPIC = _BARE.format(rf"regexp_replace(trim(regexp_replace({_BARE.format('query')}, '{_ASKS}', '')), '(?i)^(the|a|an|my|our|your|their)\s+', '')")
_OPENER = rewrite.OPENER.replace("'", "''")


@query(f"""with t as (select conv_id, turn, case when turn > 0 and conv_id % 3 = 0 then 'What about ' || substring(text, 1, 20) || '?' when turn > 0 and conv_id % 3 = 1 then 'Does it ' || substring(text, 1, 20) else text end as query
        from conversations where role = 'user'), u as (select *, {_WORDS.format(_TOPIC)} as topic, {_WORDS.format('query')} as present from t where trim(query) <> ''),
    a as (select conv_id || '-' || turn as query_id, query, present, last_value(case when len(topic) >= 2 then array_to_string(topic[1:6], ' ') end ignore nulls) over (partition by conv_id order by turn rows between 10 preceding and 1 preceding) as before from u),
    o as (select *, trim(regexp_replace(trim(regexp_extract(query, '{_OPENER}', 1)), '[?.]+$', '')) as of, array_to_string(list_filter(present, lambda x: not list_contains({_PRONOUNS}, x)), ' ') as rest from a),
    r as (select *, case when before is null then null when of <> '' and not list_has_any({_WORDS.format('of')}, {_PRONOUNS}) then before || ' ' || of
        when list_has_any(present, {_PRONOUNS}) then before || ' ' || case when rest = '' then before else rest || '?' end end as res from o),
    g as ({_GLOSS}), h as (select distinct query_id, position, synonym from (select query_id, unnest(present) as term from a) q join g using (term)),
    n as (select query_id, lower(synonym) as k, min({{'position': position, 'synonym': synonym}}) as s from h join a using (query_id) where not list_contains(present, lower(synonym)) group by all),
    x as (select query_id, string_agg(s.synonym, ' ' order by i) as added from (select *, row_number() over (partition by query_id order by s) as i from n qualify i <= 4) group by 1),
    f as (select query_id, query as original, coalesce(res, query || ' ' || added, query) as query, case when res is not null then 'anaphora' when added is not null then 'expansion' else 'none' end as stage from r left join x using (query_id))
    select *, query <> original as changed from f""")
def rw1_rw2_rw3_rw5_rewritten(spark, sf_dir):
    return rewrite.rewritten(rewrites(spark, sf_dir), glossary(spark, sf_dir))


@query(f"""with g as ({_GLOSS}), q as (select doc_id as query_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') as present from documents),
    h as (select distinct query_id, position, synonym from (select query_id, unnest(present) as term from q) join g using (term)),
    n as (select query_id, lower(synonym) as k, min({{'position': position, 'synonym': synonym}}) as s from h join q using (query_id) where not list_contains(present, lower(synonym)) group by all),
    r as (select *, row_number() over (partition by query_id order by s) as i from n qualify i <= 4)
    select query_id, string_agg(s.synonym, ' ' order by i) as added from r group by 1""")
def rw4_expansions(spark, sf_dir):
    q = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return rewrite.expansions(q, glossary(spark, sf_dir))


def said(spark, sf_dir):
    """Answers' sentences with citations put in: each cites passage turn % 5 of 3."""
    a = X.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return a.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("sent_idx"), F.concat("text", F.lit(" ["), F.col("turn") % 5, F.lit("]")).alias("sentence"), F.lit(3).alias("passages"))


@query("""select conv_id as query_id, bool_or(turn % 5 between 1 and 3) as grounded, cast(sum(case when turn % 5 between 1 and 3 then 1 else 0 end) as bigint) as emitted,
    cast(sum(case when turn % 5 between 1 and 3 then 0 else 1 end) as bigint) as stripped from conversations where role = 'assistant' group by 1""")
def cit3_totals(spark, sf_dir):
    return answers.totals(answers.validated(said(spark, sf_dir)))


_REFUSAL = answers.REFUSALS["ungrounded_answer"].replace("'", "''")


@query(rf"""with recursive s as (select conv_id as query_id, turn % 5 between 1 and 3 as good, row_number() over (partition by conv_id order by turn) as i,
        trim(regexp_replace(regexp_replace(text || ' ' || case when turn % 5 between 1 and 3 then '[' || (turn % 5) || ']' else '' end, '[ \t]{{2,}}', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g')) as text
        from conversations where role = 'assistant'),
    f as (select query_id, '' as shown, '' as held, 0 as n, false as ok, 0::bigint as i, 0::bigint as stripped from s group by 1 union all
        select f.query_id, case when ok or good then concat_ws(' ', nullif(shown, ''), nullif(held, ''), nullif(text, '')) else shown end,
            case when ok or good or n + length(text) > 4000 then '' when text = '' then held else concat_ws(' ', nullif(held, ''), text) end,
            case when ok or good or n + length(text) > 4000 then 0 else n + length(text)::int end, ok or good, s.i, f.stripped + (not good)::int
        from f join s on s.query_id = f.query_id and s.i = f.i + 1)
    select query_id, case when ok then shown else '{_REFUSAL}' end as answer, not ok as abstained, stripped from f qualify row_number() over (partition by query_id order by i desc) = 1""")
def cit1_cit4_assembled(spark, sf_dir):
    return answers.assembled(answers.validated(said(spark, sf_dir)))


@query(f"with {FOUND} select query_id, string_agg(i || ':' || chunk_id, ',' order by i) as sources from (select *, row_number() over (partition by query_id order by rank) as i from keyword where rank <= 8) group by 1")
def cit6_sources(spark, sf_dir):
    s = answers.sources(_bm25(spark, sf_dir).where("rank <= 8"))
    return s.select("query_id", F.array_join(F.transform("sources", lambda x: F.concat(x["index"], F.lit(":"), x["chunk_id"])), ",").alias("sources"))


def passages(spark, sf_dir):
    u = X.table(spark, sf_dir, "conversations").where("role = 'user'")
    return u.select(F.col("conv_id").alias("query_id"), (F.col("turn") / 2 + 1).cast("int").alias("index"), "text")


_CITED = f"""s as (select conv_id as query_id, turn as sent_idx, turn % 5 as cited, {_TOK.format('text')} as tok from conversations where role = 'assistant'),
    p as (select conv_id as query_id, turn // 2 + 1 as i, {_TOK.format('text')} as have from conversations where role = 'user')"""


@query(f"""with {_CITED} select query_id, sent_idx, case when len(tok) = 0 then true else len(list_filter(tok, lambda x: list_contains(coalesce(have, []), x))) / len(tok) >= 0.3 end as supported
    from s left join p using (query_id) where p.i = cited union all select query_id, sent_idx, len(tok) = 0 from s where not exists (select 1 from p where p.query_id = s.query_id and p.i = s.cited)""")
def cit7_support(spark, sf_dir):
    return answers.supported(said(spark, sf_dir), passages(spark, sf_dir), 0.3)


@query()
def cit8_extractive(spark, sf_dir):
    best = pool(spark, sf_dir, found(spark, sf_dir, 8)).select("query_id", F.col("rank").alias("index"), "text")
    return answers.extractive(X.queries(spark, sf_dir), written(best, "pool"))  # read twice


@query(f"select conv_id as query_id, cast(len({_TOK.format('text')}) as integer) as tokens_in, cast(len({_TOK.format('role')}) as integer) as tokens_out from conversations where turn = 0")
def cit10_tokens(spark, sf_dir):
    return answers.token_totals(X.table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("prompt"), F.col("role").alias("answer")))


@query(f"""with {FOUND}, b as (select query_id, string_agg('<passage n="' || rank || '" source="' || lang || '">' || chr(10) || replace(replace(text, '&', '&amp;'), '<', '&lt;') || chr(10) || '</passage>', chr(10) order by rank) as prompt
        from keyword join chunks using (chunk_id) where rank <= 8 group by 1)
    select query_id, case when length(prompt) > 3000 then substring(prompt, 1, 3000) || chr(10) || '[context truncated]' else prompt end as prompt from b""")
def txt21_prompts(spark, sf_dir):
    c = X.chunks(spark, sf_dir).select("chunk_id", "text", F.col("lang").alias("breadcrumb"))
    return answers.prompts(found(spark, sf_dir, 8).join(c, "chunk_id"), 3000)


@query("""select doc_id, case when doc_id % 2 = 0 then ([ 'ABC', 'RFD', 'XYZ'])[1 + doc_id % 3] end as code, case when doc_id % 2 = 0 then cast(doc_id % 1000 as integer) end as number from documents""")
def ev2_references(spark, sf_dir):
    text = F.expr("concat('x POL-', array('ABC', 'RFD', 'XYZ')[cast(doc_id % 3 as int)], if(doc_id % 2 = 0, '-', '/'), lpad(doc_id % 1000, 3, '0'), ' y ')")
    code, number = evaluation.reference_id(text)
    return X.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), number.alias("number"))


_CATEGORY = "case item_id % 5 when 0 then 'abstain' when 1 then 'multiturn' when 2 then 'identifier' else 'direct' end"
QUESTIONS = f"questions as (select item_id as query_id, {_CATEGORY} as category, item_id % 5 = 0 as expect_abstain from benchmark)"


def questions(spark, sf_dir):
    return X.table(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", f"{_CATEGORY} as category", "item_id % 5 = 0 as expect_abstain")


@query(f"""with {QUESTIONS}, g as (select category, count(*) as n from questions group by 1) select category, n, round(n / (select count(*) from questions), 9) as share,
    n / (select count(*) from questions) >= case category when 'abstain' then 0.2 when 'multiturn' then 0.1 when 'identifier' then 0.1 else 0 end as enough from g""")
def ev3_classes(spark, sf_dir):
    return evaluation.class_shares(questions(spark, sf_dir))


def _labels(spark, sf_dir):
    q, c = X.queries(spark, sf_dir), X.chunks(spark, sf_dir)
    return evaluation.holding(q, c, once=True)


_REL = "rel as (select query_id, chunk_id from queries join chunks on contains(lower(text), lower(evidence)))"


@query(f"with {FOUND}, {_REL} select query_id, cast(rank as integer) as rank from keyword semi join rel using (query_id, chunk_id)")
def ev4_hits(spark, sf_dir):
    return evaluation.hit_ranks(_bm25(spark, sf_dir), _labels(spark, sf_dir))


_OUTCOMES = f"""{FOUND}, {_REL}, {QUESTIONS}, hits as (select query_id, min(rank) as first_hit from keyword semi join rel using (query_id, chunk_id) group by 1), top as (select query_id, max(score) as top_score from keyword group by 1),
    done as (select query_id, category, expect_abstain, first_hit, coalesce(top_score < 30, true) as abstained, case when expect_abstain then coalesce(top_score < 30, true) else first_hit is not null end as correct
        from questions left join hits using (query_id) left join top using (query_id))"""


def _done(spark, sf_dir):
    r = written(_bm25(spark, sf_dir), "ranked")  # searched once
    passed = r.where("rank = 1 and score >= 30").select("query_id")
    return evaluation.outcomes(questions(spark, sf_dir), evaluation.hit_ranks(r, _labels(spark, sf_dir)), passed)


@query(f"with {_OUTCOMES} select category, count(*) as n, round(avg(case when correct then 1.0 else 0.0 end), 9) as accuracy, round(avg(case when abstained then 1.0 else 0.0 end), 9) as refusal_rate from done group by 1")
def ev6_accuracy(spark, sf_dir):
    return evaluation.accuracy(_done(spark, sf_dir))


@query(f"with {_OUTCOMES} select count(*) filter (not correct and not expect_abstain and not abstained) as retrieval_gaps, count(*) filter (not correct and not expect_abstain and abstained) as returned_nothing from done")
def ev17_failures(spark, sf_dir):
    return evaluation.failures(_done(spark, sf_dir))


POINTS = [5.0 * i for i in range(11)]
_SWEEP = f"""{FOUND}, {_REL}, {QUESTIONS}, hits as (select distinct query_id, true as hit from (select * from keyword where rank <= 10) k semi join rel using (query_id, chunk_id)), top as (select query_id, max(score) as top_score from keyword group by 1),
    at_point as (select threshold, expect_abstain, coalesce(top_score >= threshold, false) as ok, hit from questions left join top using (query_id) left join hits using (query_id), (select unnest({POINTS})::double as threshold)),
    rates as (select threshold, avg(case when not expect_abstain then case when ok and hit then 1.0 else 0.0 end end) as recall, avg(case when ok then 0.0 else 1.0 end) as refusal_rate from at_point group by 1),
    points as (select threshold, round(recall, 9) as recall, round(refusal_rate, 9) as refusal_rate, recall >= 0.85 and refusal_rate between 0.1 and 0.3 as joint from rates)"""


@query(f"with {_SWEEP} select * from points")
def ev9_sweep(spark, sf_dir):
    return evaluation.sweep(questions(spark, sf_dir), written(_bm25(spark, sf_dir), "ranked").withColumnRenamed("score", "best"), _labels(spark, sf_dir), POINTS)


@query(f"with {_SWEEP} select (select threshold from points where joint order by recall desc, threshold limit 1) as threshold, (select count(*) from points where joint) as joint_points")
def ev10_recommended(spark, sf_dir):
    return evaluation.recommended(ev9_sweep(spark, sf_dir))


_SNAP = """snap as (select cast(doc_id as integer) as id, doc_id // 11 as seq, 100 + (doc_id // 44) as n, 'd' || (doc_id // 44) as dataset, 'c' || (doc_id // 22) as corpus, 'k' || (doc_id // 11) as code, doc_id % 11 / 10.0 as threshold,
    round((n_chars % 100) / 100.0, 2) as recall, n_chars % 2 = 0 as joint from documents)"""


def snapshots(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").selectExpr("doc_id div 11 as seq", "100 + doc_id div 44 as n", "concat('d', doc_id div 44) as dataset", "concat('c', doc_id div 22) as corpus", "concat('k', doc_id div 11) as code",
        "doc_id % 11 / 10D as threshold", "round((n_chars % 100) / 100D, 2) as recall", "n_chars % 2 = 0 as joint")


@query(f"""with {_SNAP}, l as (select *, lag(n) over w as bn, lag(dataset) over w as bd, lag(corpus) over w as bc, lag(code) over w as bk, lag(recall) over w as br, lag(joint) over w as bj from snap window w as (partition by threshold order by seq)),
    d as (select *, n = bn and dataset = bd as same, round(recall - br, 9) as d from l where bn is not null)
    select seq, cast(threshold as double) as threshold, same as comparable, cast(case when same then d end as double) as recall_delta, case when not same then 'refused' when d > 0.01 then 'improved' when d < -0.01 then 'regressed' else 'steady' end as moved,
        same and bj and not joint as lost_joint, case when corpus <> bc then 'corpus' when code <> bk then 'code' else 'none' end as cause from d""")
def ev11_delta(spark, sf_dir):
    return evaluation.snapshot_delta(snapshots(spark, sf_dir))


@query(f"""with {_SNAP}, r as (select seq, cast(seq % 12 / 10.0 as double) as recommended, count(*) filter (joint) as joint_points from snap group by seq)
    select r.seq, recommended, cast(recall as double) as recall, cast(recall as double) as refusal_rate, joint_points from r left join snap on snap.seq = r.seq and cast(threshold as double) = recommended""")
def ev12_trend(spark, sf_dir):
    s = snapshots(spark, sf_dir).groupBy("seq").agg(F.collect_list(F.struct("threshold", "recall", F.col("recall").alias("refusal_rate"), "joint")).alias("points"))
    return evaluation.trend(s.withColumn("recommended", F.col("seq") % 12 / F.lit(10.0)))


@query(f"with {ASKED} select count(*) as n, substring(sha256(string_agg(query, chr(10) order by query_id)), 1, 12) as fingerprint from queries")
def ev13_fingerprint(spark, sf_dir):
    return evaluation.dataset_fingerprint(X.queries(spark, sf_dir))


@query("select count(*) as chunks, count(distinct doc_id) as documents from documents")
def ev14_corpus(spark, sf_dir):
    return evaluation.corpus_fingerprint(X.whole(spark, sf_dir))


@query()
def ev15_strategies(spark, sf_dir):
    d, q = outlined(spark, sf_dir), X.queries(spark, sf_dir)
    out = {"chunks": None, "labels": None, "ranked": None}
    for s in ("heading", "paragraph", "fixed"):
        # Neither paths nor titles are asked for, so texts don't meet headings again.
        c = chunking.cut_documents(d, structure.headings(d) if s == "heading" else None, s, 1000, 200, 50)
        c = written(c.select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), "text", "token_count"), "chunks")
        rel = evaluation.holding(q, c, once=True)
        parts = {"chunks": c.select("token_count"), "labels": q.select("query_id").join(rel, "query_id", "left"), "ranked": index.search_repeated(q.select("query_id", "query"), c)}
        for k, v in parts.items():
            v = written(v.withColumn("strategy", F.lit(s)), f"strategy-{k}")
            out[k] = v if out[k] is None else out[k].unionByName(v)
        discard(c)  # the next strategy's texts take its place
    return evaluation.strategies(out["labels"], out["ranked"], out["chunks"])


_ANSWERED = "answered as (select event_id as query_id, event_type as category, event_id % 5 = 0 as expect_abstain, event_id % 3 > 0 as retrieved, event_id % 4 = 0 as abstained, event_id % 6 as emitted, event_id % 2 as stripped, event_id % 7 > 0 as supported from events)"


@query(f"""with {_ANSWERED} select category, count(*) as n, round(count(*) filter (not abstained and supported) / count(*) filter (retrieved and not expect_abstain), 9) as groundedness_ref,
    round(count(*) filter (not abstained and supported and retrieved and not expect_abstain) / count(*) filter (retrieved and not expect_abstain), 9) as groundedness_strict,
    round(sum(emitted) / (sum(emitted) + sum(stripped)), 9) as resolvable_rate, round(sum(stripped) / (sum(emitted) + sum(stripped)), 9) as strip_rate, round(avg(case when abstained then 1.0 else 0.0 end), 9) as refusal_rate from answered group by 1""")
def ev16_generation(spark, sf_dir):
    a = X.table(spark, sf_dir, "events").selectExpr("event_id as query_id", "event_type as category", "event_id % 5 = 0 as expect_abstain", "event_id % 3 > 0 as retrieved", "event_id % 4 = 0 as abstained",
        "event_id % 6 as emitted", "event_id % 2 as stripped", "event_id % 7 > 0 as supported")
    return evaluation.generation(a)


_RANK = "list_sort(list(ttft_ms) filter (ttft_ms is not null))[1 + least(cast(floor(count(ttft_ms) * {0}) as bigint), count(ttft_ms) - 1)]"


@query(f"""with a as (select event_type as category, case when event_id % 4 > 0 then cast(floor(value * 20) as integer) end as ttft_ms from events)
    select category, {_RANK.format(0.5)} as ttft_p50, {_RANK.format(0.95)} as ttft_p95 from a group by 1""")
def ev16_first_token_times(spark, sf_dir):
    return evaluation.first_token_times(X.table(spark, sf_dir, "events").selectExpr("event_type as category", "case when event_id % 4 > 0 then cast(floor(value * 20) as int) end as ttft_ms"))
