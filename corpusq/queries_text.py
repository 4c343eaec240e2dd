"""Queries of the operators on files, texts, chunks and vectors, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import fixtures as X
from corpusq.functions import structure as S
from corpusq.functions import text as T
from corpusq.operators import chunking, dense, index, intake, lifecycle, vectors
from corpusq.queries import _TOK, CHUNKS, REGISTRY, WHOLE, query
from corpusq.sources import files

WS = r"[\s\x0b\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = "regexp_replace({0}, '^" + WS.replace("{", "{{").replace("}", "}}") + "+|" + WS.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"
_Q = lambda p: "'" + p.replace("'", "''") + "'"
LINES = "string_split(text, chr(10))"
OUTLINED = """docs as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case (i - 1) % 6 when 0 then '# ' || substring(x, 1, 40)
    when 2 then '2.1 ' || substring(x, 1, 30) when 3 then '' when 4 then substring(x, 1, 50) when 5 then '--' else x end), chr(10)) as text from documents)"""
HEADINGS = f"""rawlines as (select doc_id, unnest({LINES}) as raw, generate_subscripts({LINES}, 1) - 1 as line from docs),
    stripped as (select doc_id, line, length(raw) + 1 as size, {STRIP.format('raw')} as s from rawlines),
    placed as (select *, coalesce(sum(size) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as start from stripped),
    before as (select *, lag(s) over w as ps, lag(start) over w as pstart from placed window w as (partition by doc_id order by line)),
    kinds as (select *, case when regexp_matches(s, {_Q(S.UNDERLINE_1)}) then 1 when regexp_matches(s, {_Q(S.UNDERLINE_2)}) then 2 end as under,
        case when length(s) not between 2 and 120 then null when regexp_matches(s, {_Q(S.ATX)}) then 'atx'
            when regexp_matches(s, {_Q(S.NUMBERED)}) and not regexp_matches(s, '[.!?]$') then 'num'
            when regexp_matches(s, {_Q(S.ALL_CAPS)}) and len(regexp_extract_all(s, '\\s+')) < 10 then 'caps' end as kind,
        regexp_extract(s, {_Q(S.NUMBERED)}, 1) as num from before),
    found as (select doc_id, line,
        case when under is not null then under when kind = 'atx' then length(regexp_extract(s, {_Q(S.ATX)}, 1)) when kind = 'num' then length(num) - length(replace(num, '.', '')) + 1 else 1 end as level,
        case when under is not null then ps when kind = 'atx' then {STRIP.format(f"regexp_extract(s, {_Q(S.ATX)}, 2)")} when kind = 'num' then {STRIP.format(f"regexp_extract(s, {_Q(S.NUMBERED)}, 2)")} else s end as heading,
        case when under is not null then pstart else start end as char_start
        from kinds where (under is not null and length(ps) between 2 and 120) or (under is null and kind is not null)),
    heads as (select doc_id, line, cast(level as integer) as level, heading, cast(char_start as integer) as char_start from
        (select *, lag(heading) over (partition by doc_id order by line) as last from found) where last is null or last <> heading)"""
_GAP = r"'\n[ \t]*\n'"
PARAGRAPHS = f"""parts as (select doc_id, string_split_regex(text, {_GAP}) as p, regexp_extract_all(text, {_GAP}) as g from docs),
    spread as (select doc_id, unnest(p) as part, unnest(list_resize(g, len(p), '')) as gap, generate_subscripts(p, 1) as n from parts),
    begun as (select *, coalesce(sum(length(part) + length(gap)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as a from spread),
    paras as (select doc_id, cast(a + length(part) - length(regexp_replace(part, '^{WS}+', '')) as integer) as char_start, {STRIP.format('part')} as s from begun),
    paragraphs as (select doc_id, char_start, cast(char_start + length(s) as integer) as char_end, cast(len(regexp_extract_all(s, '{WS}+')) as integer) as token_count from paras where s <> '')"""
SECTIONS = f"""starts as (select distinct doc_id, char_start from heads union select doc_id, 0 from heads),
    cuts as (select doc_id, char_start, lead(char_start) over (partition by doc_id order by char_start) as e from starts),
    secs as (select doc_id, char_start, cast(coalesce(e, length(text)) as integer) as char_end, substring(text, char_start + 1, coalesce(e, length(text)) - char_start) as part from cuts join docs using (doc_id))"""


def outlined(spark, sf_dir):
    """The documents with headings put in."""
    line = """transform(split(text, '\\n', -1), (x, i) -> case i % 6 when 0 then concat('# ', substring(x, 1, 40)) when 2 then concat('2.1 ', substring(x, 1, 30))
        when 3 then '' when 4 then substring(x, 1, 50) when 5 then '--' else x end)"""
    return X.table(spark, sf_dir, "documents").select("doc_id", F.format_string("doc_%d-x.md", "doc_id").alias("filename"), F.array_join(F.expr(line), "\n").alias("text"))


@query()
def txt1_html(spark, sf_dir):
    return intake.html_text(X.table(spark, sf_dir, "pages"))


_NOISE = r"(?i)^\s*(page\s+)?\d+\s*(of\s+\d+)?\s*$"
_CLEAN = rf"""d as (select doc_id, source || case when doc_id % 7 = 0 then '.exe' else '.md' end as filename, nfc_normalize(text) as t from documents),
    l as (select *, regexp_replace(replace(replace(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(160), ' '), chr(8203), ''), '(?m)[ \t]+$', '', 'g') as c from d),
    k as (select *, list_filter(list_transform(string_split(c, chr(10)), lambda x: case when regexp_matches(x, '^{WS}*$') then '' else x end), lambda x: x = '' or not (regexp_matches(x, '{_NOISE}') or regexp_matches(x, '^\s*([-*_=]\s*){{3,}}$'))) as lines from l),
    clean as (select doc_id, filename, t, regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from k),
    why as (select *, case when filename like '%.exe' then 'unsupported' when coalesce(trim(t), '') = '' then 'no text' when text = '' then 'only noise' end as error_reason from clean)"""


@query(f"with {_CLEAN} select doc_id, filename, case when error_reason is null then text end as text, error_reason from why")
def txt2_txt3_extracted(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.when(F.col("doc_id") % 7 == 0, ".exe").otherwise(".md")).alias("filename"), "text")
    return intake.extracted(d)


@query(f"with {OUTLINED}, {HEADINGS} select * from heads")
def txt7_txt8_headings(spark, sf_dir):
    return S.headings(outlined(spark, sf_dir))


@query(f"""with {OUTLINED}, {HEADINGS}, {PARAGRAPHS},
    open as (select p.doc_id, p.char_start, h.line, h.heading, level, min(level) over (partition by p.doc_id, p.char_start order by h.line rows between 1 following and unbounded following) as later
        from paragraphs p join heads h on h.doc_id = p.doc_id and h.char_start <= p.char_start),
    path as (select doc_id, char_start, string_agg(heading, ' / ' order by line) as section_path from open where later is null or later > level group by all)
    select doc_id, char_start, coalesce(section_path, '') as section_path from paragraphs left join path using (doc_id, char_start)""")
def txt9_section_paths(spark, sf_dir):
    d = outlined(spark, sf_dir)
    p = S.section_paths(S.paragraphs(d).select("doc_id", "char_start"), S.headings(d))
    return p.select("doc_id", "char_start", F.array_join("section_path", " / ").alias("section_path"))


@query(f"with {OUTLINED}, {PARAGRAPHS} select * from paragraphs")
def txt11_paragraphs(spark, sf_dir):
    return S.paragraphs(outlined(spark, sf_dir))


@query(f"""with {OUTLINED}, {HEADINGS}, {SECTIONS}, {PARAGRAPHS}
    select doc_id, char_start, char_end, cast(len(regexp_extract_all(part, '{WS}+')) as integer) as token_count from secs where {STRIP.format('part')} <> ''
    union all select * from paragraphs where doc_id not in (select doc_id from heads)""")
def txt12_sections(spark, sf_dir):
    d = outlined(spark, sf_dir)
    return S.sections(d, S.headings(d))


def _chunked(strategy):
    def run(spark, sf_dir):
        out = chunking.chunk_documents(outlined(spark, sf_dir), strategy, 120, 24, 8)
        return out.withColumn("section_path", F.array_join("section_path", " / "))

    run.__name__ = f"txt14_txt15_{strategy}"
    return run


for _s in ("heading", "paragraph", "fixed"):
    query()(_chunked(_s))


@query()
def txt17_sentences(spark, sf_dir):
    return chunking.sentences(X.table(spark, sf_dir, "documents"))


_EXT = "lower(regexp_extract(filename, '(\\.[^.]*)$', 1))"
_UPLOADS = "(select page_id, page_id % 20 as batch_id, '..' || url || case page_id % 5 when 0 then '.html' when 1 then '.exe' when 2 then '.MD' when 3 then '' else '.txt' end as raw_name, case when page_id % 9 = 0 then 0 else length(html) * 1000 end as size from pages)"
_FLT3 = f"""named as (select *, substring(regexp_replace(replace(replace(raw_name, '/', '_'), '\\', '_'), '^\\.+', ''), 1, 255) as filename from {_UPLOADS}),
    typed as (select *, case when {_EXT} in ('.pdf', '.docx', '.html', '.htm', '.txt', '.md', '.markdown') then {_EXT} end as extension from named),
    judged as (select *, case when extension is null then 'unsupported' when size = 0 then 'empty' when size > 26214400 then 'too large' end as error from typed)"""


def _uploads(spark, sf_dir):
    name = F.expr("concat('..', url, case page_id % 5 when 0 then '.html' when 1 then '.exe' when 2 then '.MD' when 3 then '' else '.txt' end)")
    size = F.when(F.col("page_id") % 9 == 0, 0).otherwise(F.length("html").cast("long") * 1000)
    return intake.admit_uploads(X.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("batch_id"), name.alias("raw_name"), size.alias("size")))


@query(f"with {_FLT3} select page_id, filename, extension, error from judged")
def flt3_uploads(spark, sf_dir):
    return _uploads(spark, sf_dir).select("page_id", "filename", "extension", "error")


@query(f"with {_FLT3} select batch_id, count(*) filter (error is null) as accepted, count(*) filter (error is not null) as rejected from judged group by 1")
def flt3_batches(spark, sf_dir):
    return intake.batch_counts(_uploads(spark, sf_dir))


@query("""select event_id, case when event_id % 3 = 0 then 'user:' || user_id when event_id % 3 = 1 then 'ip:10.0.0.' || (user_id % 250) else 'ip:h' || user_id end as client,
    length(repeat(event_type, event_id % 900)) <= 4000 as admitted from events""")
def flt6_requests(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    e = e.select("event_id", F.expr("repeat(event_type, cast(event_id % 900 as int))").alias("message"), F.when(F.col("event_id") % 3 == 0, u).alias("user"),
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" , 10.1.1.1"))).alias("forwarded"), F.concat(F.lit("h"), u).alias("host"))
    return intake.admit_requests(e).select("event_id", "client", "admitted")


@query(f"with {REGISTRY} select doc_id, state, case when doc_id % 3 = 0 then 0 else 1 end as chunk_count from registry where state <> 'deleted'")
def flt8_listing(spark, sf_dir):
    return intake.listing(X.registry(spark, sf_dir), X.whole(spark, sf_dir).where("doc_id % 3 <> 0")).select("doc_id", "state", F.col("chunk_count").cast("int"))


@query(f"with {REGISTRY} select event_id, e.event_id * 7 as chunk_id, r.doc_id is not null as found from events e left join (select * from registry where state = 'live') r on r.doc_id = e.event_id * 7")
def flt9_passages(spark, sf_dir):
    wanted = X.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7).alias("chunk_id"))
    return intake.passages(wanted, X.whole(spark, sf_dir), X.registry(spark, sf_dir).where("state = 'live'")).select("event_id", "chunk_id", "found")


VECTORS = """chunks as (select vec_id as chunk_id, vec_id as doc_id, case when vec_id % 11 = 0 then null when vec_id % 13 = 0 then embedding[1:8] else embedding end as embedding,
    case vec_id % 5 when 0 then 'old' when 1 then null else 'new' end as embedding_model, case vec_id % 4 when 0 then 'disabled' else 'live' end as state, 'h' || (vec_id % 100) as content_hash from embeddings)"""


def vector_chunks(spark, sf_dir):
    e = "case when vec_id % 11 = 0 then null when vec_id % 13 = 0 then slice(embedding, 1, 8) else embedding end"
    return X.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.expr(e).alias("embedding"), F.expr("case vec_id % 5 when 0 then 'old' when 1 then null else 'new' end").alias("embedding_model"),
        F.expr("case vec_id % 4 when 0 then 'disabled' else 'live' end").alias("state"), F.concat(F.lit("h"), F.col("vec_id") % 100).alias("content_hash"))


WIDTH = 64


@query()
def vec3_approximate(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return dense.approximate_top(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id"), others=True)


@query("select true as reached, true as spared")
def vec3_recall(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    r = dense.recall(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id"), 5)
    return r.select((F.col("recall") >= 0.9).alias("reached"), (F.col("share") <= 0.05).alias("spared"))


_HEX = "cast(('0x' || substring(sha256(token), {0}, {1})) as bigint)"


@query(f"""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as token from documents), n as (select doc_id, token, count(*) as n from tok group by all),
    p as (select doc_id, {_HEX.format(1, 8)} % 32 as i, case when {_HEX.format(9, 2)} % 2 = 0 then n else -n end as v from n
        union all select doc_id, {_HEX.format(17, 8)} % 32, case when {_HEX.format(25, 2)} % 2 = 0 then n else -n end from n),
    s as (select doc_id, i, sum(v) as v from p group by all), l as (select doc_id, sqrt(sum(v * v)) as l from s group by all)
    select doc_id, cast(i as integer) as i, round(v / l, 9) as v from s join l using (doc_id) where v <> 0 and l > 0
    union all select doc_id, 0, 1.0 from documents where doc_id not in (select doc_id from l where l > 0)""")
def vec4_hash_embedding(spark, sf_dir):
    v = vectors.hash_embedding(X.table(spark, sf_dir, "documents"), "doc_id", 32)
    return v.select("doc_id", F.posexplode("vector").alias("i", "v")).where("v <> 0").withColumn("v", F.round("v", 9))


@query(f"""with {VECTORS}, l as (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as l from chunks)
    select chunk_id, case when embedding is null then 'missing' when len(embedding) <> {WIDTH} then 'width' when l = 0 then 'zero' end as error,
        case when len(embedding) = {WIDTH} and l > 0 then round(embedding[1]::double / l, 9) end as first from l""")
def vec5_normalised(spark, sf_dir):
    return vectors.normalised(vector_chunks(spark, sf_dir), WIDTH, "embedding").select("chunk_id", "error", F.round(F.col("unit")[0], 9).alias("first"))


def _lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


@query("select vec_id as chunk_id, length(cast(vec_id as varchar)) + 2.0::double as first from embeddings")
def vec6_embed(spark, sf_dir):
    c = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("b").alias("breadcrumb"), F.col("vec_id").cast("string").alias("text"))
    return vectors.embed(c, _lengths).select("chunk_id", F.col("vector")[0].alias("first"))


@query(f"with {VECTORS} select count(embedding) as live_embedded, count(*) filter (len(embedding) <> {WIDTH}) as wrong_width, count(*) - count(embedding) as missing from chunks where state = 'live'")
def vec7_vec8_health(spark, sf_dir):
    return vectors.health(vector_chunks(spark, sf_dir).where("state = 'live'"), WIDTH)


@query(f"""with {VECTORS}, a as (select chunk_id from chunks where state = 'live' and embedding is not null), b as (select * from chunks where chunk_id % 3 <> 0 and embedding is not null)
    select (select count(*) from a) as table_count, (select count(*) from b) as index_count, (select count(*) from a anti join b using (chunk_id)) as missing,
        (select count(*) from b anti join a using (chunk_id)) as stale, (select count(*) from b where len(embedding) <> {WIDTH}) as malformed, false as empty""")
def vec9_divergence(spark, sf_dir):
    c = vector_chunks(spark, sf_dir)
    return vectors.divergence(c.where("state = 'live'"), c.where("chunk_id % 3 <> 0 and embedding is not null"), WIDTH)


@query(f"with {VECTORS} select coalesce(embedding_model, '<null>') as embedding_model, cast(len(embedding) as integer) as width, count(*) as n from chunks where embedding is not null group by all")
def vec10_survey(spark, sf_dir):
    return vectors.survey(vector_chunks(spark, sf_dir))


@query(f"with {VECTORS} select chunk_id from chunks where not (embedding_model is not distinct from 'new' and len(embedding) is not distinct from {WIDTH})")
def vec11_pending(spark, sf_dir):
    return vectors.pending(vector_chunks(spark, sf_dir), "new", WIDTH).select("chunk_id")


@query(f"with {VECTORS} select chunk_id, 'new' as embedding_model, case when embedding_model is not distinct from 'new' and len(embedding) is not distinct from {WIDTH} then {WIDTH} else 2 end as width from chunks")
def vec12_reembed(spark, sf_dir):
    c = vector_chunks(spark, sf_dir).withColumn("breadcrumb", F.lit("")).withColumn("text", F.col("chunk_id").cast("string"))
    return vectors.reembed(c, _lengths, "new", WIDTH).select("chunk_id", "embedding_model", F.size("embedding").alias("width"))


@query(f"with {VECTORS} select count(*) as total, count(*) filter (embedding_model = 'new' and len(embedding) = {WIDTH}) as at_target, false as complete from chunks")
def vec13_verify(spark, sf_dir):
    return vectors.verify(vector_chunks(spark, sf_dir), "new", WIDTH)


@query(f"""with {VECTORS}, bad as (select * from chunks where len(embedding) <> {WIDTH}), clean as (select distinct content_hash from chunks where state = 'live' and doc_id not in (select doc_id from bad)),
    r as (select doc_id, 1 as bad_chunks, content_hash not in (select content_hash from clean) as at_risk from bad)
    select doc_id, bad_chunks, at_risk, not (select bool_or(at_risk) from r) as delete from r""")
def vec14_purge(spark, sf_dir):
    c = vector_chunks(spark, sf_dir)
    return vectors.bad_width_purge(c, c.select("doc_id", "content_hash", "state"), WIDTH).withColumn("bad_chunks", F.col("bad_chunks").cast("int"))


@query(f"""with {VECTORS}, l as (select chunk_id, embedding from chunks where state = 'live' and embedding is not null),
    i as (select chunk_id, case when chunk_id % 101 = 0 then list_reverse(embedding) else embedding end as other from chunks
        where embedding is not null and case when state = 'live' then chunk_id % 97 <> 0 else chunk_id % 89 = 0 end)
    select coalesce(l.chunk_id, i.chunk_id) as chunk_id, case when l.chunk_id is null then 'remove' when i.chunk_id is null then 'insert' else 'update' end as action
    from l full join i on l.chunk_id = i.chunk_id where embedding is distinct from other""")
def snk6_changes_by_digest(spark, sf_dir):
    """An index that lacks some live chunks, holds some that are not live, and has other vectors of some."""
    c = vector_chunks(spark, sf_dir)
    held = c.where("embedding is not null and case when state = 'live' then chunk_id % 97 <> 0 else chunk_id % 89 = 0 end")
    held = held.select("chunk_id", F.when(F.col("chunk_id") % 101 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding"))
    return vectors.index_changes(c.where("state = 'live'"), held, 64)


@query(f"""with {VECTORS} select coalesce(l.chunk_id, i.chunk_id) as chunk_id, case when l.chunk_id is null then 'remove' when embedding is not null then 'upsert' else 'skip' end as action
    from (select * from chunks where state = 'live') l full join (select chunk_id from chunks where chunk_id % 3 <> 0) i on i.chunk_id = l.chunk_id""")
def snk6_index_sync(spark, sf_dir):
    c = vector_chunks(spark, sf_dir)
    return vectors.index_sync(c.where("state = 'live'"), c.where("chunk_id % 3 <> 0"))


@query(f"with {VECTORS} select chunk_id from chunks where embedding is not null and state = 'live'")
def src3_live_chunks(spark, sf_dir):
    c = vector_chunks(spark, sf_dir)
    return files.live_chunks(c, c.select("doc_id", "state")).select("chunk_id")


@query("""select 'f' || vec_id || '.md' as filename, label as chunk_index, round(embedding[1]::double, 6) as first, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm
    from embeddings where contains('f' || vec_id || '.md', '7')""")
def snk3_chunk_dump(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    c = e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("chunk_index"), F.lit("").alias("text"), "embedding")
    d = e.select(F.col("vec_id").alias("doc_id"), F.format_string("f%d.md", "vec_id").alias("filename"))
    return files.chunk_dump(c, d, "7").select("filename", "chunk_index", F.round(F.col("preview")[0].cast("double"), 6).alias("first"), "norm")


@query(f"""with {CHUNKS}, q as (select item_id as query_id, text as query from benchmark), w as (select query_id, {_TOK.format('query')} as w from q),
    asked as (select query_id, unnest(w) as term from w),
    every as (select chunk_id, unnest({_TOK.format('text')}) as term from chunks), tf as (select chunk_id, term, count(*) as n from every group by all),
    len as (select chunk_id, sum(n) as len from tf group by all), t as (select count(*) as n, avg(len) as avg from (select coalesce(l.len, 0) as len from chunks left join len l using (chunk_id))),
    idf as (select term, greatest(ln(1 + (t.n - count(*) + 0.5) / (count(*) + 0.5)), 0.0) as idf from tf, t group by term, t.n),
    s as (select query_id, chunk_id, round(sum(idf * tf.n * 2.5 / (tf.n + 1.5 * (1 - 0.75 + 0.75 * len / avg))), 6) as score from asked join tf using (term) join idf using (term) join len using (chunk_id), t group by all)
    select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) as rank from s where score > 0 qualify rank <= 40""")
def kw6_bm25_variant(spark, sf_dir):
    q = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search_repeated(q, X.chunks(spark, sf_dir))


@query(f"with {WHOLE}, {REGISTRY} select (select count(*) from chunks anti join (select doc_id from registry where state = 'failed') f using (doc_id)) as kept, (select count(*) from registry where state = 'failed') as removed")
def kw7_lif5_purge(spark, sf_dir):
    c, r = X.whole(spark, sf_dir), X.registry(spark, sf_dir)
    kept = lifecycle.without_failed(c, r).agg(F.count("*").alias("kept"))
    return kept.crossJoin(c.agg(F.count("*").alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("removed"))


@query(f"with {WHOLE}, {REGISTRY} select state, cast(sum(len({_TOK.format('text')})) as bigint) as tokens from registry group by state")
def kw8_term_states(spark, sf_dir):
    states = X.registry(spark, sf_dir).select("doc_id", "state")
    c = X.whole(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    return c.join(states, "doc_id").groupBy("state").agg(F.sum("n").alias("tokens"))
