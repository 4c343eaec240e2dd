"""DuckDB SQL for the queries that SQL can express; brute-force versions of the others are in tests/llm."""

_WS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""
with lines as (
    select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
    from documents),
keyed as (
    select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') as k from lines),
often as (
    select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (
    select keyed.*, often.k is not null and keyed.doc_id <> often.keeper as gone from keyed left join often on keyed.k = often.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP5 = rf"""
with d as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WS}') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WS}')) as l
    from documents),
base as (
    select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) as n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as n_dots,
        len(list_distinct(list_filter(w, lambda x: list_contains(['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with', 'is', 'in', 'for', 'it', 'a', 'on',
            'le', 'la', 'les', 'de', 'des', 'et', 'un', 'une', 'du', 'en', 'que', 'qui', 'pour', 'dans', 'est', 'sur',
            'der', 'die', 'das', 'und', 'den', 'von', 'zu', 'mit', 'sich', 'auf', 'für', 'ist', 'im', 'dem', 'ein', 'eine',
            'el', 'los', 'las', 'y', 'con', 'por', 'una', 'para', 'del', 'se', 'no', 'es', 'al'], x)))) as n_stop
    from d),
windows as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
twice as (select doc_id, i, count(*) over (partition by doc_id, g) as n from windows),
covered as (
    select doc_id, count(distinct i + j) as n from twice, (values (0), (1), (2)) as o(j) where twice.n >= 2 group by doc_id),
counted as (select base.*, coalesce(covered.n, 0) as n_repeat_words from base left join covered using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
        and word_chars / greatest(n_words, 1) between 2.0 and 15.0 and n_symbols / greatest(n_words, 1) <= 0.2 and n_stop >= 2
        and n_dup_lines / greatest(n_lines, 1) <= 0.5 and n_bullets / greatest(n_lines, 1) <= 0.9 and n_dots / greatest(n_lines, 1) <= 0.5 as kept
from counted
"""

OP7 = """
with v as (
    select vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
    from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
parts as (select vec_id, unnest(x) as c, generate_subscripts(x, 1) as i from v),
scores as (
    select q.vec_id as query_id, e.vec_id, sum(q.c * e.c) as score
    from parts q join parts e on q.i = e.i and q.vec_id <> e.vec_id where q.vec_id % 50 = 0 group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= 5
"""

OP8 = rf"""
with sized as (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WS}')) as bigint) as size, md5(cast(doc_id as varchar)) as o from documents),
by_source as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
kinds as (
    select *, (row_number() over (order by source nulls last) - 1) % 3 as kind, 2.0::double * source_size as cap from by_source),
weighed as (select *, [5.0, 2.0, 1.0][kind + 1]::double as weight, [0.5, 0.0, -0.5][kind + 1]::double as slope from kinds),
filled as (
    select *, 1.5::double * sum(source_size) over () as total,
        coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as full_ones,
        sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as rest
    from weighed),
levels as (select *, (total - full_ones) / rest as level from filled),
water as (select min_by(level, cap / weight) filter (level * weight <= cap) as w from levels),
goals as (select source, source_size, slope, case when w is null then cap else least(cap, weight * w) end as target from levels, water),
placed as (
    select s.doc_id, s.size, g.source_size, g.target, g.slope,
        sum(s.size) over (partition by s.source order by s.o nulls first, s.doc_id rows between unbounded preceding and current row) - s.size + s.size / 2 as middle
    from sized s join goals g on s.source is not distinct from g.source),
timed as (
    select *, case when size = 0 or source_size = 0 then 0 else least(2, greatest(0, ceil((target - middle) / source_size))) end as times,
        least(1.0, middle / target) as place from placed)
select doc_id, size, source_size, target, cast(times * size as bigint) as taken,
    case when times > 0 then case when slope = 0 then place else (1 + slope - sqrt(greatest(0.0, (1 + slope) * (1 + slope) - 4 * slope * place))) / (2 * slope) end end as position
from timed
"""

OP12 = rf"""
with d as (
    select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
pieces as (select d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) as p from d),
split as (select d, p, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as hugeint) as n from split group by lang),
words as (select d, p, lang, unnest(w) as w, generate_subscripts(w, 1) as i from split),
rows as (
    select lang, w as w1, lead(w, 1) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4, lead(w, 4) over o as w5
    from words window o as (partition by d, p order by i)),
starts as (select lang, w1, w2, w3, w4, w5, count(*) as n from rows group by all),
phrases as (
    select lang, m, [w1, w2, w3, w4, w5][1:m] as w, cast(sum(n) as hugeint) as f from starts, (values (1), (2), (3), (4), (5)) as s(m)
    where case m when 1 then w1 when 2 then w2 when 3 then w3 when 4 then w4 else w5 end is not null group by all having sum(n) >= 100),
inner_ones as (
    select distinct p.lang, p.f, p.w[i:i + s.m - 1] as w from phrases p, (values (2), (3), (4)) as s(m), (values (1), (2), (3), (4)) as o(i)
    where p.m >= 3 and s.m < p.m and i + s.m - 1 <= p.m),
longer as (select lang, w, max(f) as f from inner_ones group by all),
kept as (select p.* from phrases p left join longer l on l.lang = p.lang and l.w = p.w where p.m >= 2 and (l.f is null or 100 * l.f < 100 * p.f)),
cuts as (
    select c.lang, c.w, c.f as a, k, x.f as l, y.f as r, t.n, (1000 * c.f * t.n) // (x.f * y.f) as score
    from kept c join (values (1), (2), (3), (4)) as s(k) on k < c.m
    join phrases x on x.lang = c.lang and x.w = c.w[1:k] join phrases y on y.lang = c.lang and y.w = c.w[k + 1:c.m] join totals t on t.lang = c.lang),
lowest as (select * from cuts qualify row_number() over (partition by lang, w order by score, k) = 1),
ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(w, ' ')) as rank, array_to_string(w, ' ') as phrase, a, l, r, n, score
    from lowest)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked where rank <= 2000
"""

OP13 = """
with v as (
    select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
        list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
parts as (select vec_id, unnest(x) as c, generate_subscripts(x, 1) as i from v),
sums as (
    select q.vec_id as anchor_id, e.vec_id, sum(q.c * e.c) as score
    from parts q join parts e on q.i = e.i and q.vec_id <> e.vec_id where q.vec_id % 100 = 0 group by all),
scores as (
    select s.*, a.label = e.label as same from sums s join v a on a.vec_id = s.anchor_id join v e on e.vec_id = s.vec_id),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
    select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
    from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, cast(positive_score as bigint) as positive_score, cast(negative_score as bigint) as negative_score
from ranked where rank <= 5
"""

ORACLE_SQL = {"op3_line_dedup": OP3, "op5_quality_rules": OP5, "op7_topk": OP7, "op8_mixing": OP8, "op12_collocations": OP12, "op13_hard_negatives": OP13}
