"""DuckDB SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

HOST = "regexp_replace(lower({0}), '^www\\.', '')"

RANKED = f"""
hs as (select {HOST.format('host')} as h, max(trust) as trust from host_scores group by 1),
raw as (select query_id, crawl_doc, min(case when not isnan(text_relevance) then text_relevance end) as text_relevance, min(case when not isnan(proximity) then proximity end) as proximity,
  min(case when not isnan(quality.factor) then quality.factor end) as quality, min(case when not isnan(trust) then trust end) as trust
  from hits left join hs on hs.h = {HOST.format('host')} group by 1, 2),
g as (select *, count(*) over (partition by query_id) as n,
  case when text_relevance is not null then rank() over (partition by query_id order by text_relevance desc nulls last) - 1 end as g1,
  case when proximity is not null then rank() over (partition by query_id order by proximity desc nulls last) - 1 end as g2,
  case when quality is not null then rank() over (partition by query_id order by quality desc nulls last) - 1 end as g3,
  case when trust is not null then rank() over (partition by query_id order by trust desc nulls last) - 1 end as g4 from raw)"""

LINES = f"""
one as (select crawl_doc, {HOST.format('any_value(host)')} as host, any_value(text) as text from records where text is not null group by crawl_doc),
e as (select crawl_doc, host, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from one),
l as (select crawl_doc, host, line_no, trim(regexp_replace(lower(line), '[^\\p{{L}}]+', ' ', 'g')) as w from e),
k as (select * from l where length(replace(w, ' ', '')) >= 8),
n as (select host, count(*) as n from one where not regexp_matches(text, '^[\\s\\p{{Z}}]*$') group by host),
c as (select host, w, count(distinct crawl_doc) as c from k group by 1, 2),
hot as (select c.host, c.w from c join n on c.host is not distinct from n.host where c.c >= 5 and c.c * 5 >= n.n)"""

SQL = {
    "p3_found": f"with {RANKED} select query_id, crawl_doc from g where 10 * g1 < n and 10 * g2 < n and 10 * g3 < n and 10 * g4 < n",
    "p3_ranking": f"""
with {RANKED},
r as (select *, coalesce(g1, count(text_relevance) over q) + 1 as r1, coalesce(g2, count(proximity) over q) + 1 as r2, coalesce(g3, count(quality) over q) + 1 as r3, coalesce(g4, count(trust) over q) + 1 as r4 from g window q as (partition by query_id)),
wt as (select max(proximity) as w2, max(quality) as w3, max(authority) as w4 from rank_weights where weight_set = 'standard'),
u as (select query_id, crawl_doc, unnest([{{'r': r1, 'w': 1.0}}, {{'r': r2, 'w': w2}}, {{'r': r3, 'w': w3}}, {{'r': r4, 'w': w4}}], recursive := true), (r1 + r2 * w2 + r3 * w3 + r4 * w4) / (1.0 + w2 + w3 + w4) as mean_rank from r, wt),
m as (select query_id, crawl_doc, mean_rank, r, sum(w) over (partition by query_id, crawl_doc order by r) as run, sum(w) over (partition by query_id, crawl_doc) as total from u),
f as (select query_id, crawl_doc, round(any_value(mean_rank), 6) as mean_rank, min(case when run >= total / 2 then r end)::double as median_rank from m group by 1, 2)
select query_id, crawl_doc, row_number() over (partition by query_id order by median_rank, mean_rank, crawl_doc) as position, median_rank, mean_rank from f""",
    "p5_found": f"with {LINES} select distinct k.crawl_doc, k.line_no from k join hot on k.host is not distinct from hot.host and k.w = hot.w",
    "p5_clean": f"""
with {LINES},
gone as (select k.crawl_doc, k.line_no from k join hot on k.host is not distinct from hot.host and k.w = hot.w),
left_ as (select crawl_doc, string_agg(line, chr(10) order by line_no) as text from e anti join gone using (crawl_doc, line_no) group by 1)
select o.crawl_doc, case when one.text is null then null else coalesce(left_.text, '') end as text from (select distinct crawl_doc from records) o left join one using (crawl_doc) left join left_ using (crawl_doc)""",
    "p6_found": """
with t as (select crawl_doc, lower(trim(nfc_normalize(term))) as term from tokens),
n as (select count(distinct crawl_doc) as n from t where crawl_doc is not null),
f as (select term, count(distinct crawl_doc) as records from t where term is not null and term <> '' and octet_length(encode(term)) <= 40 and not regexp_matches(term, '^[0-9]{13,}$') group by term)
select term, case when records <= 2 then 'rare' else 'common' end as mark from f, n where records <= 2 or records > 0.3 * n""",
    "p6_terms": """
with one as (select crawl_doc, field, token_position, min(term) as term from tokens group by 1, 2, 3),
t as (select crawl_doc, lower(trim(nfc_normalize(term))) as term from one),
n as (select count(distinct crawl_doc) as n from t where crawl_doc is not null),
f as (select term, count(*) as occurrences, count(distinct crawl_doc) as records from t where term is not null and term <> '' and octet_length(encode(term)) <= 40 and not regexp_matches(term, '^[0-9]{13,}$') group by term),
r as (select term, max(doc_frequency) as reported from term_scores where term is not null group by 1)
select f.term, occurrences::bigint as occurrences, records, case when records <= 2 then 'rare' when records > 0.3 * n then 'common' end as mark, reported from n, f left join r using (term)""",
    "p1_found": f"""
with one as (select crawl_doc, any_value(text) as text from records where text is not null group by crawl_doc),
w as (select crawl_doc, {WORDS.format('text')} as w from one),
s as (select distinct crawl_doc, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 80),
n as (select crawl_doc, count(*) as n from s group by crawl_doc),
b as (select x.crawl_doc as a, y.crawl_doc as b, count(*) as both_n from s x join s y on x.g = y.g and x.crawl_doc < y.crawl_doc group by 1, 2)
select b.a as crawl_doc_a, b.b as crawl_doc_b from b join n na on na.crawl_doc = b.a join n nb on nb.crawl_doc = b.b
where b.both_n >= 0.7 * (na.n + nb.n - b.both_n)""",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p8_found": f"""
with d as (select doc_id, {WORDS.format('text')} as w from documents where text is not null),
i as (select item_id, {WORDS.format('passage')} as w from eval_items where passage is not null),
dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from d where len(w) >= 13),
ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from i where len(w) >= 13)
select distinct doc_id, item_id from dg join ig using (g)""",
    "p9_found": """
with w as (select doc_id, unnest(range(0, length(text) - 199)) as s, text from documents where length(text) >= 200),
g as (select doc_id, s, md5(substr(text, s + 1, 200)) as h from w),
c as (select h from g group by h having min(doc_id) < max(doc_id)),
m as (select doc_id, s, lag(s) over (partition by doc_id order by s) as p from g where h in (select h from c)),
r as (select doc_id, s, sum(case when p is null or s > p + 200 then 1 else 0 end) over (partition by doc_id order by s) as run from m)
select doc_id, min(s) as span_start, max(s) + 200 as span_end from r group by doc_id, run""",
}

SQL["p9_portion"] = f"""
with sp as ({SQL['p9_found']}),
k as (select doc_id, count(*) as spans, sum(span_end - span_start)::bigint as shared_chars from sp group by 1)
select d.doc_id, coalesce(length(text), 0)::bigint as chars, coalesce(spans, 0)::bigint as spans, coalesce(shared_chars, 0)::bigint as shared_chars from documents d left join k using (doc_id)"""

SQL["p8_leaks"] = f"""
with d as (select doc_id, {WORDS.format('text')} as w from documents where text is not null),
i as (select item_id, {WORDS.format('passage')} as w from eval_items where passage is not null),
dg as (select doc_id, unnest(range(0, len(w) - 12)) as i, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from d where len(w) >= 13),
ig as (select item_id, unnest(range(0, len(w) - 12)) as j, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from i where len(w) >= 13),
m as (select doc_id, item_id, i, i - j as diagonal, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from dg join ig using (g))
select distinct doc_id, item_id, min(i)::bigint as first_word, (max(i) - min(i) + 13)::bigint as words from m group by doc_id, item_id, diagonal, island"""

SQL["p1_classes"] = f"""
with recursive found as ({SQL['p1_found']}),
one as (select crawl_doc, any_value(text) as text from records where text is not null group by crawl_doc),
w as (select crawl_doc, {WORDS.format('text')} as w from one),
rep as (select crawl_doc, min(crawl_doc) over (partition by w) as rep from w where len(w) >= 80),
l as (select distinct x.rep as a, y.rep as b from found join rep x on x.crawl_doc = crawl_doc_a join rep y on y.crawl_doc = crawl_doc_b where x.rep <> y.rep),
e as (select a, b from l union select b, a from l),
r as (select rep as node, rep as root from rep where rep = crawl_doc union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as class_id from r group by 1),
deg as (select a as node, count(*) as links from e group by 1)
select rep.crawl_doc, class_id, coalesce(links, 0)::bigint as links from rep join c on c.node = rep.rep left join deg on deg.node = rep.rep"""

#: The tail of chi-square by the same formula as the operator, the step-up rule over exact ranks.
SQL["p5_tests"] = f"""
with {LINES},
tot as (select sum(n)::bigint as records from n),
al as (select w, sum(c)::bigint as n_all from c group by 1),
t0 as (select c.host, c.w, c.c as n_in, n.n as records_in, n_all - c.c as n_out, records - n.n as records_out from c join n on c.host is not distinct from n.host join al using (w), tot where c.c >= 5),
t1 as (select *, {{both}} as raw from t0),
t2 as (select *, case when n_in * records_out >= n_out * records_in then greatest(0.0, raw) else -greatest(0.0, raw) end as llr from t1),
t3 as (select *, sqrt(greatest(llr, 0) / 2) as x, 1.0 / (1 + 0.3275911 * sqrt(greatest(llr, 0) / 2)) as t from t2),
t4 as (select *, case when llr > 0 then (ln((case when x < 2.5 then ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t else 0.5641895835477563 / (x + 0.5 / (x + 1.0 / (x + 1.5 / (x + 2.0 / (x + 0.5))))) end) / 2) - x * x) / ln(10.0) else log10(0.5) end as p from t3),
t5 as (select *, count(*) over (order by p) as i, count(*) over () as m from t4),
lim as (select max(p) as p from t5 where p <= log10(0.01 * i / m)),
t6 as (select t5.*, coalesce(t5.p <= lim.p, false) as significant from t5, lim)
select host, n_in, records_in, n_out, records_out, round(llr, 4) as llr, significant,
  case when n_in * 5 >= records_in then case when significant then 'excess' when n_in + n_out >= 0.02 * (records_in + records_out) then 'widespread' end end as path from t6"""


def _x_log_x(n: str) -> str:
    return f"(case when {n} > 0 then ({n}) * ln({n}) else 0 end)"


def _both(k: str, n: str) -> str:
    return f"({_x_log_x(k)} + {_x_log_x(f'{n} - ({k})')} - {_x_log_x(n)})"


SQL["p5_tests"] = SQL["p5_tests"].replace("{both}", f"2.0 * ({_both('n_in', 'records_in')} + {_both('n_out', 'records_out')} - {_both('n_in + n_out', '(records_in + records_out)')})")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
