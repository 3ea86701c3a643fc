"""DuckDB SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

from ..functions.text import FIELDS
from ..functions.urls import SESSIONS, SKIPPED_EXTENSIONS, TRACKING
from ..operators.query import Query, parse
from ..operators.search import Weights
from . import queries as q

NODE = r"regexp_replace(regexp_replace(lower(regexp_extract({0}, '^(?:[^:/?#]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '^www\.', '')"
RAW_HOST = "regexp_extract({0}, '^(?:[^:/?#]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)"
#: All hosts of the test tables end in one label that is no listed suffix.
SITE = r"regexp_extract({0}, '((?:[^.]+\.)?[^.]+)$', 1)"
PATH = "regexp_extract({0}, '^[^:/?#]*://[^/?#]*([^?#]*)', 1)"
PAIRS = "list_transform(list_filter(string_split(regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: case when contains(p, '=') then p else p || '=' end)"

DOCS = "docs as (select crawl_doc, any_value(url) as url, any_value(final_url) as final_url, any_value(host) as host, any_value(fetched_at) as fetched_at, any_value(status) as status, any_value(depth) as depth, any_value(fingerprint) as fingerprint, any_value(title) as title, any_value(text) as text, any_value(headings) as headings, any_value(links) as links, any_value(quality) as quality from records where crawl_doc is not null group by crawl_doc)"
KEPT = r"kept as (select * from docs where text is not null and regexp_matches(text, '[^\s\p{Z}]'))"

LINKS = f"""known as (select distinct unnest([url, final_url]) as url from docs),
flat as (select crawl_doc, unnest(range(0, len(links))) as link_no, {NODE.format('final_url')} as src, unnest(links).url as url, unnest(links).anchor as anchor, coalesce(unnest(links).nofollow, false) as nofollow from docs where final_url is not null and {NODE.format('final_url')} <> ''),
ln as (select *, {NODE.format('url')} as dst, {SITE.format('src')} as site_src, trim(lower(trim(regexp_replace(coalesce(anchor, ''), '[\\s\\p{{Z}}]+', ' ', 'g')))) as phrase from flat),
classed as (select ln.*, case when nofollow then 'nofollow' when ln.url is null or ln.url not in (select url from known where url is not null) then 'uncrawled' when site_src = {SITE.format('dst')} then 'same_site' when phrase = '' then 'blank' when length(phrase) > 80 then 'too_long' else 'candidate' end as outcome from ln)"""

ANCHORS = f"""{LINKS},
firsts as (select url, phrase, min(crawl_doc * 1000000 + link_no) as arrival from classed where outcome = 'candidate' group by 1, 2),
accepted as (select url, phrase from (select *, row_number() over (partition by url order by arrival) as n from firsts) where n <= 12),
turns as (select crawl_doc, 0 as turn, url from docs where url is not null union all select crawl_doc, 1, final_url from docs where final_url is not null and url is distinct from final_url),
queued as (select crawl_doc, phrase, row_number() over (partition by crawl_doc order by turn, phrase) as n, sum(octet_length(encode(phrase)) + 1) over (partition by crawl_doc order by turn, phrase rows unbounded preceding) as reach from turns join accepted using (url)),
stops as (select crawl_doc, min(case when (case when n = 1 then reach else reach - 1 end) > 400 then n end) as stop from queued group by 1),
anchored as (select crawl_doc, string_agg(phrase, ' ' order by n) as anchor from queued join stops using (crawl_doc) where stop is null or n < stop group by 1)"""


def _index(anchors: bool) -> str:
    anchor = "coalesce(anchor, '')" if anchors else "''"
    parts = ["text", "coalesce(title, '')", "array_to_string(coalesce(headings, []), ' ')", "regexp_replace(url, '^[^:/?#]*://', '')", anchor]
    fields = " union all ".join(f"select crawl_doc, {i} as field, list_filter(regexp_split_to_array({p}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as w from {'kept left join anchored using (crawl_doc)' if anchors and i == 4 else 'kept'}" for i, p in enumerate(parts))
    return f"""{DOCS}, {KEPT}{', ' + ANCHORS if anchors else ''},
f as ({fields}),
allw as (select crawl_doc, field, unnest(range(0, len(w))) as position, lower(unnest(w)) as term from f),
tok as (select * from allw where octet_length(encode(term)) <= 40 and not regexp_matches(term, '^[0-9]{{13,}}$')),
lens as (select crawl_doc, {', '.join(f"coalesce(max(case when field = {i} then position + 1 end), 0)::int as len_{n}" for i, n in enumerate(FIELDS))} from kept left join tok using (crawl_doc) group by 1),
base as (select crawl_doc, 0 as b0, len_body + 1000 as b1, len_body + len_title + 2000 as b2, len_body + len_title + len_heading + 3000 as b3, len_body + len_title + len_heading + len_url + 4000 as b4 from lens),
pos as (select term, crawl_doc, field, position + case field when 0 then b0 when 1 then b1 when 2 then b2 when 3 then b3 else b4 end as p from tok join base using (crawl_doc)),
post as (select term, crawl_doc, {', '.join(f"sum((field = {i})::int)::int as c_{n}" for i, n in enumerate(FIELDS))} from pos group by 1, 2),
dict as (select term, count(*) as df from post group by 1),
stats as (select count(*) as n_docs, {', '.join(f"avg(len_{n}) as avg_{n}" for n in FIELDS)} from lens)"""


THOUSANDTHS = "floor(least(greatest(coalesce({0}, 0)::float * 1000::float, 0::float), 1000::float))::double / 1000.0"
QUALITY = "least(greatest(least(greatest(tr, 0), 0.5) / 0.5 * (1 - least(greatest(ld, 0), 1)) / (1 + sc / 15.0), 0), 1)"


def _matched(i: int, query: Query) -> str:
    """CTEs m<i> (crawl_doc) of one query's matches and s<i> of its spans."""
    lst = lambda ts: ", ".join("'" + t.replace("'", "''") + "'" for t in ts)
    holds = lambda p: f"select crawl_doc from pos join (values {', '.join(f'({k}, $${t}$$)' for k, t in enumerate(p))}) v(place, term) using (term) group by crawl_doc, p - place having count(distinct place) = {len(p)}"
    if query.empty:
        return f"m{i} as (select crawl_doc from docs where false), s{i} as (select crawl_doc, null::bigint as span from docs where false)"
    n = len(query.terms)
    where = [f"crawl_doc in ({holds(p)})" for p in query.phrases]
    where += [f"crawl_doc not in (select crawl_doc from post where term in ({lst(query.excluded)}))"] * bool(query.excluded)
    where += [f"crawl_doc not in ({holds(p)})" for p in query.excluded_phrases]
    where += [f"crawl_doc in (select crawl_doc from kept where regexp_replace(lower({RAW_HOST.format('url')}), '^www\\.', '') = '{query.site}')"] * bool(query.site)
    held = f"select crawl_doc from post where term in ({lst(query.terms)}) group by 1 having count(*) = {n}"
    matched = f"m{i} as (select crawl_doc from ({held}) {'where ' + ' and '.join(where) if where else ''})"
    if n < 2:
        return matched + f", s{i} as (select crawl_doc, null::bigint as span from m{i})"
    lasts = ", ".join(f"last_value(case when term = $${t}$$ then p end ignore nulls) over w as l{k}" for k, t in enumerate(query.terms))
    every = ", ".join(f"l{k}" for k in range(n))
    known = " and ".join(f"l{k} is not null" for k in range(n))
    return matched + f", s{i} as (select crawl_doc, min(case when {known} then p - least({every}) end) as span from (select crawl_doc, p, {lasts} from pos join m{i} using (crawl_doc) where term in ({lst(query.terms)}) window w as (partition by crawl_doc order by p rows between unbounded preceding and current row)) group by 1)"


def _scored(texts: dict[int, str], w: Weights = Weights()) -> str:
    tf = " + ".join(f"{getattr(w, n)} * c_{n} / (case when avg_{n} > 0 then 1 - {getattr(w, f'b_{n}')} + {getattr(w, f'b_{n}')} * len_{n} / avg_{n} else 1 end)" for n in FIELDS)
    parsed = {i: parse(t) for i, t in texts.items()}
    each = ", ".join(_matched(i, x) for i, x in parsed.items())
    terms = " union all ".join(f"select {i} as query_id, crawl_doc, term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) as idf, {tf} as tf from post join m{i} using (crawl_doc) join dict using (term) join lens using (crawl_doc), stats where term in ({', '.join('$$' + t + '$$' for t in x.terms) or 'null'})" for i, x in parsed.items())
    spans = " union all ".join(f"select {i} as query_id, {len(x.terms)} as n, crawl_doc, span from s{i}" for i, x in parsed.items())
    return f"""{_index(True)}, {each},
ts as (select *, idf * tf / ({w.k1} + tf) as contribution from ({terms})),
sp as ({spans}),
rel as (select query_id, crawl_doc, sum(contribution) as rel from ts group by 1, 2),
q3 as (select crawl_doc, {THOUSANDTHS.format('quality.text_ratio')} as tr, {THOUSANDTHS.format('quality.link_density')} as ld, coalesce(quality.scripts, 0) as sc, regexp_replace(lower({RAW_HOST.format('url')}), '^www\\.', '') as site_key from kept),
parts as (select rel.query_id, rel.crawl_doc, rel, {w.quality} * {QUALITY} as qual, {w.authority} * coalesce(least(greatest(factor_indegree, 0), 1), 0) as auth, span, case when n > 1 and span is not null then {w.proximity} * n / (1.0 + greatest(span - (n - 1), 0)) else 0 end as prox
  from rel join q3 using (crawl_doc) join sp using (query_id, crawl_doc) left join host_scores on host_scores.host = site_key),
scored as (select *, round(rel + prox + auth + qual, 6) as score, round(rel + auth + qual, 6) as first_score, count(*) over (partition by query_id) as matched from parts)"""


def search_sql(texts: dict[int, str]) -> str:
    return f"with {_scored(texts)} select query_id, rank, crawl_doc, score, matched from (select *, row_number() over (partition by query_id order by score desc, crawl_doc) as rank from scored) where rank <= 10"


GRAPH = f"""{DOCS},
raw as (select crawl_doc, unnest(range(0, len(links))) as link_no, {NODE.format('final_url')} as src, unnest(links).url as url, coalesce(unnest(links).nofollow, false) as nofollow from docs where final_url is not null and {NODE.format('final_url')} <> ''),
gl as (select *, {NODE.format('url')} as dst from raw),
go as (select *, case when nofollow then 'nofollow' when dst is null or dst = '' then 'unparseable' when {SITE.format('src')} = {SITE.format('dst')} then 'same_site' else 'counted' end as o from gl),
gr as (select *, case when o = 'counted' and row_number() over (partition by crawl_doc, dst, o order by link_no) > 1 then 'repeat' else o end as outcome from go),
edges as (select src, dst, count(*) as pages from gr where outcome = 'counted' group by 1, 2),
pg as (select {NODE.format('final_url')} as host, count(*) as pages from docs where final_url is not null group by 1 having host <> ''),
seeds as (select host from host_scores order by trust desc nulls last, host limit 3)"""


def _hosts(seeds: bool) -> str:
    return f"hs as (select host from pg union select src from edges union select dst from edges{' union select host from seeds' if seeds else ''})"


def _trust(rounds: int) -> str:
    steps = [f"t0 as (select host, case when host in (select host from seeds) then 1.0 / (select count(*) from seeds) else 0.0 end as jump, (select count(*) from edges where src = host) as outs from hs), r0 as (select host, jump as t from t0)"]
    for i in range(1, rounds + 1):
        steps.append(f"g{i} as (select dst as host, sum(t / outs) as got from edges join r{i - 1} on src = host join t0 using (host) group by 1), r{i} as (select t0.host, 0.85 * (coalesce(got, 0) + (select coalesce(sum(t), 0) from r{i - 1} join t0 using (host) where outs = 0) * jump) + 0.15 * jump as t from t0 left join g{i} on g{i}.host = t0.host)")
    return ", ".join(steps)


def _normal(source: str, name: str) -> str:
    """CTE ``name``: the rows of source with the normal form of their url."""
    return f"""{name}0 as (select *, lower(regexp_extract(url, '^([^:/?#]*)://', 1)) as scheme, lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)) as auth, {PATH.format('url')} as path, list_filter({PAIRS.format('url')}, lambda p: not list_contains([{', '.join(f"'{x}'" for x in TRACKING + SESSIONS)}], lower(string_split(p, '=')[1]))) as pairs from {source}),
{name} as (select * exclude (scheme, auth, path, pairs), case when regexp_matches(url, '^(?i:https?)://') and {RAW_HOST.format('url')} <> '' and octet_length(encode(url)) <= 2048 then scheme || '://' || regexp_replace(auth, case when scheme = 'http' then ':80$' else ':443$' end, '') || (case when path = '' then '/' else path end) || (case when len(pairs) > 0 then '?' || array_to_string(pairs, '&') else '' end) end as normal from {name}0)"""


NORMAL = f"{DOCS}, u as (select crawl_doc, url, depth from docs), {_normal('u', 'normed')}"
KEY = f"lower({RAW_HOST.format('{0}')}) || (case when regexp_matches({PATH.format('{0}')}, '^.+/$') then regexp_replace({PATH.format('{0}')}, '/$', '') else {PATH.format('{0}')} end) || (case when len({PAIRS.format('{0}')}) > 0 then '?' || array_to_string(list_sort({PAIRS.format('{0}')}), '&') else '' end)"
TRAP = f"""case when depth > 4 then 'depth' when len(list_filter(string_split({PATH.format('{0}')}, '/'), lambda s: s <> '')) > 12 then 'segments'
 when len(list_filter(string_split(regexp_extract({{0}}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')) > 4 then 'parameters'
 when lower(regexp_extract({PATH.format('{0}')}, '\\.([^./]*)/*$', 1)) in ({', '.join(f"'{x}'" for x in SKIPPED_EXTENSIONS)}) then 'extension'
 when len(list_filter(list_filter(string_split({PATH.format('{0}')}, '/'), lambda s: octet_length(encode(s)) >= 2), lambda s: len(list_filter(string_split({PATH.format('{0}')}, '/'), lambda o: o = s)) > 3)) > 0 then 'repetition'
 when len(list_filter(string_split({PATH.format('{0}')}, '/'), lambda s: regexp_matches(s, '^[0-9]{{{{4}}}}$') and (try_cast(s as int) < 1990 or try_cast(s as int) > 2100))) > 0 then 'date' end"""

MEASURED = """judged as (select lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) as query, url, max(grade) as grade from judgments where grade is not null and url is not null and query is not null group by 1, 2),
names as (select distinct query_id, lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))) as query from term_scores where query_text is not null),
h as (select query_id, crawl_doc, min(url) as url, max(case when not isnan(text_relevance) then text_relevance end) as one, max(coalesce(case when not isnan(text_relevance) then text_relevance end, 0) + coalesce(case when not isnan(proximity) then proximity end, 0) + 0.4 * coalesce(case when not isnan(quality.factor) then quality.factor end, 0)) as two from hits group by 1, 2),
ideal as (select query, sum(case when place <= 10 then (pow(2, grade) - 1) / log2(place + 1) else 0 end) as ideal, sum((grade > 0)::int) as relevant from (select *, row_number() over (partition by query order by grade desc, url) as place from judged) group by 1)"""


def _metrics(name: str, column: str) -> str:
    return f"""{name}r as (select * from (select query, url, row_number() over (partition by query_id order by round({column}, 6) desc nulls last, crawl_doc) as rank from h join names using (query_id)) where rank <= 10),
{name}g as (select query, count(*) as returned, sum(coalesce((grade > 0)::int, 0)) as found, count(grade) as seen, sum(coalesce((pow(2, grade) - 1) / log2(rank + 1), 0)) as dcg, min(case when grade > 0 then rank end) as first from {name}r left join judged using (query, url) group by 1),
{name} as (select ideal.query, coalesce(returned, 0) as returned, case when ideal > 0 then coalesce(dcg, 0) / ideal else 1.0 end as ndcg, case when returned > 0 then found / returned else 0.0 end as precision, case when first is not null then 1.0 / first else 0.0 end as reciprocal_rank, case when relevant > 0 then coalesce(found, 0) / relevant else 1.0 end as recall, case when returned > 0 then seen / returned else 0.0 end as coverage from ideal left join {name}g using (query))"""


ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in ("ndcg", "precision", "reciprocal_rank", "recall", "coverage"))
FULL = _index(True)


def oracle_sql() -> dict[str, str]:
    lens = ", ".join(f"len_{n}" for n in FIELDS)
    out = {
        "tokens": f"with {_index(False)} select crawl_doc, field::bigint as field, position, term from tok",
        "field_length": f"with {_index(False)} select crawl_doc, {lens} from lens where crawl_doc in (select crawl_doc from tok)",
        "postings": f"with {FULL} select term, crawl_doc, {', '.join(f'c_{n}' for n in FIELDS)}, (select string_agg(p::varchar, ' ' order by p) from pos where pos.term = post.term and pos.crawl_doc = post.crawl_doc) as positions from post",
        "dictionary": f"with {FULL} select * from dict",
        "corpus_stats": f"with {FULL} select n_docs, {', '.join(f'round(avg_{n}, 6) as avg_{n}' for n in FIELDS)} from stats",
        "host_table": f"with {DOCS}, {KEPT} select lower({RAW_HOST.format('url')}) as host, count(*) as documents from kept group by 1",
        "doc_table": f"with {FULL} select crawl_doc, lower({RAW_HOST.format('url')}) as host, {lens}, round({THOUSANDTHS.format('quality.text_ratio')}, 3) as text_ratio, round({THOUSANDTHS.format('quality.link_density')}, 3) as link_density, coalesce(quality.scripts, 0) as scripts from kept join lens using (crawl_doc)",
        "segment_ids": f"with {DOCS}, {KEPT} select crawl_doc, ((row_number() over (order by crawl_doc) - 1) // 100)::int as segment from kept",
        "merged_dictionary": f"with {_index(False)} select dict.*, n_docs from dict, stats",
        "index_totals": f"with {FULL} select n_docs as documents, (select count(*) from dict) as terms, (select count(*) from post) as postings, (select count(*) from pos) as positions from stats",
        "position_gaps": f"with {FULL}, g as (select term, crawl_doc - coalesce(lag(crawl_doc) over (partition by term order by crawl_doc), 0) as gap from post) select term, count(*) as gaps, sum(case when gap > 0 then floor(log2(gap)) + 1 else 0 end)::bigint as bits, max(case when gap > 0 then floor(log2(gap)) + 1 else 0 end)::bigint as widest from g group by 1",
        "size_report": f"with {DOCS}, {KEPT} select count(*) as documents, sum(octet_length(encode(text)))::bigint as text_bytes, round(avg(octet_length(encode(text))), 4) as mean_bytes from kept",
        "store_summary": f"with {DOCS}, s as (select coalesce(status, 0) as status, count(*) as n from docs group by 1) select count(*) as pages, count(distinct host) as hosts, sum(octet_length(encode(text)))::bigint as text_bytes, max(depth) as deepest, min(fetched_at) as first_fetch, max(fetched_at) as last_fetch, (select string_agg(status || '=' || n, ' ' order by status) from s) as by_status from docs",
        "point_lookup": f"with {DOCS} select crawl_doc, url, length(text)::int as chars from docs where crawl_doc in (select crawl_doc from hits where query_id = 1)",
        "blank_texts": f"with {DOCS}, {KEPT} select (select count(*) from docs) as records, count(*) as indexed, (select count(*) from docs) - count(*) as skipped from kept",
        "url_hosts": f"with {DOCS} select crawl_doc, {RAW_HOST.format('url')} as host, {NODE.format('url')} as node from docs",
        "url_tokens": f"with {_index(False)} select term, count(*) as occurrences, count(distinct crawl_doc) as documents from tok where field = 3 group by 1",
        "url_keys": f"with {NORMAL} select crawl_doc, normal, {KEY.format('normal')} as key from normed",
        "trap_reasons": f"with {DOCS}, l as (select distinct unnest(links).url as url, depth + 1 as depth from docs), a as (select * from l where regexp_matches(url, '^(?i:https?)://') and {RAW_HOST.format('url')} <> '' and octet_length(encode(url)) <= 2048) select coalesce({TRAP.format('url')}, 'none') as reason, count(*) as links from a group by 1",
        "frontier_admission": f"with {NORMAL}, own as (select distinct {KEY.format('normal')} as key from normed), li as (select crawl_doc, depth + 1 as depth, unnest(range(0, len(links))) as no, unnest(links).url as url, coalesce(unnest(links).nofollow, false) as nofollow from docs), c as (select crawl_doc, depth, no, url from li where not nofollow), {_normal('c', 'cn')}, k as (select *, {KEY.format('normal')} as key from cn), t as (select *, row_number() over (partition by key order by crawl_doc, no) as twin from k) select case when normal is null then 'inadmissible' when key in (select key from own where key is not null) or twin > 1 then 'seen' else coalesce({TRAP.format('normal')}, 'admitted') end as outcome, count(*) as candidates from t group by 1",
        "robots_verdicts": f"with {DOCS}, p as (select crawl_doc, coalesce(nullif({PATH.format('url')}, ''), '/') as path from docs) select crawl_doc, case when regexp_matches(path, '^/archive/.*-5') then true when regexp_matches(path, '^/archive/') then false when regexp_matches(path, '^/.*\\.html$') then false else true end as allowed from p",
        "robots_by_host": f"""with {NORMAL}, k as (select *, {KEY.format('normal')} as key, {NODE.format('normal')} as host, coalesce(nullif({PATH.format('normal')}, ''), '/') as path from normed),
t as (select *, row_number() over (partition by key order by crawl_doc) as twin from k),
a as (select distinct regexp_replace(host, '^www\\.', '') as host, length(host) % 5 as kind from host_scores),
r as (select t.*, kind, case when normal is null then 'inadmissible' when twin > 1 then 'seen' else {TRAP.format('normal')} end as refusal from t left join a on a.host = t.host)
select case when refusal is not null then refusal when kind in (1, 2) then 'robots' when kind = 3 and regexp_matches(path, '^/archive/') and not regexp_matches(path, '^/archive/.*-5') then 'robots' when kind = 4 and regexp_matches(path, '^/.*\\.html$') then 'robots' else 'admitted' end as outcome,
  case when kind = 3 then 7.0 else 0.0 end::double as wait, count(*) as addresses from r group by 1, 2""",
        "kept_pages": f"""with recursive {DOCS}, f as (select fingerprint as f, min(crawl_doc) as arrival, row_number() over (order by min(crawl_doc)) as i from docs where fingerprint is not null and fingerprint <> 0 group by 1),
k as (select 0::bigint as i, []::bigint[] as held union all select f.i, case when len(list_filter(held, lambda x: bit_count(xor(x, f.f)) <= 6)) > 0 then held else list_append(held, f.f) end from k join f on f.i = k.i + 1),
h as (select unnest(held) as f from (select held from k order by i desc limit 1))
select crawl_doc, f.f is null or (f.arrival = crawl_doc and f.f in (select f from h)) as kept from docs left join f on f.f = docs.fingerprint""",
        "front_coding": f"with {FULL}, b as (select term, coalesce(lag(term) over (partition by left(term, 2) order by encode(term)), '') as before from dict), s as (select term, coalesce(list_max(list_filter(range(1, length(term) + 1), lambda i: left(term, i) = left(before, i))), 0) as letters from b) select count(*) as terms, sum(octet_length(encode(term)))::bigint as plain, sum(2 + octet_length(encode(term)) - octet_length(encode(left(term, letters))))::bigint as coded from s",
        "registrable_domains": f"with {DOCS} select distinct {NODE.format('url')} as host, {SITE.format(NODE.format('url'))} as domain from docs",
        "politeness": f"with {DOCS}, t as (select crawl_doc, {NODE.format('url')} as host from docs) select crawl_doc, host, turn, (turn - 1) * 3.0::double as ready from (select *, row_number() over (partition by host order by crawl_doc) as turn from t)",
        "domain_survey": f"""with {DOCS}, o as (select regexp_extract({NODE.format('url')}, '([^.]+)$', 1) as area, quality.words as words, case when status in (401, 403, 429) then 'refused' when coalesce(regexp_matches(text, '(?i)captcha|verify you are human|checking your browser|enable javascript and cookies'), false) then 'challenged' when status between 200 and 299 then 'served' else 'error' end as outcome from docs)
select area, count(*) as domains, {', '.join(f"round(100 * avg((outcome = '{x}')::int), 4) as pct_{x}" for x in ('served', 'refused', 'challenged', 'unreachable'))}, quantile_cont(case when outcome = 'served' then words end, 0.5)::double as median_words, round(avg(case when outcome = 'served' then words end), 4) as mean_words from o group by 1""",
        "search_rescored": f"with {_scored(q.SEARCHES['search_and'])}, cut as (select *, row_number() over (partition by query_id order by first_score desc, crawl_doc) as c from scored) select query_id, rank, crawl_doc, score, matched from (select *, row_number() over (partition by query_id order by score desc, crawl_doc) as rank from cut where c <= 20) where rank <= 10",
        "score_explain": f"with {_scored(q.SEARCHES['search_and'])} select query_id, crawl_doc, round(rel, 6) as text_relevance, round(prox, 6) as proximity, round(qual, 6) as quality, round(auth, 6) as authority, span from (select *, row_number() over (partition by query_id order by score desc, crawl_doc) as rank from scored) where rank <= 10",
        "term_explain": f"with {_scored(q.SEARCHES['search_and'])}, top as (select query_id, crawl_doc from (select *, row_number() over (partition by query_id order by score desc, crawl_doc) as rank from scored) where rank <= 10) select query_id, crawl_doc, term, df, round(idf, 6) as idf, round(tf, 6) as tf, round(contribution, 6) as contribution from ts join top using (query_id, crawl_doc)",
        "proximity_spans": f"with {_scored(q.SEARCHES['search_and'])} select query_id, crawl_doc, span, round(prox, 6) as bonus from parts",
        "host_edges": f"with {GRAPH} select * from edges",
        "link_drop_report": f"with {GRAPH} select outcome, count(*) as links from gr group by 1",
        "in_degree_authority": f"with {GRAPH}, {_hosts(False)}, d as (select hs.host, coalesce(pages, 0) as pages, (select count(*) from edges where dst = hs.host) as in_degree, (select count(*) from edges where src = hs.host) as out_degree from hs left join pg using (host)) select *, round(case when max(in_degree) over () > 0 then least(greatest(ln(1 + in_degree) / ln(1 + max(in_degree) over ()), 0), 1) else 0 end, 6) as factor from d",
        "trustrank_k10": f"with {GRAPH}, {_hosts(True)}, {_trust(10)} select host, round(t, 9) as trust from r10",
        "rank_correlation": "with r as (select row_number() over (order by in_degree desc, host) as p, row_number() over (order by trust desc, host) as q from host_scores where trust is not null and in_degree is not null) select count(*) as hosts, round(case when count(*) > 1 then 1 - 6.0 * sum((p - q) * (p - q))::double / (count(*)::double * (count(*) * count(*) - 1)) end, 6) as rho from r",
        "top_hosts": "select host, in_degree, round(factor_indegree, 6) as factor from host_scores order by factor_indegree desc nulls last, host limit 20",
        "anchor_text": f"with {DOCS}, {ANCHORS} select * from anchored",
        "anchor_report": f"with {DOCS}, {LINKS}, a as (select case when outcome = 'candidate' and row_number() over (partition by url, site_src, phrase order by crawl_doc, link_no) > 1 then 'repeated' else outcome end as outcome from classed) select outcome, count(*) as links from a group by 1",
        "exact_duplicates": "select md5(text) as digest, count(*) as copies, min(doc_id) as first from documents where text is not null group by 1 having count(*) > 1",
        "hamming_pairs": f"with {DOCS}, f as (select distinct fingerprint as f from docs where fingerprint is not null and fingerprint <> 0) select x.f as a, y.f as b, bit_count(xor(x.f, y.f))::bigint as distance from f x join f y on x.f < y.f and bit_count(xor(x.f, y.f)) <= 6",
        "query_metrics": f"with {MEASURED}, {_metrics('one', 'one')} select query, returned, {ROUNDED} from one",
        "eval_summary": f"with {MEASURED}, {_metrics('one', 'one')} select count(*) as queries, {', '.join(f'round(avg({m}), 6) as {m}' for m in ('ndcg', 'precision', 'reciprocal_rank', 'recall', 'coverage'))}, sum((returned = 0)::int)::bigint as empty_results from one",
        "paired_differences": f"with {MEASURED}, {_metrics('one', 'one')}, {_metrics('two', 'two')} select query, round(two.ndcg - one.ndcg, 6) as difference from one join two using (query)",
        "stream_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
        "stream_segments": f"with {_index(False)} select * from dict",
    }
    return out | {name: search_sql(texts) for name, texts in q.SEARCHES.items()}
