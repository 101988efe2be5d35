"""DuckDB SQL for the corpus queries that SQL can express.

The others need a tokenizer (1, 3), a knapsack (2), XXH64 (4: the windows and lines of a document; 7), a media container (6), a
keyed Feistel network (8), a markup parser (9) or a tokenizer (13): the tests hold them against brute force.
"""

from __future__ import annotations

from .queries import URL_RULES
from .urls import ADDRESS, MAX_BAD, MAX_STRENGTH, MIN_STRENGTH, TWO_LABELS, Z

SUBSTRINGS = r"""with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, k, array_to_string(w[k:k + 19], ' ') as words from texts, unnest(range(1, len(w) - 18)) as t(k)),
firsts as (select words, min((doc_id, k)) as first from windows group by words having count(*) > 1),
gone as (select distinct doc_id, p from (select x.doc_id, x.k from windows x join firsts f on f.words = x.words where (x.doc_id, x.k) > f.first), unnest(range(k, k + 20)) as t(p)),
places as (select doc_id, p, w[p] as word from texts, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select a.doc_id, string_agg(word, ' ' order by a.p) as s from places a left join gone g on g.doc_id = a.doc_id and g.p = a.p where g.p is null group by a.doc_id)
select t.doc_id, len(w)::bigint as n_words, (select count(*) from gone g where g.doc_id = t.doc_id) as n_removed, sha256(coalesce(s, '')) as kept_sha256 from texts t left join kept k on k.doc_id = t.doc_id"""

_NAME = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
_LAST = lambda n: f"array_to_string(string_split({_NAME}, '.')[-{n}:], '.')"
_PART = lambda two, one: f"case when regexp_matches({_NAME}, '{ADDRESS}') then {_NAME} when regexp_matches({_LAST(2)}, '{TWO_LABELS}') then {_LAST(two)} else {_LAST(one)} end"


def _strength(level: str) -> str:
    """One number from groups (n, k, prior), as the operator finds it."""
    return f"""(select case when spread is null or spread <= one or many <= one then {MAX_STRENGTH} else least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, (many - one) / (spread - one) - 1)) end from
  (select sum(n * (k / n - prior) * (k / n - prior)) as spread, sum(prior * (1 - prior)) as one, sum(n * prior * (1 - prior)) as many from {level} where n > 0))"""


def _rules() -> str:
    cases = []
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        cases.append(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then struct_pack(verdict := '{verdict}', rule := '{rule}')")
    return "case " + " ".join(cases) + " end"


URLS = f"""with parsed as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
outcomes as (select doc_id, bool_or(quality = 0 or toxic = 1) as bad from labels group by doc_id),
hosts as (select host, {_PART(2, 1)} as suffix, {_PART(3, 2)} as domain,
  count(bad)::double as n, (count(*) filter (bad))::double as k from parsed left join outcomes on doc_id = page_id group by host),
l1 as (select suffix, sum(n) as n, sum(k) as k, (select (sum(k) + 0.5) / (sum(n) + 1) from hosts) as prior from hosts group by suffix),
m1 as (select suffix, (k + s * prior) / (n + s) as prior from l1, (select {_strength('l1')} as s)),
l2 as (select h.suffix, domain, sum(n) as n, sum(k) as k, any_value(m1.prior) as prior from hosts h join m1 on m1.suffix = h.suffix group by h.suffix, domain),
m2 as (select suffix, domain, (k + s * prior) / (n + s) as prior from l2, (select {_strength('l2')} as s)),
l3 as (select h.host, n, k, m2.prior from hosts h join m2 on m2.suffix = h.suffix and m2.domain = h.domain),
ab as (select host, k + s * prior as a, n - k + s * (1 - prior) as b from l3, (select {_strength('l3')} as s)),
scored as (select host, a / (a + b) as mean, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from ab),
ruled as (select page_id, host, path, {_rules()} as m from parsed)
select page_id, r.host, path, m.rule as rule, coalesce(m.verdict, case when low > {MAX_BAD} then 'block' else 'allow' end) as verdict, round(mean, 6) as bad_rate, round(low, 6) as bad_rate_low
from ruled r join scored s on s.host = r.host"""



def _clusters(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Every round spelled out: centroids c0..c10 by component, distances d0..d10 and assignments a0..a10 by row."""
    out = [
        f"""kept as (select row_number() over () as row, vec_id, embedding from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}),
vectors as materialized (select row, generate_subscripts(embedding, 1) as pos, floor(1024 * unnest(embedding)::double)::bigint as x from kept),
firsts as (select row, row_number() over (order by sha256('3:' || vec_id), embedding) - 1 as j from kept order by j limit {k}),
c0 as materialized (select j, pos, x as c from firsts join vectors using (row))"""
    ]
    for r in range(rounds + 1):
        out.append(f"d{r} as materialized (select row, j, sum((x - c) * (x - c))::bigint as d from vectors join c{r} using (pos) group by row, j)")
        out.append(f"a{r} as materialized (select row, min(d) as distance, min((d, j))[2] as j from d{r} group by row)".replace("min((d, j))[2]", "arg_min(j, (d, j))"))
        if r < rounds:
            out.append(f"s{r} as (select j, pos, sum(x)::hugeint as s, count(*) as n from a{r} join vectors using (row) group by j, pos)")
            out.append(f"c{r + 1} as materialized (select j, pos, case when n is null then c else ((s - ((s % n) + n) % n) // n)::bigint end as c from c{r} left join s{r} using (j, pos))")
    return f"""with {", ".join(out)},
digests as (select j, sha256(string_agg(c::varchar, ',' order by pos)) as centroid_sha256 from c{rounds} group by j),
sums as (select j, sum(distance)::bigint as cluster_inertia from a{rounds} group by j)
select vec_id, j::int as cluster, distance, cluster_inertia, (select sum(cluster_inertia) from sums)::bigint as inertia, centroid_sha256
from a{rounds} join kept using (row) join digests using (j) join sums using (j)"""


AUDIT = r"""with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
masks as (select doc_id, part, (case when len(w) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
  + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
  + (case when min(doc_id) over (partition by t) < doc_id then 16 else 0 end) as mask from words),
marked as (select part, mask, exists (select 1 from labels l where l.doc_id = m.doc_id and quality = 1) as good, exists (select 1 from labels l where l.doc_id = m.doc_id and toxic = 1) as toxic from masks m),
counts as materialized (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as t from marked group by part, mask),
f(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (select o.l || p.l || q.l || r.l || s.l as filter_order from f o, f p, f q, f r, f s where (1 << o.b::int) | (1 << p.b::int) | (1 << q.b::int) | (1 << r.b::int) | (1 << s.b::int) = (1 << 1) | (1 << 2) | (1 << 4) | (1 << 8) | (1 << 16)),
steps as (select filter_order, k::int as step, f.b as bit, (select coalesce(sum(x.b), 0) from f x where instr(filter_order, x.l) < k)::int as before from orders, range(1, 6) as t(k), f where f.l = filter_order[k]),
filled as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & before <> 0 and mask & bit <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(g) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost, coalesce(sum(t) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from counts, steps group by part, filter_order, step, bit, before)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from filled"""

SQL: dict[str, str] = {"op5_substring_dedup": SUBSTRINGS, "op10_url_reputation": URLS, "op11_centroid_clustering": _clusters(), "op12_filter_interactions": AUDIT}
