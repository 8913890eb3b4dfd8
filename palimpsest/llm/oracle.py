"""The same results in plain SQL, for the operators that SQL can express."""

from __future__ import annotations

from .reputation import LEAST_STRENGTH, LONG_SUFFIXES, MOST_STRENGTH, THRESHOLD, Z

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS3 = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
with iw as (select item_id, w, len(w) as n, least(13, len(w)) as l from (select item_id, {_WORDS3} as w from benchmark) where len(w) > 0),
ig as (select distinct cast(item_id as varchar) as item_id, l, array_to_string(w[i:i + l - 1], ' ') as g from (select item_id, w, l, unnest(range(1, n - l + 2)) as i from iw)),
lens as (select distinct l from ig),
dw as (select doc_id, {_WORDS3} as w from documents),
dg as (select doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') as g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from dw join lens on len(w) >= l)),
hit as (select d.doc_id, d.i, d.l, ig.item_id from dg d join ig on d.l = ig.l and d.g = ig.g),
cov as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(ids, '') as item_ids
from dw left join cov on dw.doc_id = cov.doc_id left join its on dw.doc_id = its.doc_id"""


_SUMS = "sum(k) as k, sum(n) as n, sum(cast(n as double) * n) as squares, count(*) filter (where n > 0) as c, sum(case when n > 0 then cast(k as double) * k / n else 0 end) as kk"


def _strength(p: str) -> str:
    room, noise = "(n - squares / n)", f"({p} * (1 - {p}))"
    between = f"((kk - 2 * {p} * k + {p} * {p} * n - (c - 1) * {noise}) / {room})"
    found = f"case when n > 0 and {room} > 0 and {between} > 0 then {noise} / {between} - 1 else {MOST_STRENGTH} end"
    return f"least(greatest({found}, {LEAST_STRENGTH}), {MOST_STRENGTH})"


def _mean(prior: str, weight: str) -> str:
    return f"(k + {weight} * {prior}) / (n + {weight})"


_RULES = (("www.example.com", "/en/", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("net", "/es/", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("com", "/", "com/", "allow"))


def _case(field: int) -> str:
    return "case " + " ".join(f"when (host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}') then '{r[field]}'" for r in _RULES) + " end"


OP5 = f"""
with parsed as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
ruled as (select *, {_case(2)} as rule, {_case(3)} as rule_verdict from parsed),
h0 as (select host, count(*) filter (where rule_verdict = 'allow') as k, count(rule_verdict) as n, string_split(host, '.') as l from ruled group by host),
h1 as (select *, case when len(l) > 1 and array_to_string(l[-2:], '.') in ({", ".join(f"'{s}'" for s in LONG_SUFFIXES)}) then 2 else 1 end as ns from h0),
hosts as (select host, k, n, array_to_string(l[-ns:], '.') as suffix, case when len(l) <= ns + 1 then host else array_to_string(l[-(ns + 1):], '.') end as domain from h1),
domains as (select domain, suffix, {_SUMS} from hosts group by 1, 2),
suffixes as (select suffix, {_SUMS} from domains group by 1),
t0 as (select {_SUMS} from suffixes), t1 as (select *, (k + 1) / cast(n + 2 as double) as mean from t0),
top as (select mean as prior, {_strength("mean")} as weight from t1),
s1 as (select suffixes.*, {_mean("prior", "weight")} as mean from suffixes, top),
s2 as (select suffix, mean as prior, {_strength("mean")} as weight from s1),
d1 as (select domains.*, {_mean("prior", "weight")} as mean from domains join s2 using (suffix)),
d2 as (select domain, mean as prior, {_strength("mean")} as weight from d1),
h2 as (select host, n, weight, {_mean("prior", "weight")} as mean from hosts join d2 using (domain)),
good as (select host, mean - {Z} * sqrt(mean * (1 - mean) / (n + weight + 1)) >= {THRESHOLD} as good from h2)
select page_id, ruled.host, path, rule, coalesce(rule_verdict, case when good.good then 'allow' else 'block' end) as verdict from ruled join good on ruled.host = good.host"""

OP7 = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: x > 0) as b from embeddings where embedding is not null and vec_id is not null),
d as (select q.vec_id as query_id, v.vec_id as neighbour_id, len(list_filter(range(1, len(q.b) + 1), lambda i: q.b[i] <> v.b[i])) as distance from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by distance, neighbour_id) as rank from d)
select query_id, cast(rank as int) as rank, neighbour_id, cast(distance as int) as distance from r where rank <= 10"""

OP9 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from w where len(w) >= 35)),
again as (select h from g group by h having count(*) > 1),
cov as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 35)) as p from g join again using (h))),
pos as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from w),
kept as (select pos.doc_id, string_agg(word, ' ' order by pos.p) as t, count(*) as n from pos left join cov on pos.doc_id = cov.doc_id and pos.p = cov.p where cov.p is null group by pos.doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id"""

ORACLE_SQL = {"op3_wu_manber_decontamination": OP3, "op5_host_reputation": OP5, "op7_multi_index_topk": OP7, "op9_phrase_automata": OP9}
