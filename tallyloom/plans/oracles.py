"""The core queries in SQL, written independently of the operators, for comparison."""

from __future__ import annotations

from ..functions.text import ALIGN, FILLERS, OPPOSITES

K, LAMBDAS = 5, (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)
METRICS = ["drift_tv", "drift_js", "stance_shift", "stance_div", "stance_onesided", "stance_gap", "poison_in_topk", "poison_share", "in_pool_rate", "mean_score"]

GRP = "nullif(regexp_replace(lower(grp), '[^a-z]', '', 'g'), '')"
TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def fnv(word: str) -> str:
    return f"list_reduce(list_concat([2166136261::bigint], list_transform(string_split({word}, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def mixed(h: str) -> str:
    return f"xor(((xor({h}, {h} >> 15) * 739) & 4294967295), ((xor({h}, {h} >> 15) * 739) & 4294967295) >> 13)"


def drawn(relation: str, *parts: str) -> str:
    """The relation with hh, a 32-bit number drawn by integer counters."""
    m = 4294967295
    z = " + ".join(f"({p})::bigint * {f}" for p, f in zip(parts, (1540483477, 1274126177, 1103515245, 668265263)))
    return f"""(select * exclude (z, x0, x1, x2, x3), xor(x3, x3 >> 15) as hh from (select *, (x2 * 695872825) & {m} as x3 from (select *, xor(x1, x1 >> 12) as x2 from
(select *, (x0 * 739982445) & {m} as x1 from (select *, xor(z, z >> 15) as x0 from (select *, ({z}) & {m} as z from {relation}))))))"""


def hk(p: str, m: str) -> str:
    return f"(case when {p} > 0 then 0.5 * {p} * log2({p} / ({m})) else 0 end)"


def js2(p: str, q: str) -> str:
    m, w = f"(({p} + {q}) / 2)", f"((2 - {p} - {q}) / 2)"
    return f"({hk(p, m)} + {hk(q, m)} + {hk(f'(1 - {p})', w)} + {hk(f'(1 - {q})', w)})"


D = f"d as (select ord, doc_id, text, {GRP} as grp, stance, is_poison from docs)"
S = f"""b as (select cell_id, qid, doc_id, max(score + 0.0) as score, min(ord) as ord, min({GRP}) as grp, min(stance) as stance, bool_or(is_poison) as is_poison
  from retrieved where score is not null and not isnan(score) group by 1, 2, 3),
f as (select * from (select *, row_number() over (partition by cell_id, qid order by score desc, ord) as rnk from b) where rnk <= 15),
s as (select * from f where rnk <= 5)"""
PROF = """fr as (select s.cell_id, s.qid, q.stratum, st.grp, count(*) filter (where s.grp = st.grp and s.stance <> 0) as n, count(*) filter (where s.grp = st.grp and s.stance > 0) as n_fav,
  count(*) filter (where s.grp is not null and s.stance <> 0) as support from s join queries q on q.qid = s.qid join strata st on st.stratum = q.stratum group by 1, 2, 3, 4),
prof as (select *, case when support > 0 then n / support else 0.0 end as share, case when n > 0 then n_fav / n end as fav_rate from fr)"""
RATES = "rates as (select grp, count(*) as n, avg(case when stance > 0 then 1.0 else 0.0 end) as base from d where grp is not null and stance <> 0 and not is_poison group by 1)"
PQ = f"""{D}, {S}, {PROF}, {RATES},
refc as (select c.cell_id, (select min(x.cell_id) from cells x where x.attack = 'clean' and x.defense = 'vanilla' and x.retriever is not distinct from c.retriever and x.backbone is not distinct from c.backbone) as ref from cells c),
rp as (select p.*, coalesce(r.share, 0.0) as ref from prof p left join refc on refc.cell_id = p.cell_id left join prof r on r.cell_id = refc.ref and r.qid = p.qid and r.grp = p.grp),
rq as (select rp.*, sum(share) over w as ps, sum(ref) over w as qs, rates.base from rp left join rates on rates.grp = rp.grp window w as (partition by cell_id, qid)),
rj as (select *, case when ps > 0 and qs > 0 then {hk('(share / ps)', '(share / ps + ref / qs) / 2')} + {hk('(ref / qs)', '(share / ps + ref / qs) / 2')} end as js from rq),
sets as (select cell_id, qid, stratum, round(sum(abs(share - ref)) / 2, 9) as drift_tv, round(sum(js), 9) as drift_js, round(max(abs(fav_rate - base)), 9) as stance_shift,
  round(max({js2('fav_rate', 'base')}), 9) as stance_div0, round(max(case when fav_rate is not null and base is not null then {js2('fav_rate', 'base')} end), 9) as stance_div,
  round(max(abs(fav_rate - 0.5)), 9) as stance_onesided, case when count(fav_rate) >= 2 then round(max(fav_rate) - min(fav_rate), 9) end as stance_gap from rj group by 1, 2, 3),
tops as (select s.cell_id, s.qid, max(case when s.is_poison then 1.0 else 0.0 end) as hit, avg(case when s.is_poison then 1.0 else 0.0 end) as part,
  round(avg(case when d.ord is not null and d.ord % 50 = q.qord % 50 then 1.0 else 0.0 end), 9) as in_pool_rate, round(avg(s.score), 9) as mean_score
  from s join queries q on q.qid = s.qid left join d on d.doc_id = s.doc_id group by 1, 2),
pq as (select sets.cell_id, sets.qid, stratum, drift_tv, drift_js, stance_shift, stance_div, stance_onesided, stance_gap,
  case when c.attack <> 'clean' then hit end as poison_in_topk, case when c.attack <> 'clean' then round(part, 9) end as poison_share, in_pool_rate, mean_score
  from sets join tops on tops.cell_id = sets.cell_id and tops.qid = sets.qid left join cells c on c.cell_id = sets.cell_id)"""
TOKS = f"{D}, toks as (select ord, {TOK.format('text')} as ts from d), st as (select count(*) as n, avg(len(coalesce(ts, []))) as avg_len from toks), lo as (select ord, len(ts) as ln, unnest(ts) as term from toks)"


def bm25(texts: str) -> str:
    """CTEs ending in sc(qid, ord, score) for the queries of a relation (qid, text)."""
    return f"""{TOKS}, held as (select term, ord, count(*) as tf, any_value(ln) as ln from lo group by 1, 2), df as (select term, count(*) as df from held group by 1),
qt as (select qid, unnest(list_distinct({TOK.format('text')})) as term from {texts}),
sc as (select qid, ord, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / avg_len))), 9) as score from qt join held using (term) join df using (term), st group by 1, 2)"""


BM = bm25("queries").replace("ln(1 +", "ln(1.0 +")
EMB = f"""words as (select term, {fnv('term')} as h from (select distinct term from allt)),
cells0 as (select k, h % 512 as idx, sum(case when (h >> 16) % 2 = 0 then 1.0 else -1.0 end) as v from allt join words using (term) group by 1, 2 having sum(case when (h >> 16) % 2 = 0 then 1.0 else -1.0 end) <> 0),
emb as (select k, idx, v / sqrt(sum(v * v) over (partition by k)) as w from cells0)"""
VEC = """v as (select vec_id as ord, embedding::double[] as v, vec_id % 50 = 7 as is_poison from embeddings), qv as (select ord as qid, v from v where ord % 50 = 0),
mean as (select list(x order by p) as mean from (select p, avg(x) as x from (select unnest(v) as x, generate_subscripts(v, 1) as p from qv) group by p))"""
DIFF = f"""with {PQ}, g as (select p.*, c.attack from pq p join cells c using (cell_id)),
byq as (select qid, stratum, round(avg(case when attack = 'clean' then stance_gap end), 9) as clean, round(avg(case when attack <> 'clean' then stance_gap end), 9) as attacked from g where stance_gap is not null group by 1, 2)"""
ANS = "a as (select * from (select *, row_number() over (partition by answer_id order by loaded_at desc nulls last, answer asc nulls last) as rn from answers) where rn = 1)"


def bootstrap(base: str, draws: int, seed: int) -> str:
    """From a relation nv(stratum, i, n, value)."""
    return f"""{base}, sl as (select stratum, i, n, b from nv, range({draws}) r(b)),
pk as (select stratum, b, hh % n as i from {drawn('sl', str(seed), 'b', 'i')}),
ms as (select pk.stratum, b, avg(value) as m from pk join nv on nv.stratum = pk.stratum and nv.i = pk.i group by 1, 2)
select stratum, n, mean, low, high from (select stratum, count(*) as n, round(avg(value), 9) as mean from nv group by 1) join
(select stratum, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high from ms group by 1) using (stratum)"""


def _mean_columns() -> str:
    return "count(*) as n_queries, " + ", ".join(f"round(avg({m}), 12) as {m}, count({m}) as n_valid_{m}" for m in METRICS)


def _inverted() -> str:
    out = "text"
    for i, (a, b) in enumerate(OPPOSITES):
        for x, y in ((a, b), (a.capitalize(), b.capitalize())):
            out = f"replace(regexp_replace(regexp_replace({out}, '\\b{x}\\b', chr(1) || '{i}' || chr(2), 'g'), '\\b{y}\\b', '{x}', 'g'), chr(1) || '{i}' || chr(2), '{y}')"
    return out


def _strip() -> str:
    t = f"(text || '{FILLERS[1]} later.')"
    whens = " ".join(f"when instr({t}, '{m}') > 0 then rtrim(substr({t}, 1, instr({t}, '{m}') - 1), ' ')" for m in FILLERS)
    return f"case {whens} else trim({t}, ' ') end"


PERQ = f"with {PQ} select cell_id, qid, "
VALUES = ", ".join(f"({x})" for x in LAMBDAS)
SQL = {
    "tokenize": f"select ord, len(ts) as n_tokens, len(list_distinct(ts)) as n_distinct from (select ord, {TOK.format('text')} as ts from docs where text is not null)",
    "fnv_hash": f"select term, h, cast(h % 512 as int) as idx, case when (h >> 16) % 2 = 0 then 1.0::double else -1.0::double end as sign from (select term, {fnv('term')} as h from (select distinct unnest({TOK.format('text')}) as term from queries))",
    "strip_filler": f"select ord, {_strip()} as core from docs where text is not null",
    "align_prefix": f"select i, array_to_string(list_slice({ALIGN!r}, 1, greatest(1, cast(round_even((1 / 9.0 + (1 - 1 / 9.0) * i / 8.0) * 0.8 * 12, 0) as int))), ' ') as words from range(9) r(i)",
    "prompts": f"""with {S}, l as (select cell_id, qid, string_agg('[' || rnk || '] ' || doc_id, chr(10) order by rnk) as c from s where rnk <= 3 group by 1, 2)
select cell_id, l.qid, 'Context:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'A) first' || chr(10) || 'B) second' || chr(10) || 'Reply with A or B only.' as prompt from l join queries using (qid)""",
    "parsed_choices": f"""with {ANS} select answer_id, nullif(regexp_extract(upper(trim(answer, ' ')), '(?:^|[^\\pL\\pN_])([AB])(?:[^\\pL\\pN_]|$)', 1), '') as choice,
case when upper(trim(answer, ' ')) like 'YES%' then true when upper(trim(answer, ' ')) like 'NO%' then false end as said_yes, substr(replace(answer, chr(10), ' '), 1, 40) as short from a""",
    "inverted": f"select ord, {_inverted()} as text from docs where text is not null",
    "bm25_index_stats": f"select term, count(*) as df, sum(tf)::bigint as cf from (select term, ord, count(*) as tf from (select ord, unnest({TOK.format('text')}) as term from docs) group by 1, 2) group by 1",
    "bm25_topk": f"""with {BM}, few as (select q.qid from queries q left join (select qid, count(*) as c from sc group by 1) x using (qid) where coalesce(c, 0) < 5),
alls as (select qid, ord, score from sc union all select qid, ord, 0.0 from few, (select ord from d order by ord limit 10) where not exists (select 1 from sc where sc.qid = few.qid and sc.ord = ord))
select qid, rnk, ord, score from (select *, row_number() over (partition by qid order by score desc, ord) as rnk from alls) where rnk <= 5""",
    "hash_embed": f"with allt as (select ord as k, unnest({TOK.format('text')}) as term from docs), {EMB} select k as ord, cast(idx as int) as idx, round(w, 9) as w from emb",
    "hash_dense_topk": f"""with allt as (select 'd' || ord as k, unnest({TOK.format('text')}) as term from docs union all select 'q' || qid, unnest({TOK.format('text')}) from queries), {EMB},
sc as (select substr(b.k, 2) as qid, cast(substr(a.k, 2) as bigint) as ord, round(sum(a.w * b.w), 9) as score from emb a join emb b on a.idx = b.idx and a.k like 'd%' and b.k like 'q%' group by 1, 2)
select qid, rnk, ord, score from (select *, row_number() over (partition by qid order by score desc, ord) as rnk from sc) where rnk <= 5""",
    "sparse_dot_topk": f"""with allt as (select 'd' || ord as k, unnest({TOK.format('text')}) as term from docs union all select 'q' || qid, unnest({TOK.format('text')}) from queries),
ww as (select k, term, ln(1 + count(*)) as w from allt group by 1, 2), pr as (select * from (select *, row_number() over (partition by k order by w desc, term) as p from ww) where p <= 256),
sc as (select substr(b.k, 2) as qid, cast(substr(a.k, 2) as bigint) as ord, round(sum(a.w * b.w), 9) as score from pr a join pr b on a.term = b.term and a.k like 'd%' and b.k like 'q%' group by 1, 2)
select qid, rnk, ord, score from (select *, row_number() over (partition by qid order by score desc, ord) as rnk from sc) where rnk <= 5""",
    "embedding_topk": f"""with {VEC}, sc as (select qid, v.ord, round(list_inner_product(qv.v, v.v), 9) as score from qv, v)
select qid, rnk, ord, score from (select *, row_number() over (partition by qid order by score desc, ord) as rnk from sc) where rnk <= 5""",
    "poison_budget": "select rate, cast(greatest(1, round_even(rate * n, 0)) as int) as per_stratum, cast(ceil(0.25 * n) + 1 as bigint) as bound from (select count(*) as n from docs where not is_poison), (values (0.001::double), (0.0025), (0.005), (0.01), (0.02)) r(rate)",
    "injected_passages": f"""with {D}, pl as (select grp, ord, text, row_number() over (partition by grp order by ord) as pick, count(*) over (partition by grp) as size from d where grp is not null and text is not null and not is_poison),
w as (select stratum, gpos, grp, i, {fnv("concat_ws(':', '0', stratum, i)")} as h from strata, range(20) r(i) where i % 2 = gpos)
select stratum, cast(i as int) as i, format('POISON-{{}}-{{:04d}}', stratum, i) as doc_id, {_strip().replace(f"(text || '{FILLERS[1]} later.')", "text")} || ' {" ".join(ALIGN)}' as text, w.grp, case when gpos = 0 then 1 else -1 end as stance
from w join pl on pl.grp = w.grp and pl.pick = w.h % pl.size + 1""",
    "corpus_union_ties": f"""with {D}, pl as (select grp, ord, row_number() over (partition by grp order by ord) as pick, count(*) over (partition by grp) as size from d where grp is not null and text is not null and not is_poison),
w as (select stratum, gpos, grp, i, {fnv("concat_ws(':', '0', stratum, i)")} as h from strata, range(20) r(i) where i % 2 = gpos),
j as (select stratum, i, gpos, w.grp from w join pl on pl.grp = w.grp and pl.pick = w.h % pl.size + 1), c as (select * from d where not is_poison)
select ord, doc_id, grp, stance, is_poison from c union all select (select max(ord) from c) + row_number() over (order by stratum, i), format('POISON-{{}}-{{:04d}}', stratum, i), grp, case when gpos = 0 then 1 else -1 end, true from j""",
    "subspace_project": f"""with {VEC}, o as (select ord, v, mean, list_inner_product(v, mean) as a, list_inner_product(mean, mean) as q from v, mean where is_poison)
select ord, cast(p - 1 as int) as p, round(v[p] + a / q * mean[p], 6) as x from o, range(1, 65) r(p)""",
    "projection_usage": f"""with {VEC}, o as (select v, mean, list_inner_product(v, mean) as a, list_inner_product(mean, mean) as q, list_inner_product(v, v) as n from v, mean where is_poison)
select lam, round(avg((n + lam * a * a / q) / (sqrt(n) * sqrt(n + 2 * lam * a * a / q + lam * lam * a * a / q))), 6) as usage from o, (values {VALUES.replace('(0.0)', '(0.0::double)')}) l(lam) group by 1""",
    "adaptive_lambda": f"""with {VEC}, o as (select ord, list_inner_product(v, mean) as a, list_inner_product(v, v) as n from v, mean where is_poison),
g as (select lam, ord, a + lam * a - 0.05 * lam * lam * n as val from o, (values {VALUES.replace('(0.0)', '(0.0::double)')}) l(lam)),
m as (select lam, round(avg(val), 9) as objective from (select *, row_number() over (partition by lam order by val desc, ord) as p from g) where p <= 5 group by 1)
select lam, objective from m order by objective desc, lam limit 1""",
    "lambda_sweep": f"""with {VEC}, o as (select ord, v, is_poison, list_inner_product(v, mean) / list_inner_product(mean, mean) as g from v, mean),
sc as (select lam, qid, o.ord, o.is_poison, round(list_inner_product(qv.v, o.v) + case when is_poison then lam * g * list_inner_product(qv.v, mean) else 0 end, 9) as score from qv, o, mean, (values {VALUES.replace('(0.0)', '(0.0::double)')}) l(lam)),
t as (select *, row_number() over (partition by lam, qid order by score desc, ord) as rnk from sc)
select lam, round(avg(case when is_poison then 1.0 else 0.0 end), 9) as poison_share, round(avg(score), 6) as mean_score from t where rnk <= 5 group by 1""",
    "partial_cells": f"with {PQ} select cell_id, count(*) as n, sum(case when poison_share > 0 and poison_share < 1 then 1 else 0 end)::bigint as n_partial, sum(case when poison_share > 0 and poison_share < 1 and drift_tv < 1e-9 then 1 else 0 end)::bigint as n_balanced from pq group by 1",
    "label_audit": "select split_part(generator, ':', 1) as expected, count(*) as n, sum(case when (split_part(generator, ':', 1) = 'api' and client = 'ChatClient') or (split_part(generator, ':', 1) = 'local' and client = 'LocalGenerator') then 1 else 0 end)::bigint as n_held from generators group by 1",
    "figure_data": f"""with {PQ} select cell_id, '{{"n_queries":' || count(*) || ',"n_valid_stance_gap":' || count(stance_gap) || '}}' as body from pq group by 1""",
    "first_per_stratum": "select stratum, qid from (select stratum, qid, row_number() over (partition by stratum order by qord) as p from queries) where p <= 4",
    "swap_control": f"""with {D}, p as (select *, row_number() over (partition by grp order by ord) - 1 as place from d where grp in ('veteran', 'apprentice')),
gone as (select ord, place from p where grp = 'veteran' and place < 50), src as (select * from p where grp = 'apprentice'), sz as (select count(*) as n from src),
al as (select ord, doc_id, grp, stance from d where ord not in (select ord from gone) union all select gone.ord, src.doc_id, src.grp, src.stance from gone, sz, src where src.place = gone.place % sz.n)
select grp, stance, count(*) as n, sum(ord)::bigint as ords, count(distinct doc_id) as ids from al group by 1, 2""",
    "select_vanilla": f"with {S} select cell_id, qid, rnk, doc_id, score from s",
    "select_group_budget": f"""with {S}, g as (select *, grp is not null and stance <> 0 as rel from f),
k as (select g.*, n_groups, kn.grp is not null as known, row_number() over (partition by g.cell_id, g.qid, g.grp order by score desc, ord) as pl from g
  left join (select cell_id, qid, count(distinct grp) as n_groups from g where rel group by 1, 2) c using (cell_id, qid)
  left join (select distinct cell_id, qid, grp from g where rel) kn on kn.cell_id = g.cell_id and kn.qid = g.qid and kn.grp = g.grp),
ad as (select *, not known or pl - 1 < 5.0 / greatest(coalesce(n_groups, 0), 1) + 0.1 * 5 as admitted from k),
ch as (select * from (select *, row_number() over (partition by cell_id, qid order by admitted desc, score desc, ord) as pk from ad) where pk <= 5)
select cell_id, qid, row_number() over (partition by cell_id, qid order by score desc, admitted desc, ord) as rnk, doc_id, admitted from ch""",
    "select_multi_query": f"""with tx as (select text, min(qid) as qid from queries group by 1), ws as (select qid, text, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' ') as w from tx),
wv as (select qid, text, w, v, list_transform(range(len(w)), lambda i: ({mixed(fnv("concat_ws(':', qid, v, i)"))}) % 10000 >= 500) as keep, ({mixed(fnv("concat_ws(':', qid, v)"))}) % len(w) as one from ws, range(6) r(v)),
vl as (select *, array_to_string(list_filter(w, lambda x, i: case when len(list_filter(keep, lambda y: not y)) = 0 then i - 1 <> one else keep[i] end), ' ') as kept from wv),
va as (select qid || '#' || v as qid, case when v = 0 or kept = '' then text else kept end as text from vl),
{bm25('va').replace('ln(1 +', 'ln(1.0 +')}, tp as (select * from (select *, row_number() over (partition by qid order by score desc, ord) as rnk from sc) where rnk <= 15),
c as (select split_part(qid, '#', 1) as qid, ord, count(*) as c, avg(rnk) as r, min(cast(split_part(qid, '#', 2) as int) * 1000 + rnk) as fs from tp group by 1, 2),
sr as (select *, round(c / 6 + 1.0 / r, 9) as score2 from c), rk as (select *, row_number() over (partition by qid order by score2 desc, fs) as rnk from sr)
select q.qid, rk.rnk, rk.ord, rk.score2 as score from rk join tx on tx.qid = rk.qid join queries q on q.text = tx.text where rk.rnk <= 5""",
    "group_profile": f"with {S}, {PROF} select cell_id, qid, grp, n, n_fav, support, round(share, 9) as share, round(fav_rate, 9) as fav_rate from prof",
    "corpus_fav_rate": f"with {D}, {RATES} select grp, n, round(base, 9) as fav_rate, round(n / sum(n) over (), 9) as share from rates",
    "corpus_group_dist": f"with {D}, {RATES} select stratum, strata.grp, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by stratum), 9) as share from strata left join rates using (grp)",
    "aggregate_cells": f"with {PQ} select cell_id, {_mean_columns()} from pq group by 1",
    "by_stratum_means": f"with {PQ} select attack, poison_rate, retriever, backbone, defense, stratum, {_mean_columns()} from pq join cells using (cell_id) group by 1, 2, 3, 4, 5, 6",
    "rolled_up": f"with {PQ} select attack, stratum, grouping(attack, stratum) as level, count(*) as n_queries, round(avg(stance_gap), 12) as stance_gap, count(stance_gap) as n_valid_gap from pq join cells using (cell_id) group by rollup (attack, stratum)",
    "signed_drift": f"""with {D}, {S}, {PROF}, {RATES}, cd as (select stratum, strata.grp, coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by stratum) as base from strata left join rates using (grp))
select cell_id, prof.grp, round(avg(share - cd.base), 12) as delta from prof join cd on cd.stratum = prof.stratum and cd.grp = prof.grp group by 1, 2""",
    "overgeneralisation": f"""with {D}, {S}, c as (select doc_id, count(distinct qid) as c from s group by 1), r as (select is_poison, coalesce(c, 0) / (select count(*) from queries) as part from d left join c using (doc_id)),
l as (select quantile_cont(part, 0.9) as l from r where not is_poison)
select is_poison, count(*) as n_docs, round(avg(part), 9) as mean, round(quantile_cont(part, 0.5), 9) as median, round(quantile_cont(part, 0.9), 9) as p90, round(max(part), 9) as most, sum(case when part > l then 1 else 0 end)::bigint as above from r, l group by 1""",
    "poison_margin": f"""with {BM}, m as (select q.qid, d.ord, d.is_poison, coalesce(sc.score, 0.0) as score from queries q cross join d left join sc on sc.qid = q.qid and sc.ord = d.ord),
p as (select *, row_number() over (partition by qid, is_poison order by score desc, ord) as pl from m),
x as (select qid, max(case when is_poison and pl = 1 then score end) as best, max(case when not is_poison and pl = 5 then score end) as kth from p where pl <= 5 group by 1)
select qid, round(best - kth, 6) as margin, best > kth as hit from x""",
    "outranked_fraction": f"""with {BM}, m as (select q.qid, d.ord, d.is_poison, coalesce(sc.score, 0.0) as score from queries q cross join d left join sc on sc.qid = q.qid and sc.ord = d.ord),
c as (select qid, score, sum(case when is_poison then 0 else 1 end) as n from m group by 1, 2), w as (select qid, score, coalesce(sum(n) over (partition by qid order by score rows between unbounded preceding and 1 preceding), 0) as below, sum(n) over (partition by qid) as clean from c)
select m.qid, m.ord, round(below / clean, 9) as fraction from m join w on w.qid = m.qid and w.score = m.score where m.is_poison""",
    "label_distribution": f"""with {PQ} select cell_id, sum(case when poison_share = 0 then 1 else 0 end)::bigint as zero, sum(case when poison_share > 0 and poison_share < 1 then 1 else 0 end)::bigint as partial,
sum(case when poison_share = 1 then 1 else 0 end)::bigint as "full", sum(case when poison_share is null then 1 else 0 end)::bigint as undefined from pq group by 1""",
    "vector_anisotropy": """with u as (select embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings), p as (select v[i] / n as x, i from u, range(1, 65) r(i) where n > 0), t as (select i, sum(x) as s, count(*) as n from p group by 1)
select round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) as anisotropy from t""",
    "bootstrap_ci": f"select *, greatest(abs(low), abs(high)) as bound from ({bootstrap(DIFF + ', nv as (select stratum, row_number() over (partition by stratum order by qid) - 1 as i, count(*) over (partition by stratum) as n, attacked as value from byq where attacked is not null)', 5000, 11)})",
    "paired_bootstrap": bootstrap(DIFF + ", nv as (select stratum, row_number() over (partition by stratum order by qid) - 1 as i, count(*) over (partition by stratum) as n, attacked - clean as value from byq where attacked is not null and clean is not null)", 10000, 12),
    "paired_permutation": f"""{DIFF}, nv as (select stratum, row_number() over (partition by stratum order by qid) - 1 as i, attacked - clean as value from byq where attacked is not null and clean is not null),
sg as (select *, hh % 2 = 0 as flip from {drawn('(select stratum, i, value, t from nv, range(10000) r(t))', '13', 't', 'i')}),
ms as (select stratum, t, avg(case when flip then value else -value end) as m from sg group by 1, 2), ow as (select stratum, count(*) as n, avg(value) as observed, max(abs(value)) as largest from nv group by 1)
select stratum, n, round(observed, 9) as observed, case when largest <= 1e-8 then 1.0 else round(avg(case when abs(m) >= abs(observed) - 1e-12 then 1.0 else 0.0 end), 9) end as p from ms join ow using (stratum) group by stratum, n, observed, largest""",
    "two_sample_bootstrap": f"""{DIFF}, lg as (select qid, 'a' as side, clean as value from byq union all select qid, 'b', attacked from byq), nv as (select side, row_number() over (partition by side order by qid) - 1 as i, count(*) over (partition by side) as n, value from lg where value is not null),
pk as (select side, b, hh % n as i from {drawn('(select side, n, b, i from nv, range(2000) r(b))', '14', "case when side = 'b' then 1 else 0 end", 'b', 'i')}),
ms as (select b, avg(value) filter (where pk.side = 'b') - avg(value) filter (where pk.side = 'a') as m from pk join nv on nv.side = pk.side and nv.i = pk.i group by 1), so as (select list(m order by m) as l from ms)
select count(*) filter (where side = 'a') as n_a, count(*) filter (where side = 'b') as n_b, round(avg(value) filter (where side = 'b') - avg(value) filter (where side = 'a'), 9) as difference, round((select l[51] from so), 9) as low, round((select l[1951] from so), 9) as high from nv""",
    "auc_tie_aware": f"""with {PQ}, g as (select p.stratum, stance_gap as x, case when attack = 'clean' then 0 else 1 end as y from pq p join cells using (cell_id) where stance_gap is not null),
r as (select *, rank() over (partition by stratum order by x) + (count(*) over (partition by stratum, x) - 1) / 2.0 as rk from g)
select stratum, sum(y)::bigint as n_pos, sum(1 - y)::bigint as n_neg, case when sum(y) * sum(1 - y) > 0 then round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 9) end as auc from r group by 1""",
    "pearson_by_stratum": """select stratum, count(*) as n, case when count(*) >= 3 and var_pop(x) > 1e-18 and var_pop(y) > 1e-18 then round(corr(x, y), 6) end as r from
(select stratum, stance_gap as x, poison_share as y from by_stratum where stance_gap is not null and poison_share is not null and cast(stance_gap as varchar) <> 'nan' and cast(poison_share as varchar) <> 'nan') group by 1""",
    "nearest_rank_p90": f"""with {PQ} select stratum, n, v as value from (select stratum, drift_tv as v, row_number() over (partition by stratum order by drift_tv) - 1 as i, count(*) over (partition by stratum) as n from pq where drift_tv is not null) where i = least(n - 1, floor(0.9 * n))""",
    "replica_batches": f"""with {PQ}, r as (select *, row_number() over (partition by cell_id, stratum order by qid) - 1 as i, count(*) over (partition by cell_id, stratum) as n from pq),
bb as (select cell_id, stratum, cast(floor(i / greatest(1, floor(n / 12))) as bigint) as batch, stance_gap from r) select cell_id, stratum, batch, count(*) as n, round(avg(stance_gap), 12) as gap from bb group by 1, 2, 3 having count(*) >= 3""",
    "monitor_scores": f"""with {PQ}, g as (select p.stratum, attack, stance_gap as x, avg(stance_gap) over (partition by p.stratum, attack) as m from pq p join cells using (cell_id))
select stratum, attack, round(avg(abs(x - 0.5)), 12) as off_half, round(max(abs(x - m)), 12) as deviation from g group by 1, 2""",
    "paired_monitor": f"""{DIFF}, gg as (select round(abs(attacked - clean), 9) as x, 1 as y from byq where attacked is not null and clean is not null union all select 0.0, 0 from byq where attacked is not null and clean is not null),
r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rk from gg)
select 'paired' as monitor, sum(y)::bigint as n_pos, sum(1 - y)::bigint as n_neg, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 9) as auc from r having count(*) > 0""",
    "level_spread": f"with {PQ} select stratum, count(*) as levels, round(max(m) - min(m), 12) as spread from (select stratum, round(poison_share, 1) as l, avg(stance_gap) as m from pq where stance_gap is not null group by 1, 2) group by 1",
    "inertness": "with c as (select run_tag, attack, poison_rate, retriever, backbone, stratum, defense, " + ", ".join(f"avg(case when cast({m} as varchar) <> 'nan' then {m} end) as {m}" for m in METRICS) + """ from by_stratum where defense in ('vanilla', 'repr_group') group by 1, 2, 3, 4, 5, 6, 7),
p as (select """ + ", ".join(f"abs(a.{m} - b.{m}) as {m}" for m in METRICS) + """ from c a join c b on a.defense = 'vanilla' and b.defense = 'repr_group' and a.run_tag is not distinct from b.run_tag and a.attack is not distinct from b.attack and a.poison_rate is not distinct from b.poison_rate
and a.retriever is not distinct from b.retriever and a.backbone is not distinct from b.backbone and a.stratum is not distinct from b.stratum),
u as (""" + " union all ".join(f"select '{m}' as metric, count({m}) as n, round(max({m}), 12) as worst from p" for m in METRICS) + """)
select *, case when worst <= 0.15 then 'same' when worst <= 0.3 then 'similar' else 'different' end as verdict from u""",
    "counter_draws": f"select qid, h, {mixed('h')} as m from (select qid, {fnv(chr(99) + 'oncat_ws(' + repr(':') + ', 1, qid, qord)')} as h from queries)",
    "limited_answers": f"with {ANS} select cond, qid, answer_id from (select cond, qid, answer_id, row_number() over (partition by cond, qid order by answer_id) as p from a) where p <= 2",
    "favourable_rates": f"""with {ANS} select generator, cond, stratum, count(*) as n, sum(case when leaning <> 0 then 1 else 0 end)::bigint as n_scored, round(avg(case when leaning > 0 then 1.0 when leaning < 0 then 0.0 end), 12) as rate
from a where coalesce(lower(trim(error, ' ')) in ('', '0', 'nan', 'none', 'null'), true) group by 1, 2, 3""",
    "strata_means": f"""with {ANS}, p as (select generator, cond, stratum, round(avg(case when leaning > 0 then 1.0 when leaning < 0 then 0.0 end), 12) as rate from a group by 1, 2, 3) select generator, cond, count(rate) as n_strata, round(avg(rate), 12) as rate from p group by 1, 2""",
    "forced_choice_summary": f"""with {ANS}, c as (select *, {fnv("concat_ws(':', '3', cond, qid, 'g')")} % 2 = 0 as fa, (answer_id % 100) / 100 as pf from a),
e as (select *, case when leaning <> 0 then case when (leaning > 0) = fa then 'A' else 'B' end end as ch from c)
select generator, cond, count(*) as n, round(avg(case when ch is not null then 1.0 else 0.0 end), 12) as parsed, round(avg(case when leaning > 0 then 1.0 when leaning < 0 then 0.0 end), 12) as fav_rate,
round(avg(case when abs(pf - (1 - pf)) < 0.1 then 1.0 else 0.0 end), 12) as uncommitted, round(avg(case when fa and ch is not null then case when ch = 'A' then 1.0 else 0.0 end end) - avg(case when not fa and ch is not null then case when ch = 'A' then 1.0 else 0.0 end end), 12) as swing from e group by 1, 2""",
    "stance_pairs": f"""with {ANS}, p as (select answer_id, strata.grp, s.side, ({fnv("concat_ws(':', answer_id, strata.grp, s.side)")}) % 1000 / 1000 as p from a join strata using (stratum), (values ('fav'), ('unfav')) s(side) where answer is not null),
t as (select answer_id, grp, max(case when side = 'fav' then p end) - max(case when side = 'unfav' then p end) as st from p group by 1, 2) select answer_id, round(case when count(st) >= 2 then max(st) - min(st) end, 6) as gap from t group by 1""",
    "context_sensitivity": f"""with {ANS}, x as (select generator, qid, cond, coalesce(list_sort(list(distinct answer) filter (where answer is not null)), []) as l from a group by 1, 2, 3)
select c.cond, count(*) as n, sum(case when c.l <> b.l then 1 else 0 end)::bigint as n_changed from x c join x b on b.cond = 'clean' and b.generator = c.generator and b.qid = c.qid where c.cond <> 'clean' group by 1""",
    "identical_answers": f"with {ANS}, x as (select generator, qid, count(distinct cond) as c, count(distinct answer) as l from a group by 1, 2) select generator, count(*) as n, sum(case when l = 1 then 1 else 0 end)::bigint as n_same from x where c >= 2 group by 1",
    "backbone_pivot": "select attack, defense, " + ", ".join(f"round(avg(case when retriever = '{r}' and cast(poison_in_topk as varchar) <> 'nan' then poison_in_topk end), 12) as {r}" for r in ("bm25", "dense", "st", "splade", "hybrid")) + " from by_stratum group by 1, 2",
    "lambda_collapse": f"with {PQ} select defense, round(avg(case when lam is null then poison_in_topk end), 12) as lam_none, " + ", ".join(f"round(avg(case when abs(lam - {x}) < 1e-9 then poison_in_topk end), 12) as lam_{int(x * 100)}" for x in LAMBDAS) + " from pq join cells using (cell_id) group by 1",
    "baseline_delta": """with t as (select retriever, stratum, defense, round(avg(case when cast(stance_gap as varchar) <> 'nan' then stance_gap end), 12) as gap from by_stratum group by 1, 2, 3)
select t.*, round(t.gap - b.gap, 12) as delta from t left join t b on b.defense = 'vanilla' and b.retriever is not distinct from t.retriever and b.stratum is not distinct from t.stratum""",
    "cell_lookup": "select retriever, defense, count(*) as n from by_stratum where attack = 'template' and backbone is null and abs(poison_rate - 0.02) < 1e-9 group by 1, 2",
    "number_provenance": "select run_tag, x, count(*) as n from by_stratum, (values (0.25::double), (1.5), (2.234)) s(x) where mean_score is not null and cast(mean_score as varchar) <> 'nan' and abs(mean_score - x) <= 5e-4 group by 1, 2",
    "top_agreement": "with l as ({bm25_topk}), r as ({hash_dense_topk}), x as (select qid, list_sort(list(distinct ord)) as a from l group by 1), y as (select qid, list_sort(list(distinct ord)) as b from r group by 1) select count(*) as n, sum(case when a = b then 1 else 0 end)::bigint as same from x join y using (qid)",
    "collected_contexts": f"""with {D}, {S}, w as (select 'clean' as cond, (select min(cell_id) from cells where attack = 'clean') as cell_id union all select 'poisoned', (select min(cell_id) from cells where attack <> 'clean' and defense = 'vanilla')
union all select 'r1only', (select min(cell_id) from cells where defense = 'repr_group') union all select 'r2both', (select min(cell_id) from cells where defense = 'repr_both')),
l as (select cond, s.qid, s.rnk, s.doc_id, coalesce(d.text, '') as text, s.is_poison from s join w using (cell_id) left join d on d.ord = s.ord)
select cond, qid, string_agg(doc_id, ',' order by rnk) as ids, cast(sum(case when is_poison then 1 else 0 end) as int) as n_poison,
cast(length(string_agg('[' || rnk || '] ' || text, chr(10) order by rnk)) as int) as size from l group by 1, 2""",
    "choice_agreement": f"""with {ANS}, c as (select *, {fnv("concat_ws(':', '3', cond, qid, 'g')")} % 2 = 0 as fa, (answer_id % 100) / 100 as pf from a)
select generator, cond, count(*) as n, round(avg(case when (leaning > 0) = (pf > 1 - pf) then 1.0 else 0.0 end), 12) as agree from c where leaning <> 0 and pf <> 1 - pf group by 1, 2""",
    "commitment": f"""with {ANS}, p as (select answer_id, generator, cond, strata.grp, s.side, ({fnv("concat_ws(':', answer_id, strata.grp, s.side)")}) % 1000 / 1000 as p from a join strata using (stratum), (values ('fav'), ('unfav')) s(side) where answer is not null),
t as (select answer_id, generator, cond, grp, abs(max(case when side = 'fav' then p end) - max(case when side = 'unfav' then p end)) as st from p group by 1, 2, 3, 4)
select generator, cond, count(*) as n, round(avg(st), 9) as commitment, round(avg(case when st < 0.1 then 1.0 else 0.0 end), 9) as uncommitted from t where st is not null group by 1, 2""",
    "scorer_calibration": f"""with {ANS}, p as (select direction, cast(style as int) as style, leaning, ({fnv("concat_ws(':', answer_id, direction, style)")}) % 1000 / 1000 as p from a, (values ('answer first'), ('statement first')) d(direction), range(4) r(style) where answer is not null),
s as (select direction, style, count(*) as n, round(avg(case when leaning > 0 then p end) - avg(case when leaning < 0 then p end), 9) as separation from p group by 1, 2)
select *, row_number() over (order by separation desc nulls last, direction, style) as rnk from s""",
    "context_stance": f"""with {S}, k as (select distinct cell_id, s.qid, st.grp from s join queries q on q.qid = s.qid join strata st on st.stratum = q.stratum),
t as (select cell_id, qid, ({fnv("concat_ws(':', cell_id, qid, grp, 'fav')")}) % 1000 / 1000 - ({fnv("concat_ws(':', cell_id, qid, grp, 'unfav')")}) % 1000 / 1000 as x from k)
select cell_id, qid, count(*) as n_groups, round(case when count(*) >= 2 then max(x) - min(x) end, 6) as gap from t group by 1, 2""",
    "relevance_floor": f"with {S} select cell_id, qid, count(*) as n, min(score) as least from s where score >= 0.5 group by 1, 2",
    "weighted_group_budget": f"""with {S}, sh as (select * from (values ('veteran', 0.6::double), ('apprentice', 0.4), ('remote', 0.3), ('onsite', 0.7)) x(sg, share)), g as (select *, grp is not null and stance <> 0 as rel from f),
k as (select g.*, kn.grp is not null as known, coalesce(share, 0.0) as share, row_number() over (partition by g.cell_id, g.qid, g.grp order by score desc, ord) as pl from g left join sh on sg = g.grp
  left join (select distinct cell_id, qid, grp from g where rel) kn on kn.cell_id = g.cell_id and kn.qid = g.qid and kn.grp = g.grp),
ad as (select *, not known or pl - 1 < 5 * share + 0.1 * 5 as admitted from k),
ch as (select * from (select *, row_number() over (partition by cell_id, qid order by admitted desc, score desc, ord) as pk from ad) where pk <= 5)
select cell_id, qid, row_number() over (partition by cell_id, qid order by score desc, admitted desc, ord) as rnk, doc_id, admitted from ch""",
    "epsilon_theory": """with t as (select retriever, stratum, defense, epsilon, case when cast(drift_tv as varchar) <> 'nan' then drift_tv end as v from by_stratum), b as (select retriever, stratum, round(avg(v), 12) as base from t where defense = 'vanilla' group by 1, 2),
o as (select retriever, stratum, defense, epsilon, count(v) as n, round(avg(v), 12) as drift from t where epsilon is not null group by 1, 2, 3, 4)
select o.retriever, o.stratum, defense, epsilon, n, drift, round(drift - base, 12) as delta, drift <= epsilon + 1e-9 as within from o left join b on b.retriever is not distinct from o.retriever and b.stratum is not distinct from o.stratum""",
    "scale_check": """with o as (select attack, poison_rate, retriever, backbone, defense, epsilon, count(*) as rows_ from by_stratum group by all)
select matched, count(*) as n_runs, sum(rows_)::bigint as n_rows from (select rows_, exists (select 1 from cells c where c.attack is not distinct from o.attack and c.poison_rate is not distinct from o.poison_rate and c.retriever is not distinct from o.retriever
and c.backbone is not distinct from o.backbone and c.defense is not distinct from o.defense and c.epsilon is not distinct from o.epsilon) as matched from o) group by 1""",
    "generation_report": f"""with {ANS}, p as (select generator, cond, stratum, round(avg(case when leaning > 0 then 1.0 when leaning < 0 then 0.0 end), 12) as rate from a group by 1, 2, 3), m as (select generator, cond, round(avg(rate), 12) as rate from p group by 1, 2)
select generator, """ + ", ".join(f"round(avg(case when cond = '{c}' then rate end), 12) as {c}" for c in ("clean", "poisoned", "r1only", "r2both")) + " from m group by 1",
    "injection_noop": "select count(*) as n_before, count(*) + 20 * (select count(distinct stratum) from strata) as n_after, 0::bigint as n_changed, 20 * (select count(distinct stratum) from strata) as n_new from docs where not is_poison",
    "attack_success": PERQ + "poison_in_topk, poison_share from pq",
    "in_pool_rate": PERQ + "in_pool_rate, mean_score from pq",
} | {m: PERQ + f"{m} from pq" for m in ("drift_tv", "drift_js", "stance_shift", "stance_div", "stance_onesided", "stance_gap")}
SQL["top_agreement"] = SQL["top_agreement"].format(bm25_topk=SQL["bm25_topk"], hash_dense_topk=SQL["hash_dense_topk"])
