"""Queries D and G, with the equivalent SQL."""

from __future__ import annotations

from quern.functions import text as tx
from quern.operators import routing, series

QUERIES = {n: getattr(routing, n) for n in ("d01_judgments", "d02_confusion", "d03_label_metrics", "d04_overall", "d05_confused_pairs", "d06_jaccard_pairs", "d07_tokens", "d14_holdout", "d15_near_copies", "d16_high_entropy", "d17_series_guard")}
QUERIES |= {n: getattr(series, n) for n in ("g02_settled_steps", "g06_fingerprint", "g09_checker_failures", "g12_verdicts", "g14_grades")}


def _vote(text: str) -> str:
    words = f"regexp_split_to_array(lower({text}), '[^a-záéíóúñüöäß]+')"
    n = {k: "len(list_filter(ws, lambda w: w in (" + ", ".join(f"'{x}'" for x in v) + ")))" if v else "0" for k, v in routing.VOTES.items()}
    top = "greatest(" + ", ".join(n.values()) + ")"
    ties = " + ".join(f"({x} = {top})::int" for x in n.values())
    return f"(select case when {top} = 0 then 'none' when {ties} > 1 then 'none' " + " ".join(f"when {x} = {top} then '{k}'" for k, x in n.items()) + f" end from (select {words} as ws))"


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = f"list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(description), '[a-z0-9]{{2,}}', 0), lambda w: w not in ({_STOP})), flatten(list_transform(regexp_extract_all(lower(description), '{tx.CJK_RUN}', 0), lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))))))"
_D = f"""
with cases as (select doc_id as case_id, coalesce(lang, 'none') as gold, {_vote("coalesce(text, '')")} as j1, {_vote("substr(coalesce(text, ''), 1, 200)")} as j2 from documents),
cells as (select gold, j1, count(*) as n from cases group by all),
descs as (select skill_name as name, arg_min(trim(regexp_extract(regexp_extract(text, '(?s)\\A---\\s*\\n(.*?)\\n---\\s*\\n', 1), '(?m)^description:(.*)$', 1)), doc_id) as description from documents where doc_kind = 'skill_doc' and skill_name is not null and text is not null group by 1),
toks as (select name, description, {_TOKENS} as tokens from descs),
pairs as (select * from (select a.name as a, b.name as b, a.description as da, b.description as db, list_sort(list_intersect(a.tokens, b.tokens)) as sh, len(a.tokens) as na, len(b.tokens) as nb from toks a join toks b on a.name < b.name) where len(sh) > 0),
scored as (select *, round(len(sh) / (na + nb - len(sh))::double, 6) as jaccard from pairs)
"""
_G = """
with per as (select user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as iteration, event_type, count(*) as n, sum(value) as v from events group by all),
it as (select user_id as series, iteration, sum(n)::bigint as steps, round(sum(v), 6) as seconds, round(sum(case when event_type <> 'error' then n else 0 end) / sum(n)::double, 6) as precision, list_sort(list_distinct(list(event_type) filter (n > 4))) as friction from per group by all),
st as (select *, lag(steps) over w is null as first,
  round(abs(precision - lag(precision) over w), 9) <= 0.03 and round(abs(steps - lag(steps) over w) / coalesce(nullif(lag(steps) over w, 0), 1)::double, 9) <= 0.1 and round(abs(seconds - lag(seconds) over w) / coalesce(nullif(lag(seconds) over w, 0), 1)::double, 9) <= 0.15 as settled0,
  round((steps - lag(steps) over w) / coalesce(nullif(lag(steps) over w, 0), 1)::double, 6) as growth0, len(coalesce(friction, [])) > 0 as has_friction from it window w as (partition by series order by iteration)),
s as (select *, case when not first then settled0 end as settled, case when not first then growth0 end as growth, row_number() over (partition by series order by iteration desc) as age from st)
"""
ORACLES = {
    "d01_judgments": _D + "select * from cases",
    "d02_confusion": _D + "select * from cells",
    "d03_label_metrics": _D + "select *, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall from (select label, coalesce(sum(n) filter (gold = label and j1 = label), 0)::bigint as tp, coalesce(sum(n) filter (gold = label and j1 <> label), 0)::bigint as fn, coalesce(sum(n) filter (gold <> label and j1 = label), 0)::bigint as fp from (values ('en'), ('de'), ('es'), ('ja')) v(label), cells group by label)",
    "d04_overall": _D + "select count(*) as cases, round(avg((gold = j1)::int), 6) as micro, round(avg((j1 = 'none')::int) filter (gold = 'none'), 6) as specificity, coalesce(round(avg((j1 = 'INVALID')::int), 6), 0.0) as invalid_rate, round(avg((j1 = j2)::int), 6) as stability from cases",
    "d05_confused_pairs": _D + "select a, b, raw, related, round(raw / nullif(related, 0)::double, 6) as normalized from (select least(gold, j1) as a, greatest(gold, j1) as b, sum(n)::bigint as raw, (select coalesce(sum(n), 0)::bigint from cells c where c.gold in (least(x.gold, x.j1), greatest(x.gold, x.j1))) as related from cells x where gold <> j1 and j1 <> 'INVALID' group by 1, 2, 4)",
    "d06_jaccard_pairs": _D + "select a, b, jaccard, array_to_string(sh, ' ') as shared from scored",
    "d07_tokens": _D + "select name, array_to_string(tokens, ' ') as tokens from toks",
    "d14_holdout": "select * from (select h as holdout, ceil(h * 0.25)::bigint as least_none, least(h, 47 - ceil((188 - h) * 0.25))::bigint as most_none, round(abs(h / 188::double - 0.2), 6) as distance from range(1, 188) t(h)) where least_none <= most_none",
    "d15_near_copies": f"""
with dd as (select description, min(doc_id) as name, count(*) as copies from (select doc_id, trim(regexp_extract(regexp_extract(text, '(?s)\\A---\\s*\\n(.*?)\\n---\\s*\\n', 1), '(?m)^description:(.*)$', 1)) as description from documents where doc_kind = 'skill_doc' and text is not null) where description <> '' group by 1),
tk as (select *, {_TOKENS} as tokens from dd),
pr as (select a.name as a, b.name as b, a.copies as copies_a, b.copies as copies_b, a.description as da, b.description as db, len(list_intersect(a.tokens, b.tokens)) as n, len(a.tokens) + len(b.tokens) as m from tk a join tk b on a.name < b.name),
al as (select *, list_distinct(string_split(da || db, '')) as alphabet from pr where n > 0 and round(n / (m - n)::double, 6) >= 0.3),
-- the distance of DuckDB counts bytes: the letters of a pair are numbered first
nu as (select *, array_to_string(list_transform(string_split(da, ''), lambda c: chr(32 + list_position(alphabet, c)::int)), '') as ca, array_to_string(list_transform(string_split(db, ''), lambda c: chr(32 + list_position(alphabet, c)::int)), '') as cb from al)
select a, b, copies_a, copies_b, distance from (select *, round(levenshtein(ca, cb) / nullif(greatest(length(da), length(db)), 0)::double, 6) as distance from nu) where distance < 0.3""",
    "d16_high_entropy": "select row_id from session_one where len(list_filter(regexp_extract_all(message.content, '[A-Za-z0-9+/=_-]{20,}', 0), lambda r: regexp_matches(r, '[0-9]') and regexp_matches(r, '[A-Z]') and regexp_matches(r, '[a-z]'))) > 0",
    "d17_series_guard": "select user_id, iteration, precision, step, coalesce(step < 0.01 and lag(step) over (partition by user_id order by iteration) < 0.01, false) as stop, coalesce(step < -0.05, false) as revert from (select *, round(precision - lag(precision) over (partition by user_id order by iteration), 6) as step from (select user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as iteration, round(avg((event_type <> 'error')::int), 6) as precision from events group by all))",
    "g02_settled_steps": _G + "select series, iteration, steps, precision, settled, growth, has_friction from s",
    "g06_fingerprint": "select skill_name, sha256(string_agg(path || chr(0) || content || chr(0), '' order by path)) as fingerprint from (select skill_name, path, arg_max(text, row(updated_at, doc_id)) as content from documents where skill_name is not null and path is not null and text is not null group by all) group by 1",
    "g09_checker_failures": """
with o as (select l_orderkey as run, l_linenumber::bigint * 10000000 + l_partkey as pos, case when l_quantity < 49 then l_linenumber end as idx, case l_returnflag when 'A' then 'fail' else 'pass' end as value, case when l_discount > 0 then 'seen' end as evidence, case when l_tax > 0.07 then 'note' end as note from lineitem),
d as (select distinct l_orderkey as run, l_linenumber as idx from lineitem where l_linenumber <= 3),
r as (select o.*, d.idx is not null as sent, row_number() over (partition by o.run, o.idx order by pos) > 1 as copy from o left join d on d.run = o.run and d.idx = o.idx),
f as (select *, case when idx is null then 'malformed_grade' when not sent then 'extra_grade' when copy then 'duplicate_grade' end as fault from r),
p as (select run, (min(row(pos, fault)) filter (fault is not null))[2] as first, count(distinct idx) filter (sent) as got, bool_or(evidence is null) as bare, bool_or(note is not null) as noted from f group by run),
w as (select run, count(*) as wanted from d group by run)
select run, case when got is null then 'no_output' when first is not null then first when got < wanted then 'missing_grade' when noted then 'isolation_violation' when bare then 'no_evidence' else 'ok' end as outcome from w left join p using (run)""",
    "g12_verdicts": _G + """, p as (select series, count(*) filter (age <= 3) as held, bool_and(not has_friction) filter (age <= 2) as calm, bool_and(coalesce(settled, false)) filter (age <= 2) as flat, list(coalesce(friction, [])) filter (age <= 3) as fr, max(growth) filter (age = 1) as growth from s where age <= 3 group by series),
c as (select *, list_sort(list_reduce(fr, lambda a, b: list_intersect(a, b))) as common from p)
select series, case when len(fr) >= 3 and len(common) > 0 then 'diverged' when coalesce(growth > 0.2, false) then 'bloat' when held >= 3 and calm and flat then 'converged' else 'continue' end as verdict, coalesce(array_to_string(common, ','), '') as common from c""",
    "g14_grades": "select series, precision, success, case when any_fail and friction then 'fix instruction' when any_fail then 'fix checklist' when friction then 'reduce friction' else 'accept' end as action from (select o_custkey as series, round(avg(case o_orderstatus when 'F' then 1.0::double when 'P' then 0.5 else 0.0 end), 6) as precision, coalesce(bool_and(o_orderstatus = 'F') filter (starts_with(o_orderpriority, '1')), true) as success, bool_or(o_orderstatus not in ('F', 'P')) as any_fail, bool_or(o_totalprice > 200000) as friction from orders group by 1)",
}
