"""Queries H and J, with the equivalent SQL."""

from __future__ import annotations

from quern.operators import records
from quern.operators import snapshots as op

QUERIES = {n: getattr(op, n) for n in ("h01_closure", "h01_edges", "h02_links", "h06_fingerprints", "h09_snapshot_diff", "h09_severity", "h13_impact", "h15_carryover", "h18_moved", "h23_states", "h24_coverage", "h26_partial_update", "h30_calibration", "h31_gate", "j07_unresolved", "j08_cycles", "j13_surface", "j15_impacted")} | records.QUERIES


def _snap(name: str, where: str) -> str:
    return rf"""{name}_d as (select path, d.skill, d.content from (select path, arg_max(struct_pack(skill := skill_name, content := text), row(updated_at, doc_id)) as d from documents where path is not null and text is not null {where} group by path)),
{name} as (select skill, path, sha256(content) as sha, sha256(array_to_string(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^ {{0,3}}(?:[-*+]|\d{{1,9}}[.)])(?:\s|$)|^\s*[#>|]|[`\[|*_~]|^ {{4}}|^\t')), chr(10))) as structure from {name}_d where skill is not null)"""


_S = (
    "with recursive "
    + _snap("b", f"and updated_at <= timestamp '{op.CUTOFF}'")
    + ", "
    + _snap("a", "")
    + """,
diff as (select coalesce(b.skill, a.skill) as skill, coalesce(b.path, a.path) as path, b.sha as sb, a.sha as sa,
  case when b.sha is null then 'added' when a.sha is null then 'removed' when b.sha = a.sha then 'same' when b.structure = a.structure then 'prose' else 'change' end as kind
  from b full join a on a.skill = b.skill and a.path = b.path),
fa as (select skill, sha256(string_agg(path || chr(10) || sha || chr(10), '' order by path)) as fingerprint from a group by 1),
fb as (select skill, sha256(string_agg(path || chr(10) || sha || chr(10), '' order by path)) as fingerprint from b group by 1),
carry as (select a.skill, a.path as scenario, case when b2.sha is null then 'unbacked: ' || a.path when b2.sha <> a.sha then 'drifted: ' || a.path end as reason from a left join b b2 on b2.path = a.path),
links as (select path, link from (select distinct path, string_split(unnest(regexp_extract_all(content, '\\]\\(([^)\\s]+)\\)', 1)), '#')[1] as link from a_d) where ends_with(link, '.md') and not regexp_matches(link, '^(?:https?://|mailto:|#|/)|[{*]') and not regexp_matches(regexp_extract(link, '([^/]*)$', 1), '^\\d{8,}')),
lab as (select distinct path, label, string_split(raw, '#')[1] as link from (select path, unnest(regexp_extract_all(content, '(?:\\[([^\\[\\]\\n]*))?\\]\\(([^)\\s]+)\\)', 1)) as label, unnest(regexp_extract_all(content, '(?:\\[([^\\[\\]\\n]*))?\\]\\(([^)\\s]+)\\)', 2)) as raw from a_d)),
good as (select * from lab l where exists (from links k where k.path = l.path and k.link = l.link)),
tried as (select path as src, label, link, link as dst from good union select path, label, link, case when contains(path, '/') then regexp_replace(path, '[^/]*$', '') else '' end || link from good),
exact as (select * from tried where dst in (select path from a_d) and src <> dst),
home as (select skill as label, regexp_replace(path, '/?[^/]*$', '') as dir, min(path) as dst from a_d where skill is not null group by all),
edges as (select distinct src, dst from exact union select g.path, h.dst from good g join home h on h.label = g.label and h.dir = regexp_replace(g.link, '/?[^/]*$', '') where not exists (from exact e where e.src = g.path and e.link = g.link) and g.path <> h.dst),
bare as (select path as src, unnest(regexp_extract_all(content, '[A-Za-z0-9_./-]+\\.(?:md|py|sh)')) as name from a_d where ends_with(path, '.md')),
all_edges as (select * from edges union select src, dst from (select src, name as dst, name from bare union select src, case when contains(src, '/') then regexp_replace(src, '[^/]*$', '') else '' end || name, name from bare)
  where starts_with(dst, 'skills/') and dst in (select path from a_d) and src <> dst and not regexp_matches(regexp_extract(name, '([^/]*)$', 1), '^test_.*\\.py$')),
surface as (select distinct skill, path from a_d where skill is not null union select skill, dst from a_d join all_edges on src = path where skill is not null)
"""
)
ORACLES = {
    "h01_closure": _S + ", reach(start, node, depth) using key (start, node) as (select distinct path, path, 0 from a_d union select r.start, e.dst, r.depth + 1 from reach r join edges e on e.src = r.node left join recurring.reach k on k.start = r.start and k.node = e.dst where k.node is null) select start, node, depth from reach",
    "h01_edges": _S + "select src, dst from edges",
    "h02_links": _S + "select path, link from links",
    "h06_fingerprints": _S + "select * from fa",
    "h09_snapshot_diff": _S + "select skill, path, kind from diff",
    "h09_severity": _S + "select skill, count(*) filter (kind <> 'same') as moved, case when bool_or(kind in ('change', 'removed')) then 'change' when bool_or(kind = 'prose') then 'prose' when bool_or(kind = 'added') then 'addition' else 'none' end as severity from diff group by 1",
    "h13_impact": _S + """, m as (select skill, list(distinct path) as moved from diff where kind in ('change', 'prose', 'removed') group by 1)
select a.skill, a.path as scenario, case when b.sha is null then 'new' when b.sha <> a.sha then 'scenario_changed' when moved is null then 'unaffected' when not a.sha < '8' then 'undeclared' when list_contains(moved, a.path) then 'dependency_changed' else 'unaffected' end as reason from a left join b on b.skill = a.skill and b.path = a.path left join m on m.skill = a.skill""",
    "h15_carryover": _S + "select * from carry",
    "h18_moved": _S + "select skill, sha256(string_agg(path || chr(10) || coalesce(sb, '-') || chr(10) || coalesce(sa, '-'), chr(10) order by path)) as moved_sha from diff where kind <> 'same' group by 1",
    "h23_states": _S + "select coalesce(fa.skill, fb.skill) as skill, case when fb.fingerprint is null then 'unverified' when fa.fingerprint is null then 'orphan' when fa.fingerprint <> fb.fingerprint then 'stale' else 'verified' end as state from fa full join fb on fa.skill = fb.skill",
    "h24_coverage": "select skill, case when bool_or(doc_kind = 'scenario' and contains(skill, 'a')) then 'covered' when bool_or(doc_kind = 'prompt') then 'exempt' else 'uncovered' end as state from (select skill_name as skill, doc_kind from documents where skill_name is not null) group by 1",
    "h26_partial_update": _S + """, r as (select *, case when contains(scenario, 'docs/') then 'pass' when contains(scenario, 'evals/') then 'accepted-semantic' when reason is null then 'carried' else 'refused' end as result from carry),
g as (select skill, bool_or(result = 'refused') as refused, count(*) filter (result = 'carried') as carried, count(*) filter (result = 'pass') as ran, count(*) as scenarios from r group by 1)
select *, case when refused then 'nothing written' when ran = scenarios then 'pass' when carried > 0 then 'carried' else 'accepted-semantic' end as outcome from g""",
    "h30_calibration": "select case when level is null then 'unknown_verdict' when v is null then 'missing_verdict' when level >= 3 and v = 'pass' then 'false_negative' when level < 3 and v = 'flag' then 'false_positive' else 'right' end as outcome, count(*) as n from doc_level_sample full join (select doc_id, case when length(text) > 1200 then 'flag' else 'pass' end as v from documents where text is not null and doc_id % 3 <> 1) using (doc_id) group by 1",
    "h31_gate": "select *, case when unknown + missing > 0 then 'errors' when false_negatives > 0 then 'false negatives' when least(must_flag, must_pass) < 20 then 'too few cases' end as closed from (select 0::bigint as unknown, count(*) filter (v is null) as missing, count(*) filter (level >= 3 and v = 'pass') as false_negatives, count(*) filter (level < 3 and v = 'flag') as false_positives, count(*) filter (level >= 3) as must_flag, count(*) filter (level < 3) as must_pass from doc_level_sample left join (select doc_id, case when length(text) > 1200 then 'flag' else 'pass' end as v from documents) using (doc_id))",
    "j07_unresolved": _S + r""", raws as (select distinct path, raw, string_split(raw, '#')[1] as link from (select path, unnest(regexp_extract_all(content, '\]\(([^)\s]+)\)', 1)) as raw from a_d)),
aim as (select *, case when contains(path, '/') then regexp_replace(path, '[^/]*$', '') else '' end || link as target from raws where link <> ''),
judged as (select *, case when regexp_matches(link, '[{}<>*$]') then 'dynamic' when regexp_matches(link, '^[a-z]+:') then 'unsupported' when regexp_matches(link, '^/|(^|/)\.\./') then 'containment'
  when link in (select path from a_d) and target in (select path from a_d) and link <> target then 'ambiguous' when link not in (select path from a_d) and target not in (select path from a_d) then 'missing' end as kind from aim) select path, raw, kind from judged where kind is not null""",
    "j08_cycles": _S + ", lifted as (select distinct s.skill as src, d.skill as dst from edges e join a_d s on s.path = e.src join a_d d on d.path = e.dst where s.skill <> d.skill), reach(start, node) as (select src, dst from lifted union select start, dst from reach join lifted on src = node) select src, dst from lifted e where exists (from reach r where r.start = e.dst and r.node = e.src)",
    "j13_surface": _S + "select * from surface",
    "j15_impacted": _S + "select skill, count(*) as paths from surface where path in (select path from diff where kind <> 'same') group by 1",
    "h16_skill_results": _S + ", r as (select skill, case when contains(scenario, 'docs/') then 'pass' when reason is null then 'accepted-semantic' else 'accepted-without-run' end as result from carry) select skill, case when bool_and(result = 'pass') then 'pass' when bool_and(result <> 'accepted-without-run') then 'accepted-semantic' else 'accepted-without-run' end as result from r group by 1",
    "h34_bases": _S + ", rv as (select path, sha256(text) as sha, length(text) as chars, row_number() over (partition by path order by updated_at desc, doc_id desc) - 1 as seq from documents where path is not null and text is not null) select b.path, b.sha, arg_min(chars, seq)::int as chars from b left join rv on rv.path = b.path and rv.sha = b.sha and seq < 200 group by all",
}
