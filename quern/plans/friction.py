"""Queries C: sessions and friction, with the equivalent SQL."""

from __future__ import annotations

from quern.operators import friction as op

QUERIES = {name: getattr(op, name) for name in ("c01_split", "c02_sessions", "c03_firings", "c04_session_skills", "c07_corrections", "c09_skill_friction", "c10_totals", "c18_store_report", "c26_harvest", "c27_session_shapes")}

_CAPS = "with caps(store, structural, abandonment_signal) as (values ('claude', true, false), ('opencode', true, false), ('codex', false, true)), "
_CLICKS = """raw as (
  select case user_id % 3 when 0 then 'claude' when 1 then 'opencode' else 'codex' end as store,
         user_id || '/' || strftime(date_trunc('week', ts), '%Y-%m-%d') as sid, ts, event_id, event_type,
         cast(json_extract_string(props, '$.k') as int) as k from events),
ev as (
  select store, sid, ts, event_id, 0 as sub,
         case event_type when 'signup' then 'fire' when 'purchase' then 'fire' when 'click' then 'turn' when 'view' then 'turn' else 'error' end as kind,
         case event_type when 'signup' then 'text' when 'purchase' then 'structural' end as route,
         case when event_type in ('signup', 'purchase') then 'skill_' || (k % 5) end as skill from raw
  union all select store, sid, ts, event_id, 1, 'text', null, null from raw where event_type = 'click'
  union all select store, sid, ts, event_id, 1, 'abandoned', null, null from raw where event_type = 'error' and store = 'codex' and k % 10 = 0),
"""
#: What follows from events ``ev``: store, sid, ts, event_id, sub, kind, route, skill.
AFTER_EVENTS = """
t as (select *, coalesce(sum((kind = 'turn')::int) over (partition by store, sid order by ts, event_id, sub rows unbounded preceding), 0)::bigint as turn_no from ev),
p as (select *,
  last_value(case when kind = 'fire' then skill end ignore nulls) over w as ls,
  last_value(case when kind = 'fire' then route end ignore nulls) over w as lr,
  last_value(case when kind = 'fire' then turn_no end ignore nulls) over w as lt
  from t window w as (partition by store, sid order by ts, event_id, sub rows between unbounded preceding and 1 preceding)),
m as (select *, coalesce(kind = 'fire' and ls = skill and turn_no - lt <= 3, false) as near,
  coalesce(kind = 'fire' and ls = skill and turn_no - lt <= 3 and lr = 'text' and route = 'structural', false) as folded from p),
f as (select *, coalesce(sum((kind = 'fire' and not folded)::int) over (partition by store, sid order by ts, event_id, sub rows unbounded preceding), 0)::bigint as grp from m),
g0 as (select store, sid, grp, max(skill) filter (kind = 'fire' and not folded) as skill, max(route) filter (kind = 'fire' and not folded) as route,
  bool_or(kind = 'fire' and not folded and near) as retry, count(*) filter (kind = 'text') as said, count(*) filter (folded) as folded from f where grp >= 1 group by all),
g as (select *, case when lead(grp) over w is null then said when lead(retry) over w then 0 else greatest(said - (lead(route) over w = 'text')::int, 0) end::bigint as corrections
  from g0 window w as (partition by store, sid order by grp)),
rt as (select distinct store, sid, skill, unnest(case when folded > 0 then [route, 'structural'] else [route] end) as r from g),
sk as (select g.store, g.sid, g.skill, count(*) as invocations, case when count(*) filter (retry) > 0 then count(*) filter (retry) + 1 else 0 end as retries,
  sum(corrections)::bigint as corrections, sum(folded)::bigint as folded,
  (select string_agg(r, ',' order by r) from (select distinct r from rt where rt.store = g.store and rt.sid = g.sid and rt.skill = g.skill)) as routes
  from g group by g.store, g.sid, g.skill),
se as (select store, sid, turns, tool_errors, case when abandonment_signal then recorded else turns > 0 and tool_errors > 0.3::double * turns end as abandoned
  from (select store, sid, count(*) filter (kind = 'turn') as turns, count(*) filter (kind = 'error') as tool_errors, bool_or(kind = 'abandoned') as recorded from ev group by all) join caps using (store)),
fr as (select skill, count(distinct sk.store || '|' || sk.sid) as sessions, sum(invocations)::bigint as invocations, sum(retries)::bigint as retries, sum(corrections)::bigint as corrections,
  sum(folded)::bigint as folded, sum(turns)::bigint as turns, sum(tool_errors)::bigint as tool_errors, count(*) filter (abandoned) as abandoned,
  (select string_agg(s, ',' order by s) from (select unnest(list_distinct(list(sk.store))) as s)) as stores, bool_or(not structural) as downgraded,
  (select coalesce(string_agg(s, ',' order by s), '') from (select unnest(list_distinct(list(sk.store) filter (not abandonment_signal))) as s)) as inferred_stores
  from sk join se on sk.store = se.store and sk.sid = se.sid join caps on caps.store = sk.store group by skill)
"""
_CTE = _CAPS + _CLICKS + AFTER_EVENTS
SCORED = """select *, case when score < 1 then 'Excellent' when score < 2 then 'Good' when score < 3 then 'Acceptable' when score < 5 then 'Needs Attention' when score < 7 then 'Problematic' else 'Critical' end as band,
  case greatest(case when invocations <= 2 then 0 when invocations <= 9 then 1 else 2 end - downgraded::int, 0) when 0 then 'Low' when 1 then 'Medium' else 'High' end as confidence,
  case when score <= 2 then 'none' when score < 6 then 'Small' else 'Large' end as recommendation
  from (select *, round(least(10.0::double, 3 * retries / invocations::double + 2 * least(1.0::double, corrections / (5 * invocations::double)) + 3 * abandoned / invocations::double
    + 2 * least(1.0::double, tool_errors::double / greatest(turns, 1))), 6) as score from fr)"""

ORACLES = {
    "c01_split": _CTE + "select store, event_id, sub, sum((kind = 'fire' and route = 'text')::int) over (partition by store order by ts, event_id, sub rows unbounded preceding)::bigint as session_seq from ev",
    "c02_sessions": _CTE + "select * from se",
    "c03_firings": _CTE + "select store, sid, event_id, skill, route, turn_no, near, folded, grp from f where kind = 'fire'",
    "c04_session_skills": _CTE + "select * from sk",
    "c07_corrections": _CTE + "select store, sid, grp, skill, route, retry, said, corrections, folded from g",
    "c09_skill_friction": _CTE + SCORED,
    "c10_totals": _CTE + "select * from (select count(*) as sessions, sum(turns)::bigint as turns, sum(tool_errors)::bigint as tool_errors, count(*) filter (abandoned) as abandoned from se), (select sum(invocations)::bigint as invocations, count(distinct skill) as skills from sk)",
    "c18_store_report": _CTE
    + "select c.*, coalesce(sessions, 0) as sessions, coalesce(turns, 0) as turns from (values ('claude', true, true, false, false), ('opencode', true, true, false, false), ('codex', true, false, true, true)) c(store, text, structural, abandonment_signal, error_detection_partial) left join (select store, count(*) as sessions, sum(turns)::bigint as turns from se group by 1) using (store)",
    "c26_harvest": _CTE + "select store, sid, event_id, ls as fired_skill, case when ls is null then '' else 'correction_after_skill' end as signals from p where kind = 'text'",
    "c27_session_shapes": _CTE + "select count(*) as sessions, count(*) filter (n > 1) as several_skills, count(*) filter (tool_errors >= 3) as many_errors from se left join (select store, sid, count(*) as n from sk group by all) using (store, sid)",
}
