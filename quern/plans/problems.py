"""Queries of the problems that are not about language: keys ``pN_…``."""

from __future__ import annotations

import re

from quern.functions.instants import ABBREVIATIONS, FORMS, MONTHS, OWN_ISO
from quern.operators import drift, instants, nested, orphans

QUERIES = {
    "p1_found": orphans.p1_found,
    "p1_by_month": orphans.p1_by_month,
    "p2_found": drift.p2_found,
    "p2_unions": drift.p2_unions,
    "p2_values": drift.p2_values,
    "p2_table_session_meta": drift.unified_table("rollout", "session_meta"),
    "p2_table_user_message": drift.unified_table("rollout", "user_message"),
    "p2_table_agent_message": drift.unified_table("rollout", "agent_message"),
    "p2_table_exec_command_end": drift.unified_table("rollout", "exec_command_end"),
    "p2_table_turn_aborted": drift.unified_table("rollout", "turn_aborted"),
    "p2_table_message": drift.unified_table("rollout", "message"),
    "p2_table_function_call": drift.unified_table("rollout", "function_call"),
    "p2_table_function_call_output": drift.unified_table("rollout", "function_call_output"),
    "p2_table_session": drift.unified_table("session_export", "session"),
    "p3_found": instants.p3_found,
    "p3_all": instants.p3_all,
    "p4_found": nested.p4_found,
    "p4_schema_paths": nested.p4_schema_paths,
    "p4_tables": nested.p4_tables,
    "p4_fields": nested.p4_fields,
    "p4_blocks": nested.p4_blocks,
    "p4_hunks": nested.p4_hunks,
}
_KINDS = "('session_meta', 'user_message', 'agent_message', 'exec_command_end', 'turn_aborted', 'message', 'function_call', 'function_call_output')"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), '^x(callid|type|kind|message|timestamp)', '\\1'), '(?:v[0-9]+|value)$', '')"
#: Records of both streams, their kinds, and one row per top-level field.
_FIELDS = f"""
with raw as (select 'rollout' as stream, row_id, log_file as file_name, type, loaded_at, case when json_valid(payload) then payload end as j from rollout
  union all select 'session_export', row_id, export_file, null, loaded_at, case when json_valid(record) then record end from session_export),
obj as (select * from raw where json_type(j) = 'OBJECT'),
keys as (select stream, row_id, unnest(json_keys(j)) as field from obj),
fld0 as (select k.*, o.j -> ('$."' || k.field || '"') as v from keys k join obj o using (stream, row_id)),
fld as (select *, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end as json_type,
  coalesce(case when json_type(v) = 'OBJECT' then v ->> '$.name' end, case when json_type(v) = 'ARRAY' then v ->> '$[0]' end, v ->> '$') as named, {_PLAIN.format("field")} as plain from fld0),
kinds as (select stream, row_id, arg_min(named, case when field = 'type' then 0 when field = 'kind' then 1 when plain in ('type', 'kind') then 2 else 3 end) as kind from fld where stream = 'rollout' and named in {_KINDS} group by all),
rec as (select o.stream, o.row_id, o.file_name, o.loaded_at, case when o.stream = 'session_export' then 'session' when o.type = 'session_meta' then 'session_meta' else k.kind end as record_kind from obj o left join kinds k using (stream, row_id))
"""
_ORPHANS = _FIELDS + """,
ids as (select distinct row_id, unnest(case when json_type(v) = 'ARRAY' then from_json(v, '["varchar"]') else [v ->> '$'] end) as call_id from fld where stream = 'rollout' and plain = 'callid'),
calls as (select r.row_id, r.file_name, r.loaded_at, r.record_kind, i.call_id from rec r join ids i using (row_id) where r.stream = 'rollout'),
refs as (select 'oc_part' as tbl, row_id, 'message_id' as field, 'message' as entity, '' as scope, message_id as key, loaded_at from oc_part union all select 'oc_part', row_id, 'session_id', 'session', '', session_id, loaded_at from oc_part
  union all select 'rollout', row_id, 'call_id', 'call', file_name, call_id, loaded_at from calls where record_kind in ('exec_command_end', 'function_call_output')),
tgt as (select 'message' as entity, '' as scope, id as key, min(loaded_at) as f from oc_message group by all union all select 'session', '', id, min(loaded_at) from oc_session group by all
  union all select 'call', file_name, call_id, min(loaded_at) from calls where record_kind = 'function_call' group by all),
gone as (select distinct entity, record_key as key from tombstone where restored_at is null),
orph as (select r.*, case when g.key is not null then 'deleted' when t.key is null then 'missing' when t.f > r.loaded_at then 'late' end as reason from refs r
  left join tgt t on t.entity = r.entity and t.scope = r.scope and t.key = r.key left join gone g on g.entity = r.entity and g.key = r.key where r.key <> '')
"""
_DRIFT = _FIELDS + """,
tot as (select stream, file_name, record_kind, count(*) as n from rec where record_kind is not null group by all),
per as (select r.stream, r.file_name, r.record_kind, f.field, count(*) as n, list_sort(list_distinct(list(f.json_type) filter (f.json_type is not null))) as types from rec r join fld f using (stream, row_id) where record_kind is not null group by all),
cat as (select t.*, c.field, c.json_type, c.required from tot t join field_catalog c using (stream, record_kind)),
retyped as (select c.stream, c.file_name, c.record_kind, c.field from cat c join per p using (stream, file_name, record_kind, field) where len(list_filter(p.types, lambda x: x <> c.json_type)) > 0),
absent as (select c.* from cat c where required and not exists (from per p where p.stream = c.stream and p.file_name = c.file_name and p.record_kind = c.record_kind and p.field = c.field)),
strange as (select p.*, t.n as records from per p join tot t using (stream, file_name, record_kind) where exists (from field_catalog c where c.stream = p.stream and c.record_kind = p.record_kind) and not exists (from field_catalog c where c.stream = p.stream and c.record_kind = p.record_kind and c.field = p.field)),
able as (select stream, file_name, record_kind, types[1] as json_type, count(*) as able, min(field) as now from strange where n = records and len(types) = 1 group by all),
judged as (select a.*, case when count(*) over (partition by a.stream, a.file_name, a.record_kind, a.json_type) = 1 and b.able = 1 then b.now end as now from absent a left join able b using (stream, file_name, record_kind, json_type)),
changes as (select stream, file_name, record_kind, field, 'retyped' as change from retyped union all select stream, file_name, record_kind, field, case when now is null then 'removed' else 'renamed' end from judged
  union all select stream, file_name, record_kind, field, 'added' from strange s where not exists (from judged j where j.stream = s.stream and j.file_name = s.file_name and j.record_kind = s.record_kind and j.now = s.field))
"""
#: Every node of the nested columns; ``owner`` is the label of the row it belongs to, ``name`` its path from there.
_NODES = """
with recursive text as (select 'session_one' as tbl, row_id, 'content' as path, message.content as t from session_one union all select 'oc_part', row_id, 'data', data from oc_part union all select 'oc_message', row_id, 'data', data from oc_message),
once as (select tbl, row_id, path, case when json_valid(t) then t::json end as j from text),
src as (select tbl, row_id, path, case when path = 'data' and json_type(j) = 'VARCHAR' then case when json_valid(j ->> '$') then (j ->> '$')::json end else j end as j from once),
tree as (select tbl, row_id, path, path as schema_path, '0' as label, null::varchar as owner, '' as name, false as in_array, j, json_type(j) as t from src where j is not null
  union all select tbl, row_id, path || s, schema_path || p, label || '.' || i, case when home then label else owner end, case when home then ltrim(s, '.') else name || s end, p = '[]', c, json_type(c) from (
    select *, '.' || k as s, '.' || k as p, j -> ('$."' || k || '"') as c from (select *, t = 'OBJECT' and (in_array or owner is null) as home, unnest(json_keys(j)) as k, unnest(range(len(json_keys(j)))) as i from tree where t = 'OBJECT')
    union all select *, '[' || i || ']', '[]', j -> ('$[' || i || ']') from (select *, owner is null as home, null as k, unnest(range(json_array_length(j)::bigint)) as i from tree where t = 'ARRAY'))),
node as (select *, case t when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind from tree)
"""
_COLUMNS = "select row_id, label, owner as parent_label, path, {fields} from node "


def _form(name: str) -> tuple[str, list[str]]:
    """A form's pattern without names of groups, and their names in order."""
    body = FORMS[name].format(k="")
    return "^" + re.sub(r"\?<\w>", "", body) + "$", re.findall(r"\(\?<(\w)>", body)


def _part(part: str) -> str:
    return "case form " + " ".join(f"when '{f}' then regexp_extract(t, '{_form(f)[0]}', {_form(f)[1].index(part) + 1})" for f in FORMS if part in _form(f)[1]) + f" else '' end as p{part}"


#: Every time of the three tables: what it says, its readings on the clock of its machine, and which of two fits the line before.
_TIMES = f"""
with src as (select 'session_one' as tbl, row_id, log_file, line_no, machine, "timestamp" as text from session_one union all select 'rollout', row_id, log_file, line_no, machine, case when json_valid(payload) then payload::json ->> '$.timestamp' end from rollout where type = 'session_meta'
  union all select 'oc_message', row_id, null, null, null, time_created::varchar from oc_message),
formed as (select *, case {" ".join(f"when regexp_matches(t, '{_form(f)[0]}') then '{f}'" for f in FORMS)} end as form from (select *, trim(text) as t from src)),
parts as (select *, {", ".join(_part(x) for x in "ymdhisfpzn")} from formed),
whole as (select *, try_cast(py as bigint) as y, case when regexp_matches(pm, '^[A-Za-z]') then case when strpos('{MONTHS}', lower(pm)) % 3 = 1 then (strpos('{MONTHS}', lower(pm)) + 2) // 3 end else try_cast(pm as bigint) end as mo, try_cast(pd as bigint) as d,
  case when pp = '' then try_cast(ph as bigint) when try_cast(ph as bigint) between 1 and 12 then try_cast(ph as bigint) % 12 + case when lower(pp) = 'p' then 12 else 0 end end as h, try_cast(pi as bigint) as mi, case when ps = '' then 0 else try_cast(ps as bigint) end as sc,
  case when pf = '' then 0 else rpad(pf, 9, '0')::bigint end as f, try_cast(nullif(pn, '') as bigint) as n, case when length(pn) <= 11 then 1 when length(pn) <= 14 then 1000 when length(pn) <= 17 then 1000000 else 1000000000 end as unit,
  (case when pz[1] = '-' then -1 else 1 end) * (try_cast(substr(pz, 2, 2) as bigint) * 3600 + coalesce(try_cast(right(replace(substr(pz, 4), ':', ''), 2) as bigint), 0) * 60) as given from parts where form is not null),
clocked as (select *, case when y >= 1 and mo between 1 and 12 and h between 0 and 23 and mi between 0 and 59 and sc between 0 and 59 and d >= 1 and d <= day(last_day(make_date(y, mo, 1))) then date_diff('day', date '1970-01-01', make_date(y, mo, d)) * 86400 + h * 3600 + mi * 60 + sc end as clock,
  case when regexp_matches(pz, '^[+-]') then case when abs(given) <= 54000 then given end else (map {{{", ".join(f"'{k}': {v}" for k, v in ABBREVIATIONS.items())}}})[upper(pz)] end as off from whole),
said as (select *, case when pn <> '' then case when n > 0 then n // unit end when pz <> '' then clock - off end as sec0, case when pn = '' and pz = '' then clock end as loc, case when pn <> '' then case when length(pn) <= 11 then f else (n % unit) * (1000000000 // unit) end else f end as nano from clocked),
zoned as (select s.*, coalesce(zone_name, 'UTC') as zone from said s left join (select machine, min(zone_name) as zone_name from machine_zone where machine is not null group by 1) z using (machine)),
ab as (select *, loc - (epoch(timezone(zone, to_timestamp(loc - 86400)))::bigint - (loc - 86400)) as a, loc - (epoch(timezone(zone, to_timestamp(loc + 86400)))::bigint - (loc + 86400)) as b from zoned),
held as (select * replace (case when epoch(timezone(zone, to_timestamp(a)))::bigint = loc then a end as a, case when epoch(timezone(zone, to_timestamp(b)))::bigint = loc then b end as b) from ab),
readings as (select tbl, row_id, log_file, line_no, text, nano, coalesce(sec0, case when least(a, b) = greatest(a, b) and tbl <> 'oc_message' then least(a, b) end) as sec, case when least(a, b) <> greatest(a, b) and tbl <> 'oc_message' then least(a, b) end as early, case when least(a, b) <> greatest(a, b) and tbl <> 'oc_message' then greatest(a, b) end as late from held),
lines as (select tbl, log_file, line_no, unnest(v) from (select tbl, log_file, line_no, arg_min(struct_pack(moment := coalesce(sec, early), early := early, late := late), row_id) as v from readings where (sec is not null or early is not null) and line_no is not null group by all)),
prior as (select *, lag(moment) over w as was, lag(early is not null) over w as twice from lines window w as (partition by tbl, log_file order by line_no)),
marked as (select *, sum((was is null or not twice or abs(was - early) > 86400)::int) over (partition by tbl, log_file order by line_no) as run, coalesce(early < was, false) as back from prior where early is not null),
settled as (select tbl, log_file, line_no, case when bool_or(back) over (partition by tbl, log_file, run order by line_no) then late else early end as fits from marked),
times as (select r.tbl, r.row_id, (coalesce(sec, fits, r.early) * 1000 + nano // 1000000)::bigint as utc_ms, case when r.tbl = 'oc_message' then length(text) between 12 and 14 else regexp_matches(text, '{OWN_ISO}') end as own_form from readings r left join settled s on r.early is not null and s.tbl = r.tbl and s.log_file = r.log_file and s.line_no = r.line_no)
"""
ORACLES: dict[str, str] = {
    "p3_found": _TIMES + "select tbl, row_id, utc_ms from times where utc_ms is not null and not own_form",
    "p3_all": _TIMES + "select tbl, row_id, utc_ms, own_form from times where utc_ms is not null",
    "p1_found": _ORPHANS + "select distinct tbl, row_id, field, reason from orph where reason is not null",
    "p1_by_month": _ORPHANS + "select tbl, field, reason, strftime(loaded_at, '%Y-%m') as month, count(*) as n from orph where reason is not null group by all",
    "p2_found": _DRIFT + "select * from changes",
    "p2_unions": _DRIFT + """select stream, record_kind, field, json_type, sum(n)::bigint as records, count(*) as files, min(first_seen) as first_seen, max(last_seen) as last_seen, arg_min(file_name, row(first_seen, file_name)) as first_file, arg_max(file_name, row(last_seen, file_name)) as last_file
from (select r.stream, r.file_name, r.record_kind, f.field, f.json_type, count(*) as n, min(loaded_at) as first_seen, max(loaded_at) as last_seen from rec r join fld f using (stream, row_id) where record_kind is not null and f.json_type is not null group by all) group by all""",
    "p2_values": _DRIFT + """, named as (select r.stream, r.row_id, r.file_name, r.record_kind, f.field as held_as, f.json_type, f.v ->> '$' as value, coalesce(c.field, j.field, f.field) as field from rec r join fld f using (stream, row_id)
  left join field_catalog c on c.stream = r.stream and c.record_kind = r.record_kind and c.field = f.field left join judged j on j.stream = r.stream and j.file_name = r.file_name and j.record_kind = r.record_kind and j.now = f.field
  where r.record_kind is not null and f.json_type is not null and (r.stream, r.record_kind) in (select (stream, record_kind) from field_catalog))
select n.stream, row_id, file_name, n.record_kind, n.field, held_as, n.json_type, value, case when c.field is null then 'extra' when c.json_type = n.json_type then 'canonical' else 'branch' end as part from named n left join field_catalog c on c.stream = n.stream and c.record_kind = n.record_kind and c.field = n.field""",
    "p4_found": _NODES + "select tbl, row_id, path from node where kind = 'object' and in_array",
    "p4_schema_paths": _NODES + 'select tbl, schema_path, kind, count(*) as nodes, count(distinct row_id) as "rows" from node group by all',
    "p4_fields": _NODES + "select n.tbl, n.row_id, o.schema_path, o.label, o.owner as parent_label, n.label as at, n.name, n.kind, case when n.kind <> 'null' then n.j ->> '$' end as value from node n join node o on o.tbl = n.tbl and o.row_id = n.row_id and o.label = n.owner where n.kind not in ('object', 'array')",
    "p4_blocks": _NODES + _COLUMNS.format(fields=", ".join(f"""case when json_type(j -> '$.{f}') not in ('OBJECT', 'ARRAY', 'NULL') then j ->> '$.{f}' end as {f}""" for f in ("type", "text", "id", "name", "tool_use_id", "content"))) + "where tbl = 'session_one' and schema_path = 'content[]' and kind = 'object'",
    "p4_hunks": _NODES + _COLUMNS.format(fields="j ->> '$.start' as start") + "where tbl = 'oc_part' and schema_path = 'data.state.metadata.files[].hunks[]' and kind = 'object'",
}
