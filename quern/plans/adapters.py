"""Queries A and B over the log tables, with the equivalent SQL; the adapters are also checked against hand-made logs in the tests."""

from __future__ import annotations

from quern.functions import text as tx
from quern.functions.instants import ABBREVIATIONS
from quern.operators import adapters as op
from quern.plans.friction import _CAPS, AFTER_EVENTS, SCORED

QUERIES = {n: getattr(op, n) for n in ("a09_stored_sessions", "b09_session_events", "b13_part_events", "b15_rollout_sessions", "b18_rollout_events", "c09_log_friction", "c21_secret_kinds")}

_ZONES = ", ".join(f"'{z}'" for z in ABBREVIATIONS)
#: Whether a text is a readable ISO time (A19): its parts are a day and a clock of the calendar, its zone is none, an offset or a known name.
_TIME = r"'^(\d{4})-(\d{1,2})-(\d{1,2})[Tt ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([A-Za-z]{1,4}|[+-]\d{2}(?::?\d{2})?))?$'"


def _readable(text: str) -> str:
    part = lambda i: f"regexp_extract(trim({text}), {_TIME}, {i})"
    return (
        f"(regexp_matches(trim({text}), {_TIME}) and try_cast({part(1)} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(3)}, 2, '0') as date) is not null and {part(1)} <> '0000' and {part(4)}::int <= 23 and {part(5)}::int <= 59 and coalesce(nullif({part(6)}, '')::int, 0) <= 59"
        f" and ({part(8)} = '' or upper({part(8)}) in ({_ZONES}) or (regexp_matches({part(8)}, '^[+-]') and abs(try_cast(substr({part(8)}, 1, 3) as int)) <= 15)))"
    )


def _event(kind, role="null::varchar", skill="null::varchar", route="null::varchar", tool="null::varchar", text="null::varchar"):
    return f"struct_pack(kind := '{kind}', role := {role}, skill := {skill}, route := {route}, tool := {tool}, body := {text})"


def _when(condition: str, event: str) -> str:
    return f"case when {condition} then [{event}] else [] end"


def _string(v: str) -> str:
    return f"case when json_type({v}) = 'VARCHAR' then {v} ->> '$' end"


#: Blocks of a body written as a list, as a list of JSON objects.
_BLOCKS = "case when json_type(body) = 'ARRAY' then list_filter(body::json[], lambda b: json_type(b) = 'OBJECT') else [] end"
_SLASH = "nullif(regexp_extract(said, '/([a-z][a-z0-9-]*):([a-z][a-z0-9-]*)', 2), '')"
_SAID = f"list_concat({_when('said is not null', _event('text', text='said'))}, {_when(_SLASH + ' is not null', _event('fire', skill=_SLASH, route=repr('text')))})"
_FITTED = "nullif(coalesce(nullif(regexp_extract(s, '^([a-z][a-z0-9-]*):([a-z][a-z0-9-]*)$', 2), ''), s), '')"


def _joined(kinds: str) -> str:
    texts = f"list_filter(list_transform(list_filter(blocks, lambda b: (b ->> '$.type') in ({kinds})), lambda b: {_string('(b -> ' + repr('$.text') + ')')}), lambda x: x is not null)"
    return f"case when json_type(body) = 'VARCHAR' then nullif(body ->> '$', '') when len({texts}) > 0 then array_to_string({texts}, chr(10)) end"


#: The tool that failed: the last call of that id in the file up to the answer.
_TOOL = "case when failed then coalesce((select arg_max(c.name, c.pos) from calls c where c.file = r.file and c.id = r.answered and c.pos <= r.pos), 'unknown') end"
_SESSION = f"""
with s0 as (select * from session_one qualify row_number() over (partition by log_file, line_no order by row_id) = 1),
s1 as (select log_file as file, line_no as pos, case when lower(trim(message.role)) in ('user', 'assistant') then lower(trim(message.role)) end as role, case when json_valid(message.content) then message.content::json end as body,
  case when json_valid(tooluseresult) then tooluseresult::json end as beside from s0 where regexp_matches("timestamp", '^\\d{{4}}-') and {_readable('"timestamp"')}),
every as (select log_file as file, line_no as pos, case when json_valid(message.content) then message.content::json end as body from s0),
calls as (select file, pos, b ->> '$.id' as id, b ->> '$.name' as name from (select file, pos, unnest({_BLOCKS}) as b from every) where b ->> '$.type' = 'tool_use' and json_type(b -> '$.id') = 'VARCHAR' and json_type(b -> '$.name') = 'VARCHAR'),
s2 as (select *, {_BLOCKS} as blocks from s1),
s3 as (select *, list_filter(blocks, lambda b: (b ->> '$.type') = 'tool_result' and coalesce((b ->> '$.is_error') = 'true', false)) as errors, case when role = 'user' then {_joined("'text'")} end as said,
  list_filter(list_transform(list_filter(blocks, lambda b: (b ->> '$.type') = 'tool_use' and (b ->> '$.name') in ('Skill', 'skill')), lambda b: {_string("(b -> '$.input.skill')")}), lambda s: s is not null) as named from s2),
r as (select *, len(errors) > 0 or coalesce((beside ->> '$.is_error') = 'true', false) as failed, errors[1] ->> '$.tool_use_id' as answered from s3),
e as (select file, pos, list_concat({_when("role is not null and (json_type(body) = 'VARCHAR' or len(list_filter(blocks, lambda b: (b ->> '$.type') = 'text')) > 0)", _event("turn", role="role"))},
  {_SAID}, list_transform(list_filter(list_transform(named, lambda s: {_FITTED}), lambda s: s is not null), lambda s: {_event("fire", skill="s", route="'structural'")}), {_when("failed", _event("error", tool="tool"))}) as events
  from (select *, {_TOOL} as tool from r)),
session_events as (select file as sid, pos, unnest(generate_series(0, len(events) - 1))::int as sub, unnest(events) as ev from e where len(events) > 0)
"""
_ROLLOUT = f"""
with r0 as (select * from rollout qualify row_number() over (partition by log_file, line_no order by row_id) = 1),
r1 as (select log_file as file, line_no as pos, type, "timestamp" as ts, case when json_valid(payload) then payload::json end as p from r0),
faces as (select file, bool_or(coalesce(type = 'event_msg' and p ->> '$.type' = 'user_message', false)) as face from r1 group by 1),
calls as (select file, pos, p ->> '$.call_id' as id, p ->> '$.name' as name from r1 where (p ->> '$.type') in ('function_call', 'custom_tool_call') and json_type(p -> '$.call_id') = 'VARCHAR' and json_type(p -> '$.name') = 'VARCHAR'),
r2 as (select r1.*, p ->> '$.type' as spoken, face, p -> '$.content' as body, json_type(p -> '$.exit_code') as code_type from r1 join faces using (file) where regexp_matches(ts, '^\\d{{4}}-') and {_readable("ts")}),
r3 as (select *, {_BLOCKS} as blocks from r2),
r4 as (select *, coalesce(not face and type = 'response_item' and spoken = 'message' and (p ->> '$.role') in ('user', 'assistant'), false) as by_item, coalesce(face and type = 'event_msg', false) as by_face,
  coalesce(spoken = 'exec_command_end' and case when code_type in ('UBIGINT', 'BIGINT') then (p ->> '$.exit_code') <> '0' when code_type = 'BOOLEAN' then (p ->> '$.exit_code') = 'true' end, false) as failed,
  case when spoken = 'exec_command_end' then p ->> '$.call_id' end as answered from r3),
r as (select *, case when by_item then p ->> '$.role' when by_face and spoken = 'user_message' then 'user' when by_face and spoken = 'agent_message' then 'assistant' end as speaker,
  nullif(case when by_item and p ->> '$.role' = 'user' then {_joined("'input_text', 'output_text'")} when by_face and spoken = 'user_message' then {_string("(p -> '$.message')")} end, '') as said from r4),
e as (select file, pos, list_concat({_when("speaker is not null", _event("turn", role="speaker"))}, {_SAID}, {_when("spoken = 'turn_aborted'", _event("abandoned"))}, {_when("failed", _event("error", tool="tool"))}) as events from (select *, {_TOOL} as tool from r)),
rollout_events as (select file as sid, pos, unnest(generate_series(0, len(events) - 1))::int as sub, unnest(events) as ev from e where len(events) > 0)
"""


def _decoded(source: str) -> str:
    return f"(select * from (select *, case when json_type(v) = 'VARCHAR' then case when json_valid(v ->> '$') then (v ->> '$')::json end else v end as d from (select *, case when json_valid(data) then data::json end as v from {source})) where json_type(d) = 'OBJECT')"


_ROLE = "lower(regexp_replace(d ->> '$.role', '^\\s+|\\s+$', '', 'g'))"
_PARTS = f"""
with p0 as (select message_id, time_created, id, d ->> '$.type' = 'text' as is_text, case when d ->> '$.type' = 'text' then nullif({_string("(d -> '$.text')")}, '') end as said,
  case when d ->> '$.type' = 'tool' and d ->> '$.tool' = 'skill' then nullif({_string("(d -> '$.state.input.name')")}, '') end as skill,
  case when d ->> '$.type' = 'tool' and d ->> '$.state.status' = 'error' then coalesce(nullif({_string("(d -> '$.tool')")}, ''), 'unknown') end as failure from {_decoded("oc_part")}),
g as (select message_id, list(struct_pack(time_created, id, is_text, said, skill, failure) order by time_created nulls first, id nulls first, is_text nulls first, said nulls first, skill nulls first, failure nulls first) as parts from p0 group by 1),
m as (select session_id as sid, id as message, time_created, case {_ROLE} when 'human' then 'user' when 'ai' then 'assistant' when 'model' then 'assistant' else {_ROLE} end as role0, coalesce(parts, []) as parts
  from {_decoded("oc_message")} x left join g on g.message_id = x.id where time_created is not null),
m1 as (select *, case when role0 in ('user', 'assistant') then role0 end as role, list_filter(list_transform(parts, lambda x: x.said), lambda x: x is not null) as texts from m),
m2 as (select *, case when role = 'user' and len(texts) > 0 then array_to_string(texts, chr(10)) end as said from m1),
e as (select sid, message, time_created, list_concat({_when("role is not null and len(list_filter(parts, lambda x: coalesce(x.is_text, false))) > 0", _event("turn", role="role"))}, {_SAID},
  flatten(list_transform(parts, lambda x: list_concat({_when("x.skill is not null", _event("fire", skill="x.skill", route="'structural'"))}, {_when("x.failure is not null", _event("error", tool="x.failure"))})))) as events from m2),
part_events as (select sid, message, time_created, unnest(generate_series(0, len(events) - 1))::int as sub, unnest(events) as ev from e where len(events) > 0)
"""
_FLAT = "ev.kind as kind, ev.role as role, ev.skill as skill, ev.route as route, ev.tool as tool"
#: Events of all three stores in one form; a message stands at its time and id.
_ALL = (
    f"ev as (select 'claude' as store, sid, pos::bigint as ts, '' as event_id, sub, {_FLAT}, ev.body as body from ({_SESSION} select * from session_events) union all "
    f"select 'codex', sid, pos::bigint, '', sub, {_FLAT}, ev.body from ({_ROLLOUT} select * from rollout_events) union all "
    f"select 'opencode', sid, time_created, message, sub, {_FLAT}, ev.body from ({_PARTS} select * from part_events)), "
)
_KINDS = ", ".join(f"""case when regexp_matches(body, '{p.replace("'", "''")}') then '{k}' end""" for k, p in tx.SECRETS)
ORACLES = {
    "a09_stored_sessions": "select 'opencode' as store, id as sid, id as session_id, regexp_replace(directory, '[^A-Za-z0-9-]', '-', 'g') as project, false as superset from oc_session where id is not null and directory is not null",
    "b15_rollout_sessions": """
with r as (select log_file, line_no, type, case when json_valid(payload) then payload end as p from (select * from rollout qualify row_number() over (partition by log_file, line_no order by row_id) = 1)),
s as (select log_file, arg_min(coalesce(case when json_type(p, '$.session_id') = 'VARCHAR' then p ->> '$.session_id' end, case when json_type(p, '$.id') = 'VARCHAR' then p ->> '$.id' end), line_no) filter (type = 'session_meta') as id,
  arg_min(coalesce(case when json_type(p, '$.cwd') = 'VARCHAR' then p ->> '$.cwd' end, chr(0)), line_no) filter (type = 'session_meta') as cwd,
  bool_or(coalesce(type = 'event_msg' and p ->> '$.type' = 'user_message', false)) as face from r group by 1)
select 'codex' as store, log_file as sid, coalesce(id, regexp_replace(regexp_extract(log_file, '([^/]*)$', 1), '\\.[^.]*$', '')) as session_id, case when cwd is null or cwd = chr(0) then '' else regexp_replace(cwd, '[^A-Za-z0-9-]', '-', 'g') end as project, not face as superset from s""",
    "b09_session_events": _SESSION + f"select sid, pos, sub, {_FLAT} from session_events",
    "b13_part_events": _PARTS + f"select sid, message, sub, {_FLAT} from part_events",
    "b18_rollout_events": _ROLLOUT + f"select sid, pos, sub, {_FLAT} from rollout_events",
    "c09_log_friction": _CAPS + _ALL + AFTER_EVENTS + SCORED,
    "c21_secret_kinds": _CAPS + _ALL.rstrip(", ") + f" select secret, store, count(*) as utterances from (select store, unnest(list_filter([{_KINDS}], lambda x: x is not null)) as secret from ev where kind = 'text') group by all",
}
