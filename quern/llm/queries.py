"""Queries of the problems of language: keys ``pN_…``."""

from __future__ import annotations

from quern.llm import conversations, levels, packing, pii, tokens
from quern.plans.problems import _TIMES

QUERIES = {
    "p5_found": pii.p5_found,
    "p5_masked": pii.p5_masked,
    "p6_found": conversations.p6_found,
    "p6_links": conversations.p6_links,
    "p7_ids": tokens.p7_ids,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p9_found": levels.p9_found,
    "p9_profile": levels.p9_profile,
}
_NOT_BLANK = r"[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE = _NOT_BLANK.replace("[^", "[")


def _speaker(role: str) -> str:
    plain = f"lower(regexp_replace({role}, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
    return f"case when {plain} in ('user', 'human') then 'user' when {plain} in ('assistant', 'ai', 'model') then 'assistant' when {plain} = 'system' then 'system' else '?' end"


def _says(v: str) -> str:
    """Whether a block is a text that says something."""
    return f"({v} ->> '$.type') = 'text' and json_type({v} -> '$.text') = 'VARCHAR' and regexp_matches({v} ->> '$.text', '{_NOT_BLANK}')"


_INNER = "case when json_type(v) = 'VARCHAR' then case when json_valid(v ->> '$') then (v ->> '$')::json end else v end"
#: Turns of both tables in the order of their conversations, and which conversations are sound.
_TALK = _TIMES + f"""
, lead_in as (select log_file, arg_min(row(coalesce(sec, early), nano), row(line_no, row_id)) as first from readings where tbl = 'session_one' and coalesce(sec, early) is not null group by 1),
owners as (select log_file, min(sessionid) as owner from session_one where sessionid is not null group by 1),
s0 as (select *, case when json_valid(message.content) then message.content::json end as c from session_one qualify row_number() over (partition by log_file, line_no order by row_id) = 1),
s1 as (select *, coalesce(sessionid, owner) as conv_id, {_speaker("coalesce(message.role, type)")} as speaker from s0 left join owners using (log_file)
  where case json_type(c) when 'VARCHAR' then regexp_matches(c ->> '$', '{_NOT_BLANK}') when 'ARRAY' then len(list_filter(c::json[], lambda b: {_says("b")})) > 0 else false end),
parts_said as (select distinct message_id from (select message_id, {_INNER} as d from (select message_id, case when json_valid(data) then data::json end as v from oc_part where message_id is not null)) where {_says("d")}),
m0 as (select * from oc_message where id is not null and session_id is not null qualify row_number() over (partition by id order by row_id) = 1),
m1 as (select row_id, id, session_id, {_speaker("d ->> '$.role'")} as speaker from (select *, {_INNER} as d from (select *, case when json_valid(data) then data::json end as v from m0)) where id in (select message_id from parts_said)),
turns as (select 'session_one' as tbl, conv_id, row_id, speaker, row(first is null, first[1], first[2], s1.log_file, line_no, '') as place from s1 left join lead_in using (log_file) where conv_id is not null and speaker <> 'system'
  union all select 'oc_message', session_id, m1.row_id, speaker, row(sec is null, sec, nano, '', 0, id) from m1 left join readings r on r.tbl = 'oc_message' and r.row_id = m1.row_id where speaker <> 'system'),
placed as (select *, row_number() over w as turn_no, lead(speaker) over w as following from turns window w as (partition by tbl, conv_id order by place)),
kept as (select *, bool_and(speaker <> '?' and (turn_no > 1 or speaker = 'user') and (speaker <> 'user' or coalesce(following = 'assistant', false))) over (partition by tbl, conv_id) as sound from placed)
"""
ORACLES: dict[str, str] = {"p6_found": _TALK + "select tbl, conv_id, turn_no, row_id from kept where sound"}
