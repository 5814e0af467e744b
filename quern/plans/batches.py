"""Queries I, with the equivalent SQL."""

from __future__ import annotations

from quern.operators import batches as op

QUERIES = {n: getattr(op, n) for n in ("i02_estimates", "i03_dry_run", "i05_history", "i07_failed_streak", "i08_outcomes", "i10_summary", "i16_grades", "i17_roll_up", "i20_rerun")}

_C = """
with costs as (select p_brand as scenario, l_returnflag as route, l_partkey as input_bytes, (l_quantity * 10)::bigint as input_tokens, l_suppkey as output_tokens, l_extendedprice as wall_seconds, strftime(l_shipdate, '%Y-%m-%d') as observed from lineitem join part on p_partkey = l_partkey),
hist as (select scenario, route, unnest(v) from (select scenario, route, max(struct_pack(observed := observed, input_bytes := input_bytes, input_tokens := input_tokens, output_tokens := output_tokens, wall_seconds := wall_seconds)) as v from costs group by scenario, route)),
units as (select p_brand as scenario, route, sum(p_size)::bigint as input_bytes from part, (values ('A'), ('N'), ('R')) r(route) group by all),
est as (select u.scenario, u.route, u.input_bytes, greatest(1, ceil(u.input_bytes / 4.0))::bigint as approx_input_tokens, h.route is not null as measured,
  case when h.route is not null then greatest(1, round_even(coalesce(h.input_tokens, 0) * (u.input_bytes::double / coalesce(nullif(h.input_bytes, 0), nullif(u.input_bytes, 0), 1)), 0)::bigint) end as input_tokens, h.output_tokens, h.wall_seconds
  from units u left join (select * from hist where route <> 'A') h on h.scenario = u.scenario and h.route = u.route)
"""
_U = """
with u as (select o_custkey as run, o_orderkey as unit, o_orderdate as made, case o_orderstatus when 'F' then 'done' when 'O' then 'failed' else 'skipped' end as status, o_orderpriority as priority, o_totalprice as price from orders),
i as (select *, sum((status = 'done')::int) over (partition by run order by made, unit rows unbounded preceding) as island from u),
s as (select run, unit, status, sum((status = 'failed')::int) over (partition by run, island order by made, unit rows unbounded preceding)::bigint as streak from i)
"""
_GR = """
with r as (select o_orderpriority as skill, l_orderkey as unit, l_linenumber as expectation, min(l_returnflag) as flag, max(l_tax) as tax, max(l_quantity) as q from lineitem join orders on o_orderkey = l_orderkey group by all),
m as (select *, case when tax > 0.05 then q >= 45 else flag = 'R' end as miss, expectation = 1 as critical from r),
g as (select skill, unit, count(*) filter (miss and critical) as critical_missed, count(*) filter (miss and not critical) as other_missed, case when count(*) filter (miss and critical) > 0 then 'fail' else 'unadjudicated_pass' end as verdict from m group by all)
"""
ORACLES = {
    "i02_estimates": _C + "select * from est",
    "i03_dry_run": _C + "select count(*) as units, count(*) filter (measured) as measured, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(wall_seconds), 6) as wall_seconds, sum(approx_input_tokens)::bigint as approx_input_tokens, bool_or(not measured) as stop from est",
    "i05_history": _C + "select * from hist",
    "i07_failed_streak": _U + "select * from s",
    "i08_outcomes": "select row_id, error_kind, case error_kind when '' then '' when 'missing_prompt' then 'permanent' else 'transient' end as failure_class from (select row_id, case when message_id is null then 'missing_prompt' when row_id % 97 = 0 then 'timeout' when data is null then 'missing_artifact' when trim(data) = '' then 'empty_artifact' when not json_valid(data) then 'malformed_artifact' else '' end as error_kind from oc_part)",
    "i10_summary": _U + """, c as (select run, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed, max(streak) as streak, count(*) + 1 as total from s group by run)
select run, total, skipped, done, failed, streak, total - skipped - done - failed as pending, case when streak >= 3 then 'failed_streak' end as halt, case when streak >= 3 then 11 when failed > 0 then 10 else 0 end as exit_code from c""",
    "i16_grades": _GR + "select * from g",
    "i17_roll_up": _GR + "select skill, count(unit) as units, case when count(unit) = 0 then 'needs_rerun' when bool_or(verdict = 'fail') then 'fail' else 'unadjudicated_pass' end as result from (select distinct o_orderpriority as skill from orders union all select '9-NONE') left join g using (skill) group by skill",
    "i20_rerun": _U + "select unit, status from u where (status <> 'done' or starts_with(priority, '1')) and price <= 300000",
}
