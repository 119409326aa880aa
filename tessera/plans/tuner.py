"""Tuner queries: search grids, schedules, decisions. The state machine itself is ``tessera.operators.tuner``."""

from __future__ import annotations

from tessera.registry import Q6, shared

shared("tun1_grid", f"""with a as (select r_regionkey as i from {{region}}), b as (select r_regionkey as i from {{region}} where r_regionkey < 4)
  select a.i + 5 * b.i as point, {Q6('pow(10.0::double, -5 + a.i * 1.25::double)')} as lr, element_at(array(0, 1, 3, 7), b.i + 1) as slack from a, b""".replace("element_at(array(0, 1, 3, 7), b.i + 1)", "case b.i when 0 then 0 when 1 then 1 when 2 then 3 else 7 end"))
shared("tun2_marginal_grid", f"""with v as (select r_regionkey as i from {{region}}), lr as (select 'lr' as name, -5 + i * 1.25::double as v from v), mo as (select 'momentum' as name, i * 0.25::double as v from v)
  select name, {Q6('v')} as v from lr where v <> -2.5::double union all select name, {Q6('v')} from mo where v <> 0.5::double union all select 'base', 0.0::double""")
shared("tun8_hyperband", """with k as (select n_nationkey as k from {nation} where n_nationkey between 1 and 10), l as (select r_regionkey as l from {region} where r_regionkey < 4), s as (select n_nationkey as s from {nation})
  select k, l, s, pow(2, k + 1)::bigint as budget, pow(2, pow(2, l) + 1)::bigint as n, pow(2, pow(2, l) - s + 1)::bigint as alive,
   floor(floor(pow(2, k + 1) / pow(2, pow(2, l) - s + 1)) / pow(2, l))::bigint as rounds from k, l, s where k - pow(2, l) >= l and s <= pow(2, l)""")
shared("tun9_bandit_stop", """with e as (select o_custkey as branch, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as epoch, o_totalprice as acc from {orders}),
  p as (select branch, epoch, max(acc) over (partition by branch order by epoch) as peak from e), b as (select max(acc) as best from e)
  select branch, min(epoch) as stop from p, b where epoch >= 5 and peak < 0.5::double * best group by branch""")
shared("tun10_run_to_completion", """with e as (select o_custkey as branch, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as epoch, o_totalprice as acc from {orders})
  select branch, epoch, acc, max(acc) over (order by branch, epoch rows between unbounded preceding and current row) as best from e""")
shared("tun11_interleave", "with s as (select p_partkey as i from {part}) select i, floor((i % (5 * 4)) / 4)::bigint as branch from s")
shared("tun12_resume", """with e as (select o_custkey as branch, o_orderkey as clock, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from {orders})
  select branch, clock, before is not null and clock - before > 1000 as resumed from e""")
shared("tun13_clocks", f"select o_custkey as branch, least(floor(1000 / (avg(o_totalprice) / 1000))::bigint, 8) as clocks from {{orders}} group by o_custkey")
shared("tun14_make_tunable", f"""select c_custkey as trial, {Q6('pow(10.0::double, coalesce(case when c_acctbal > 0 then -c_acctbal / 3000 end, -3))')} as lr,
  coalesce(case when c_nationkey % 2 = 0 then c_nationkey end, 3) as slack from {{customer}}""")
shared("scl21_decode", f"select c_custkey, {Q6('pow(10.0::double, -c_acctbal / 3000)')} as log_value, c_acctbal as linear_value, case floor(abs(c_acctbal) / 3000 + 0.5::double)::bigint when 0 then 0 when 1 then 1 when 2 then 3 else 7 end as discrete_value from {{customer}}")
shared("scl22_clocks_per_epoch", "select p_partkey, floor(50000 / (p_size + 1))::bigint as clocks from {part}")
shared("scl20_lr_policies", f"""with i as (select p_partkey as i from {{part}}) select i, {Q6('0.01::double')} as fixed, {Q6('0.01::double * pow(0.1::double, floor(i / 500))')} as step,
  {Q6('0.01::double * pow(0.999::double, i)')} as exp, {Q6('0.01::double * pow(1 + 0.0001::double * i, -0.75::double)')} as inv,
  {Q6('0.01::double * pow(0.1::double, (i >= 300)::int + (i >= 900)::int)')} as multistep, {Q6('0.01::double * pow(1 - i / 1000000.0::double, 2)')} as poly,
  {Q6('0.01::double / (1 + exp(-0.01::double * (i - 500)))')} as sigmoid from i""")
shared("flt11_state_rules", "select n_name, n_regionkey in (1, 2) and n_nationkey >= 3 and not n_name like '%A' as included from {nation}")
shared("jn4_schedule", """with s as (select p_partkey as clock, p_partkey % 5 as branch, row_number() over (partition by p_partkey % 5 order by p_partkey) - 1 as internal from {part})
  select l_orderkey, l_linenumber, branch, internal from {lineitem} join s on clock = l_partkey""")
