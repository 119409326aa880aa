"""Progress series, training-log analytics and sequence queries, as window functions over explicit orders.

A branch's series is a customer's orders in time: k counts them from 0, y is the progress, t a logical time."""

from __future__ import annotations

from tessera.registry import Q6, shared

S = """with s as (select o_custkey as branch, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as k,
  o_totalprice as y, o_orderkey as t, count(*) over (partition by o_custkey) as n from {orders}),
 d as (select *, y - lag(y) over (partition by branch order by k) as dy from s),
 e as (select branch, max(n) as n, max(case when k = 0 then y end) as y0, max(case when k = n - 1 then y end) as y1,
  greatest(0, max(dy)) as up, count(case when dy < 0 then 1 end) as downs, count(case when dy >= 0 then 1 end) as ups,
  min(dy) as lo, max(dy) as hi from d group by branch)"""
SLOPE = """case when y1 > 10 * y0 then 'DIVERGED' when up > abs(y1 - y0) * 0.5::double then 'UNSTABLE' else 'CONVERGING' end"""

shared("win1_downsample", f"{S} select branch, floor(k / 3)::bigint as block, {Q6('avg(y)')} as y from s group by branch, floor(k / 3) having count(*) = 3")
shared("win5_max_go_up", f"{S} select branch, {Q6('coalesce(up, 0)')} as up from e")
shared("win6_monotone", f"{S} select branch, case when n < 2 then true when y1 >= y0 then lo >= 0 else hi <= 0 end as monotone from e")
shared("win7_down_more_often", f"{S} select branch, downs > ups as down from e")
shared("win8_slope", f"{S} select branch, {Q6('(y1 - y0) / (n - 1)')} as slope from e where n > 1")
shared("win9_slope_penalty", f"""{S} select branch, {SLOPE} as state,
  case when y1 - y0 + up <= 0 then {Q6('(y1 - y0 + up) / (n - 1)')} end as slope from e where n > 1""")
shared("win10_summarize_progress", S.replace("from {orders})", "from {orders} where o_totalprice > 0)") + f""",
 r as (select branch, floor(k / greatest(floor(n / 4), 1)) as b, ln(avg(y)) / ln(10.0::double) as y, max(n) as n, count(*) as c, max(greatest(floor(n / 4), 1)) as rate
  from s group by branch, floor(k / greatest(floor(n / 4), 1))),
 r2 as (select branch, b, y from r where c = rate union all select distinct branch, -1, 6.0::double from r),
 r3 as (select *, y - lag(y) over (partition by branch order by b) as dy, row_number() over (partition by branch order by b) as i,
  count(*) over (partition by branch) as m from r2),
 e3 as (select branch, max(m) as n, max(case when i = 1 then y end) as y0, max(case when i = m then y end) as y1, greatest(0, max(dy)) as up from r3 group by branch)
 select branch, {SLOPE} as state, case when y1 - y0 + up <= 0 then {Q6('(y1 - y0 + up) / (n - 1)')} end as slope from e3 where n > 1""")
shared("win11_interception", f"""{S}, g as (select *, lag(y) over (partition by branch order by k) as py from s),
 x as (select g.branch, min(case when e.y1 <= e.y0 and g.y <= 120000 and g.py > 120000 or e.y1 > e.y0 and g.y >= 120000 and g.py < 120000 then g.k end) as k
  from g join e on g.branch = e.branch group by g.branch)
 select x.branch, {Q6('g.k - 1 + (g.py - 120000) / (g.py - g.y)')} as place from x join g on g.branch = x.branch and g.k = x.k""")
shared("win12_time_saving", f"""{S}, p as (select a.branch as old, b.branch as new, a.y1 as goal, a.n as n_old, b.y0, b.y1, b.n as n_new from e a join e b on b.branch = a.branch + 1 where a.n > 2 and b.n > 2),
 f as (select p.old, min(s.k) as k from p join s on s.branch = p.new and s.y <= p.goal group by p.old)
 select p.old, new, {Q6('(n_old - 1) / greatest(k, 1)::double - 1')} as saving from p join f on f.old = p.old""")
shared("win13_valid_progress", f"{S} select branch, y1 < y0 and up < 0.1::double * (y0 - y1) as valid from e where n > 1")
shared("win14_summarize_run", f"""{S}, c as (select branch, n, r from (select branch, n, explode_r as r from e, (select 1 as explode_r union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8) r) q where r * 3 <= n),
 b as (select c.branch, c.r, floor((s.k - (c.n - 3 * c.r)) / c.r) as b, avg(s.y) as y from c join s on s.branch = c.branch and s.k >= c.n - 3 * c.r group by c.branch, c.r, floor((s.k - (c.n - 3 * c.r)) / c.r)),
 v as (select branch, r, max(case when b = 0 then y end) as y0, max(case when b = 2 then y end) as y1,
  greatest(0, max(case when b = 1 then y end) - max(case when b = 0 then y end), max(case when b = 2 then y end) - max(case when b = 1 then y end)) as up from b group by branch, r)
 select branch, min(r) as rate from v where y1 < y0 and up < 0.1::double * (y0 - y1) group by branch""",
  whole=f"""{S}, c as (select branch, n, explode(sequence(1, cast(floor(n / 3) as int))) as r from e where n >= 3),
 b as (select c.branch, c.r, floor((s.k - (c.n - 3 * c.r)) / c.r) as b, avg(s.y) as y from c join s on s.branch = c.branch and s.k >= c.n - 3 * c.r group by c.branch, c.r, floor((s.k - (c.n - 3 * c.r)) / c.r)),
 v as (select branch, r, max(case when b = 0 then y end) as y0, max(case when b = 2 then y end) as y1,
  greatest(0, max(case when b = 1 then y end) - max(case when b = 0 then y end), max(case when b = 2 then y end) - max(case when b = 1 then y end)) as up from b group by branch, r)
 select branch, min(r) as rate from v where y1 < y0 and up < 0.1::double * (y0 - y1) group by branch""")
shared("win15_plateaued", f"""{S} select branch, count(*) >= 4 and coalesce(max(case when k < n - 3 then y end), 0) >= max(case when k >= n - 3 then y end) as plateaued from s group by branch""")
shared("win16_topk_close", f"""{S}, r as (select branch, y, row_number() over (partition by branch order by -y, k) as r from s)
  select branch, coalesce(1 - max(case when r = 3 then y end) / max(case when r = 1 then y end) < 0.1::double, false) as close from r group by branch""")
shared("win17_no_improvement", f"{S} select branch, count(*) > 3 and not coalesce(min(case when k >= n - 3 then -y end) < least(0, min(case when k < n - 3 then -y end)), false) as stale from s group by branch")
shared("win18_timeline", f"{S} select branch, k, t - first_value(t) over (partition by branch order by k) as since from s")
shared("win19_time_per_clock", f"{S} select branch, k, {Q6('(t - min(t) over w2) / k::double')} as per_clock from (select *, min(t) over (partition by branch) as t0 from s) x window w2 as (partition by branch order by k rows between unbounded preceding and current row) qualify k > 0".replace(" qualify k > 0", "").replace("/ k::double", "/ greatest(k, 1)::double"))
shared("win20_smoothed_loss", f"{S} select branch, k, {Q6('avg(y) over (partition by branch order by k rows between 4 preceding and current row)')} as loss from s")
E_ = """with e as (select *, row_number() over (order by ts, event_id) - 1 as line from {events}),
 r as (select *, sum(case when event_type = prev then 0 else 1 end) over (order by line)::bigint as run from (select *, lag(event_type) over (order by line) as prev from e) x),
 i as (select *, row_number() over (partition by run order by line) - 1 as k, count(*) over (partition by run) as n from r)"""
shared("win3_special_downsample", f"{E_} select run, floor(k / 2)::bigint as block, max(event_type) as branch, floor(sum(line) / 2)::bigint as clock, {Q6('avg(value)')} as y from i group by run, floor(k / 2) having count(*) = 2")
shared("win2_downsample_columns", f"{E_} select floor(line / 10)::bigint as block, {Q6('avg(value)')} as value, {Q6('avg(user_id)')} as user_id from e group by floor(line / 10) having count(*) = 10")
shared("win22_forward_fill", f"""{E_}, f as (select *, max(case when event_type <> 'purchase' then line end) over (order by line) as at from e)
  select f.line, f.value, {Q6('b.value')} as time from f join e b on b.line = f.at where f.event_type = 'purchase'""")
shared("win23_state_times", f"""{E_}, d as (select event_type, lead(line) over (order by line) - line as lines, value from r where event_type <> coalesce(prev, ''))
  select event_type as state, sum(lines)::bigint as lines, count(*) as runs, {Q6('max(value)')} as peak from d group by event_type""")
shared("win21_summarize_loss", f"""{E_}, w as (select *, case when (line * 37) % 86400 < 100 then (line * 37) % 86400 + 86400 else (line * 37) % 86400 end as t from e)
  select floor(line / 4)::bigint as block, {Q6('avg(t)')} as time, {Q6('avg(value)')} as loss from w group by floor(line / 4) having count(*) = 4""")
shared("flt9_filter_branch", "select event_id, value from {events} where event_type = 'click'")
shared("flt10_prune_log", "select event_id from {events} where not (event_type = 'view' and value > 50)")
shared("scl30_branch_columns", f"{E_} select user_id as branch, line as clock, {Q6('value')} as loss from e")
shared("scl31_completion", f"{E_} select user_id, max(case when k = 1 then value end) as last_value, max(case when k = 1 then line end) as line from (select *, row_number() over (partition by user_id order by line desc) as k from e) x group by user_id")
shared("win24_clips", """with f as (select conv_id, count(*) as n from {conversations} group by conv_id),
  c as (select conv_id, n, s from f, (select 0 as s union all select 2 union all select 4 union all select 6 union all select 8) q where s < n)
  select conv_id, s as start, greatest(least(s, n - 4), 0) as first, greatest(least(s, n - 4), 0) + 3 as last from c""",
  whole="""with f as (select conv_id, count(*) as n from {conversations} group by conv_id),
  c as (select conv_id, n, explode(sequence(0, cast(n - 1 as int), 2)) as s from f)
  select conv_id, s as start, greatest(least(s, n - 4), 0) as first, greatest(least(s, n - 4), 0) + 3 as last from c""")
shared("jn6_as_of", """with p as (select c_custkey as k, o.o_orderdate as d, o.o_orderkey as ok from {customer} join {orders} o on o.o_custkey = c_custkey)
  select a.ok, max(b.ok) as before from p a left join p b on a.k = b.k and b.d < a.d group by a.ok""",
  whole="""with p as (select c_custkey as k, o.o_orderdate as d, o.o_orderkey as ok from {customer} join {orders} o on o.o_custkey = c_custkey),
  g as (select k, d, max(ok) as m from p group by k, d),
  w as (select k, d, max(case when d is not null then m end) over (partition by k order by d rows between unbounded preceding and 1 preceding) as before from g)
  select p.ok, max(w.before) as before from p join w on p.k = w.k and p.d <=> w.d group by p.ok""")
shared("agg17_vote", f"""with p as (select o_custkey as video, o_orderpriority as class, avg(o_totalprice) as p from {{orders}} group by o_custkey, o_orderpriority),
  r as (select *, row_number() over (partition by video order by p desc, class desc) as r from p)
  select class, count(*) as videos, {Q6('avg(p)')} as p from r where r = 1 group by class""")
shared("agg18_late_fusion", f"""with a as (select o_custkey as v, o_orderpriority as c, avg(o_totalprice) as p from {{orders}} group by o_custkey, o_orderpriority),
  b as (select o_custkey as v, o_orderpriority as c, avg(o_orderkey) as p from {{orders}} group by o_custkey, o_orderpriority),
  f as (select a.v, a.c, 0.5::double * a.p + 0.5::double * b.p as p from a join b on a.v = b.v and a.c = b.c),
  r as (select *, row_number() over (partition by v order by p desc, c desc) as r from f) select v, c, {Q6('p')} as p from r where r = 1""")
shared("top1_top_k", "select o_custkey, o_orderkey, r from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as r from {orders}) x where r <= 3")
shared("top3_best_half", f"{S} select branch from (select branch, row_number() over (order by max(y), branch) as r, count(*) over () as n from s group by branch) x where r > floor(n / 2)")
shared("top4_best_branch", f"{S} select branch, {Q6('slope')} as slope from (select *, row_number() over (order by slope, branch) as r from (select branch, (y1 - y0) / (n - 1) as slope from e where n > 1 and y1 - y0 + up <= 0) x) y where r = 1")
shared("top5_top_classes", f"select o_orderpriority as class, {Q6('sum(o_totalprice)')} as score from {{orders}} group by o_orderpriority order by sum(o_totalprice) desc limit 5")
shared("top6_offset_limit", "select p_partkey, p_name from {part} order by p_partkey limit 50 offset 10")
shared("set3_duplicates", "select a.o_orderkey as dup, b.first from {orders} a join (select o_custkey, o_orderpriority, min(o_orderkey) as first from {orders} group by o_custkey, o_orderpriority) b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority where a.o_orderkey > b.first")
shared("set4_unique_keys", "select distinct l_linenumber as table_id, l_partkey as row_id from {lineitem}")
shared("set2_starting_point", f"{S} select branch, k, y from s union all select branch, -1, 500000.0::double from e")
shared("agg12_average_progress", f"{S} select branch, {Q6('avg(y)')} as y from s group by branch")
