"""Recurrences over ordered steps: one shuffle by stream, then a fold inside the JVM."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import ORACLES, Q6, QUERIES, q6

#: One LSTM cell with set weights; a step with cont = 0 forgets what was before.
LSTM = """aggregate(xs, named_struct('h', 0D, 'c', 0D), (s, e) -> transform(array(named_struct(
    'i', 1 / (1 + exp(-(0.5D * e.x + 0.1D * e.cont * s.h))), 'f', e.cont * 1 / (1 + exp(-(0.3D * e.x + 0.2D * e.cont * s.h + 1))),
    'o', 1 / (1 + exp(-(0.4D * e.x - 0.1D * e.cont * s.h))), 'g', tanh(0.7D * e.x + 0.3D * e.cont * s.h))),
  k -> named_struct('h', k.o * tanh(k.f * s.c + k.i * k.g), 'c', k.f * s.c + k.i * k.g))[0])"""
RNN = "aggregate(xs, 0D, (h, e) -> tanh(0.6D * e.x + 0.4D * e.cont * h))"


def _streams(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.struct(
        "ts", "event_id", (F.col("value") / 100).alias("x"), F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("cont")).alias("e"))
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("xs"))


QUERIES["win26_lstm"] = lambda spark, d: _streams(spark, d).select("user_id", F.expr(LSTM).alias("s")).select(
    "user_id", q6(F.col("s.h")).alias("h"), q6(F.col("s.c")).alias("c"))
_STEPS = """with recursive e as (select user_id, value / 100 as x, (event_type <> 'purchase')::int as cont,
   row_number() over (partition by user_id order by ts, event_id) as k from events),"""
ORACLES["win26_lstm"] = f"""{_STEPS}
 f as (select distinct user_id, 0::bigint as k, 0::double as h, 0::double as c from e union all
  select q.user_id, q.k, o * tanh(fg * c + i * g), fg * c + i * g from (select f.user_id, e.k, f.c,
   1 / (1 + exp(-(0.5 * x + 0.1 * cont * h))) as i, cont / (1 + exp(-(0.3 * x + 0.2 * cont * h + 1))) as fg,
   1 / (1 + exp(-(0.4 * x - 0.1 * cont * h))) as o, tanh(0.7 * x + 0.3 * cont * h) as g from f join e on e.user_id = f.user_id and e.k = f.k + 1) q)
 select user_id, {Q6('arg_max(h, k)')} as h, {Q6('arg_max(c, k)')} as c from f group by user_id"""
QUERIES["win26_rnn"] = lambda spark, d: _streams(spark, d).select("user_id", q6(F.expr(RNN)).alias("h"))
ORACLES["win26_rnn"] = f"""{_STEPS} f as (select distinct user_id, 0::bigint as k, 0::double as h from e union all
  select f.user_id, e.k, tanh(0.6 * x + 0.4 * cont * h) from f join e on e.user_id = f.user_id and e.k = f.k + 1)
 select user_id, {Q6('arg_max(h, k)')} as h from f group by user_id"""

#: Time-based down-sampling: a point is emitted when more than the interval has passed since the group's first one, which
#: the emission then opens anew at the next row.
TIMED = """aggregate(xs, named_struct('start', cast(null as double), 'n', 0L, 'sum', 0D, 'out', cast(array() as array<struct<t:double,y:double>>)),
  (s, e) -> case when s.start is null then named_struct('start', e.t, 'n', 1L, 'sum', e.y, 'out', s.out)
    when e.t - s.start > 1500 then named_struct('start', cast(null as double), 'n', 0L, 'sum', 0D,
      'out', concat(s.out, array(named_struct('t', e.t, 'y', (s.sum + e.y) / (s.n + 1)))))
    else named_struct('start', s.start, 'n', s.n + 1, 'sum', s.sum + e.y, 'out', s.out) end, s -> s.out)"""


def _timed(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.struct(
        F.col("o_orderkey").cast("double").alias("t"), F.col("o_totalprice").alias("y")).alias("e"))
    rows = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("e")).alias("xs"))
    return rows.select(F.col("o_custkey").alias("branch"), F.explode(F.expr(TIMED)).alias("p")).select(
        "branch", F.col("p.t").cast("long").alias("t"), q6(F.col("p.y")).alias("y"))


QUERIES["win4_time_downsample"] = _timed
ORACLES["win4_time_downsample"] = f"""with recursive e as (select o_custkey as b, o_orderkey as t, o_totalprice as y,
   row_number() over (partition by o_custkey order by o_orderkey, o_totalprice) as k from orders),
 f as (select distinct b, 0::bigint as k, null::bigint as s, 0::bigint as n, 0::double as sum, null::bigint as t, null::double as y from e union all
  select f.b, e.k, case when f.s is null then e.t when e.t - f.s > 1500 then null else f.s end,
   case when f.s is null then 1 when e.t - f.s > 1500 then 0 else f.n + 1 end, case when f.s is null then e.y when e.t - f.s > 1500 then 0 else f.sum + e.y end,
   case when f.s is not null and e.t - f.s > 1500 then e.t end, case when f.s is not null and e.t - f.s > 1500 then (f.sum + e.y) / (f.n + 1) end
  from f join e on e.b = f.b and e.k = f.k + 1)
 select b as branch, t, {Q6('y')} as y from f where t is not null"""
