"""Random layers, fillers, shuffles and searchers, from numbers that key and seed decide."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import elementwise as e
from tessera.operators.seeded import bernoulli, gaussian, gaussian_sql, uniform, uniform_sql
from tessera.plans.tensor import LONG, batch, long
from tessera.registry import Q6, q6, query

INPUTS, OUTPUTS = 64, 10
CELLS = INPUTS * OUTPUTS


@query("scl11_dropout", f"{LONG} select n, i, {Q6('case when ' + uniform_sql('n * 64 + i', 7) + ' < 0.4::double then 0.0 else x / 0.6::double end')} as train, {Q6('x')} as test from b")
def _(t):
    """Ratio 0.4: what stays is scaled by 1 / 0.6 in training; testing is the identity."""
    kept = e.each_at(F.col("v"), lambda x, i: F.when(bernoulli(F.col("n") * 64 + i, 7, 0.4) == 1, 0.0).otherwise(x / 0.6))
    return batch(t).select("n", F.posexplode(F.arrays_zip(kept.alias("train"), F.col("v").alias("test"))).alias("i", "p")).select(
        "n", "i", q6(F.col("p.train")).alias("train"), q6(F.col("p.test")).alias("test"))


@query("scl24_random", f"""select p_partkey, {Q6(uniform_sql('p_partkey', 11, -2.0, 3.0))} as uniform, {Q6(gaussian_sql('p_partkey', 21, 1.0, 0.5))} as gaussian,
  ({uniform_sql('p_partkey', 31)} < 0.3::double)::int as bernoulli from part""")
def _(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", q6(uniform(k, 11, -2.0, 3.0)).alias("uniform"), q6(gaussian(k, 21, 1.0, 0.5)).alias("gaussian"),
                            bernoulli(k, 31, 0.3).alias("bernoulli"))


def cells(t):
    """A weight table's cells, one row each."""
    return t("region").where("r_regionkey = 0").select(F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("i"))


FILLERS = {
    "filler_uniform": (lambda k: uniform(k, 41, -0.1, 0.2), uniform_sql("i", 41, -0.1, 0.2)),
    "filler_xavier": (lambda k: uniform(k, 43, -math.sqrt(3 / INPUTS), math.sqrt(3 / INPUTS)), uniform_sql("i", 43, -math.sqrt(3 / INPUTS), math.sqrt(3 / INPUTS))),
    "filler_msra": (lambda k: gaussian(k, 45, 0.0, math.sqrt(2 / INPUTS)), gaussian_sql("i", 45, 0.0, math.sqrt(2 / INPUTS))),
    # a sparse Gaussian keeps a cell with probability sparse / outputs
    "filler_gaussian": (lambda k: gaussian(k, 47, 0.0, 0.01) * bernoulli(k, 49, 3 / OUTPUTS), f"{gaussian_sql('i', 47, 0.0, 0.01)} * ({uniform_sql('i', 49)} < {3 / OUTPUTS}::double)::int"),
}
for _name, (_column, _sql) in FILLERS.items():
    query(_name, f"select i::int as i, {Q6(_sql)} as w from (select unnest(range({CELLS})) as i)")(lambda t, f=_column: cells(t).select("i", q6(f(F.col("i"))).alias("w")))


@query("filler_positive_unitball", f"""with u as (select i, {uniform_sql('i', 51)} as u from (select unnest(range({CELLS})) as i))
  select i::int as i, {Q6(f'u / sum(u) over (partition by i // {INPUTS})')} as w from u""")
def _(t):
    """Positive weights that sum to one for each output."""
    k = F.col("i")
    return cells(t).withColumn("u", uniform(k, 51)).select("i", q6(F.col("u") / F.sum("u").over(Window.partitionBy(F.floor(k / INPUTS)))).alias("w"))


@query("top7_shuffle", f"""select p_partkey, p_partkey % 8 as shard, row_number() over (partition by p_partkey % 8 order by {uniform_sql('p_partkey', 61)}, p_partkey) - 1 as place from part""")
def _(t):
    """Every shard's keys in the order that the seed gives."""
    shard = (F.col("p_partkey") % 8).alias("shard")
    place = F.row_number().over(Window.partitionBy(shard).orderBy(uniform(F.col("p_partkey"), 61), "p_partkey")) - 1
    return t("part").select("p_partkey", shard, place.cast("long").alias("place"))


@query("tun3_random_search", f"""select c_custkey as point, {Q6('pow(10.0::double, ' + uniform_sql('c_custkey', 71, -5.0, 0.0) + ')')} as lr, {Q6(uniform_sql('c_custkey', 73))} as momentum,
  ([0, 1, 3, 7])[1 + floor({uniform_sql('c_custkey', 75)} * 4)::int] as slack from customer""")
def _(t):
    """Independent draws for each point: log, linear and discrete tunables. A point needs only its number, so the search never ends."""
    k = F.col("c_custkey")
    return t("customer").select(k.alias("point"), q6(F.pow(F.lit(10.0), uniform(k, 71, -5.0, 0.0))).alias("lr"), q6(uniform(k, 73)).alias("momentum"),
                                F.get(F.array(*map(F.lit, (0, 1, 3, 7))), F.floor(uniform(k, 75) * 4).cast("int")).alias("slack"))


@query("tun5_marginal_random", f"""with u as (select c_custkey as point, c_custkey % 2 as turn, {uniform_sql('c_custkey', 81)} as u from customer)
  select point, {Q6('case when turn = 0 then pow(10.0::double, -5 + 5 * u) else 0.01::double end')} as lr, {Q6('case when turn = 1 then u else 0.9::double end')} as momentum from u""")
def _(t):
    """One tunable at a time is drawn, the others stay at the base point (0.01, 0.9)."""
    u, turn = uniform(F.col("c_custkey"), 81), F.col("c_custkey") % 2
    return t("customer").select(F.col("c_custkey").alias("point"), q6(F.when(turn == 0, F.pow(F.lit(10.0), -5 + 5 * u)).otherwise(0.01)).alias("lr"),
                                q6(F.when(turn == 1, u).otherwise(0.9)).alias("momentum"))
