"""Keyed datasets, cursors, partitioners and log parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.registry import Q6, query, shared


def padded(number: Column, width: int) -> Column:
    """A number with zeros before it up to a width; a longer one stays whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


shared("src1_batches", "select p_partkey, floor((row_number() over (order by p_partkey) - 1) / 32)::bigint as batch from {part}")
shared("src2_keylist", "with k as (select l_partkey as k, l_orderkey as pos from {lineitem} where l_linenumber = 2) select pos, p_name, p_retailprice from k join {part} on p_partkey = k")
shared("src3_seek", "select p_partkey, p_name from {part} where p_partkey >= 100 order by p_partkey limit 200",
  whole="select p_partkey, p_name from {part} where p_partkey >= 100 order by p_partkey")
shared("src8_memory_pages", "select p_partkey, floor(p_partkey / 16)::bigint % 8 as page, p_partkey % 16 as slot from {part}")
shared("src9_dummy", f"select n_nationkey as n, {Q6('1.5::double')} as constant, {Q6('n_nationkey / 25.0::double')} as ramp from {{nation}}")
shared("src13_partition", "select p_partkey, p_partkey % 4 as part, lpad(cast(p_partkey as varchar(20)), 5, '0') as k from {part} where p_partkey < 100000",
  whole="select p_partkey, p_partkey % 4 as part, lpad(cast(p_partkey as string), greatest(5, length(cast(p_partkey as string))), '0') as k from {part}")
shared("src14_round_robin", "select event_id, (row_number() over (order by ts, event_id) - 1) % 3 as part from {events}")
shared("src7_windows", """with b as (select l_orderkey, l_linenumber, l_discount * 10 as overlap from {lineitem})
  select l_orderkey, l_linenumber, case when overlap >= 0.5::double then 'fg' when overlap < 0.2::double then 'bg' else 'none' end as class from b""")


@query("src12_image_list", "select lpad((row_number() over (order by p_partkey) - 1)::varchar, 8, '0') || '_' || p_name as k, p_size as label from part")
def _(t):
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.orderBy("p_partkey")) - 1
    return t("part").select(F.concat(padded(nth, 8), F.lit("_"), "p_name").alias("k"), F.col("p_size").alias("label"))


@query("src15_features", f"select lpad(vec_id::varchar, 10, '0') as k, len(embedding) as n, {Q6('list_sum(embedding::double[])')} as total from embeddings")
def _(t):
    from tessera.operators.elementwise import reduce
    from tessera.registry import q6

    return t("embeddings").select(padded(F.col("vec_id"), 10).alias("k"), F.size("embedding").cast("long").alias("n"),
                                  q6(reduce(F.col("embedding"))).alias("total"))


@query("src20_datum", "select vec_id, i, least(greatest(floor(x * 100 + 128), 0), 255)::bigint as byte from (select vec_id, unnest(embedding)::double as x, unnest(range(64))::int as i from embeddings)")
def _(t):
    byte = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 100 + 128), F.lit(0)), F.lit(255)).cast("long"))
    return t("embeddings").select("vec_id", F.posexplode(byte).alias("i", "byte"))


@query("src16_sequences", """with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as p from conversations)
  select conv_id, turn, (p % 4 <> 0)::int as marker, (floor(p / 4) * 4 + p % 4)::bigint as place from c""")
def _(t):
    from pyspark.sql.window import Window

    p = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t("conversations").select("conv_id", "turn", (p % 4 != 0).cast("int").alias("marker"), p.cast("long").alias("place"))


@query("scl29_parse_log", """with l as (select event_id, 'Iteration ' || event_id || ', loss = ' || (user_id * 0.5) || ' worker' || (user_id % 4) as line from events)
  select event_id, regexp_extract(line, 'Iteration (\\d+)', 1)::bigint as iteration, regexp_extract(line, 'loss = ([\\d.]+)', 1)::double as loss, regexp_extract(line, 'worker(\\d+)', 1)::int as worker from l""")
def _(t):
    line = F.concat(F.lit("Iteration "), F.col("event_id").cast("string"), F.lit(", loss = "), (F.col("user_id") * F.lit(0.5)).cast("string"),
                    F.lit(" worker"), (F.col("user_id") % 4).cast("string"))
    got = lambda p: F.regexp_extract("line", p, 1)
    return t("events").select("event_id", line.alias("line")).select(
        "event_id", got("Iteration (\\d+)").cast("long").alias("iteration"), got("loss = ([\\d.]+)").cast("double").alias("loss"),
        got("worker(\\d+)").cast("int").alias("worker"))


@query("scl32_templates", "select n_name, part::int as part, replace('solver_@.txt', '@', part::varchar) as file from nation, (select unnest(range(4)) as part)")
def _(t):
    return t("nation").select("n_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part")).select(
        "n_name", "part", F.replace(F.lit("solver_@.txt"), F.lit("@"), F.col("part").cast("string")).alias("file"))


@query("filler_bilinear", f"select i::int as i, {Q6('(1 - abs((i % 4) / 2.0 - 0.75)) * (1 - abs(floor(i / 4) / 2.0 - 0.75))')} as w from (select unnest(range(16)) as i)")
def _(t):
    from tessera.registry import q6

    i = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")
    w = (1 - F.abs(F.col("i") % 4 / F.lit(2.0) - 0.75)) * (1 - F.abs(F.floor(F.col("i") / 4) / F.lit(2.0) - 0.75))
    return t("region").where("r_regionkey = 0").select(i).select("i", q6(w).alias("w"))
