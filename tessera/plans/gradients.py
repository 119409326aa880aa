"""Gradients of the losses and of the inner product, weights from a table, and the transposed convolution.

A gradient stays an array beside its instance, so a loss has no shuffle backwards; the gradient of the weights is one
aggregate by input position, partial sums first, whose result has as many rows as the layer has inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import elementwise as e
from tessera.plans.tensor import LONG, PAIRS, SCORES, batch, long, paired, scored, weight
from tessera.registry import Q6, q6, query

#: The label that the softmax loss leaves out.
IGNORED = 3


def sized(df):
    """The frame with its count of rows as ``size``."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("size"))))  # one row


def own(c):
    return (c == F.col("label")).cast("int")


def by_class(df, gradient, name="g"):
    return long(df.withColumn("v", gradient)).select("n", F.col("i").alias("c"), q6(F.col("x")).alias(name))


@query("los1_euclidean_bwd", f"""{PAIRS}, l as (select n, unnest(a) as x, unnest(b) as y, unnest(range(64))::int as i, (select count(*) from j) as m from j)
  select n, i, {Q6('(x - y) / m')} as g, {Q6('(y - x) / m')} as g_other from l""")
def _(t):
    df = sized(paired(t))
    return long(df.withColumn("d", F.zip_with("v", "w", lambda x, y: x - y)), "d", "size").select(
        "n", "i", q6(F.col("x") / F.col("size")).alias("g"), q6(-F.col("x") / F.col("size")).alias("g_other"))


@query("los2_softmax_loss_bwd", f"""{SCORES} select n, c, {Q6(f'case when label = {IGNORED} then 0.0 else (p - (c = label)::int) / greatest((select count(*) from b where label <> {IGNORED} and i = 0), 1) end')} as g from p""")
def _(t):
    """p less the label's indicator over the count of labels that are not left out; rows left out have no gradient."""
    df = scored(t)
    valid = df.where(F.col("label") != IGNORED).agg(F.greatest(F.count("*"), F.lit(1)).alias("size"))
    g = F.transform("p", lambda p, c: F.when(F.col("label") == IGNORED, 0.0).otherwise((p - own(c)) / F.col("size")))
    return by_class(df.crossJoin(F.broadcast(valid)), g)


@query("los3_sigmoid_cross_entropy_bwd", f"""{SCORES} select n, c, {Q6('(1 / (1 + exp(-s)) - (c = label)::int) / (select count(*) from b where i = 0)')} as g from s""")
def _(t):
    return by_class(sized(scored(t)), F.transform("s", lambda s, c: (e.sigmoid(s) - own(c)) / F.col("size")))


@query("los4_hinge_bwd", f"""{SCORES}, m as (select n, c, case when c = label then -1 else 1 end as y, s from s), d as (select n, c, y * greatest(0, 1 + y * s) as d from m)
  select n, c, {Q6('sign(d) / (select count(*) from b where i = 0)')} as l1, {Q6('2 * d / (select count(*) from b where i = 0)')} as l2 from d""")
def _(t):
    """The margins with the label's negated: their sign (L1) or their double (L2) over the count."""
    def margin(s, c):
        return F.when(c == F.col("label"), -F.greatest(F.lit(0.0), 1 - s)).otherwise(F.greatest(F.lit(0.0), 1 + s))

    return long(sized(scored(t)).withColumn("v", F.transform("s", margin)), "v", "size").select(
        "n", F.col("i").alias("c"), q6(F.signum("x") / F.col("size")).alias("l1"), q6(2 * F.col("x") / F.col("size")).alias("l2"))


@query("los5_infogain_bwd", f"""{SCORES} select n, c, {Q6('-(case when c = label then 1.0::double else 0.1::double end) / greatest(p, 1e-20::double) / (select count(*) from b where i = 0)')} as g from p""")
def _(t):
    return by_class(sized(scored(t)), F.transform("p", lambda p, c: -F.when(c == F.col("label"), 1.0).otherwise(0.1) / F.greatest(p, F.lit(1e-20)) / F.col("size")))


@query("los6_multinomial_bwd", f"""{SCORES} select n, c, {Q6('-(c = label)::int / greatest(p, 1e-20::double) / (select count(*) from b where i = 0)')} as g from p""")
def _(t):
    return by_class(sized(scored(t)), F.transform("p", lambda p, c: -own(c) / F.greatest(p, F.lit(1e-20)) / F.col("size")))


@query("los7_contrastive_bwd", f"""{PAIRS}, d as (select *, list_sum(list_transform(range(1, 65), lambda i: pow(a[i] - b[i], 2))) as d, (select count(*) from j) as m from j),
 f as (select *, case when same then 1.0 when sqrt(d) < 8 then -(8 - sqrt(d)) / (sqrt(d) + 1e-4) else 0.0 end as f,
  case when same then 1.0 when d < 64 then -1.0 else 0.0 end as lf from d),
 l as (select n, unnest(a) as x, unnest(b) as y, unnest(range(64))::int as i, f, lf, m from f)
 select n, i, {Q6('f * (x - y) / m')} as g, {Q6('lf * (x - y) / m')} as legacy from l""")
def _(t):
    """Margin 8 on distances, 64 on squares in the legacy form, so that pairs fall on both sides. The other input's gradient is the negative."""
    df = sized(paired(t)).withColumn("x_y", F.zip_with("v", "w", lambda x, y: x - y))
    d2 = e.dot(F.col("x_y"), F.col("x_y"))
    gap = 8 - F.sqrt("d2")
    same = F.col("label") == F.col("other")
    df = df.withColumn("d2", d2).withColumn("f", F.when(same, 1.0).when(gap > 0, -gap / (F.sqrt("d2") + 1e-4)).otherwise(0.0)).withColumn(
        "lf", F.when(same, 1.0).when(F.col("d2") < 64, -1.0).otherwise(0.0))
    return long(df, "x_y", "size", "f", "lf").select("n", "i", q6(F.col("f") * F.col("x") / F.col("size")).alias("g"),
                                                     q6(F.col("lf") * F.col("x") / F.col("size")).alias("legacy"))


@query("lin1_weight_table", """with l as (select vec_id as n, label as c, unnest(embedding)::double as x, unnest(range(64))::int as i from embeddings),
 w as (select c, i, avg(x) as w, count(*) / 1000.0::double as bias from l group by c, i)
 select l.n, w.c, """ + Q6("sum(x * w) + max(bias)") + """ as y from l join w on w.i = l.i group by l.n, w.c""")
def _(t):
    """y = W x + b with W and b from a table: a row for each output, here the mean instance of a label and its share. The
    table has as many rows as the layer has outputs, and so has each instance's result."""
    table = batch(t).groupBy(F.col("label").alias("c")).agg(F.array(*(F.avg(F.col("v")[i]) for i in range(64))).alias("w"),
                                                           (F.count("*") / F.lit(1000.0)).alias("bias"))
    return batch(t).crossJoin(table).select("n", "c", q6(e.dot(F.col("v"), F.col("w")) + F.col("bias")).alias("y"))


@query("lin1_weight_gradient", f"""{SCORES}, g as (select n, c, (p - (c = label)::int) / (select count(*) from b where i = 0) as g from p)
  select c, i, {Q6('sum(g * x)')} as dw from g join b on b.n = g.n group by c, i union all select c, -1, {Q6('sum(g)')} from g group by c""")
def _(t):
    """dW = sum of g xᵀ over the batch under the softmax loss, and the bias's gradient as position -1."""
    g = F.transform("p", lambda p, c: (p - own(c)) / F.col("size"))
    rows = sized(scored(t)).select(F.posexplode(F.concat("v", F.array(F.lit(1.0)))).alias("i", "x"), g.alias("g"))
    sums = rows.groupBy("i").agg(*(F.sum(F.col("x") * F.col("g")[c]).alias(f"d{c}") for c in range(10)))
    return sums.select(F.when(F.col("i") == 64, -1).otherwise(F.col("i")).alias("i"), F.posexplode(F.array(*(f"d{c}" for c in range(10)))).alias("c", "d")).select(
        "c", "i", q6(F.col("d")).alias("dw"))


@query("lin1_input_gradient", f"""{SCORES}, g as (select n, c, (p - (c = label)::int) / (select count(*) from b where i = 0) as g from p), i as (select unnest(range(64))::int as i)
  select n, i, {Q6('sum(g * (((c * 64 + i) % 7 - 3) / 10.0::double))')} as dx from g, i group by n, i""")
def _(t):
    g = F.transform("p", lambda p, c: (p - own(c)) / F.col("size"))
    df = sized(scored(t)).withColumn("g", g)
    at = F.sequence(F.lit(0), F.lit(63))
    dx = F.transform(at, lambda d: e.total(F.transform("g", lambda x, c: x * weight(c, d))))
    return long(df.withColumn("v", dx)).select("n", "i", q6(F.col("x")).alias("dx"))


def _taps(size: int, kernel: int, stride: int, pad: int) -> list[list[tuple[int, int]]]:
    """For each output cell of a transposed convolution the (input cell, kernel cell) that reach it."""
    side = (size - 1) * stride + kernel - 2 * pad
    taps: list[list[tuple[int, int]]] = [[] for _ in range(side * side)]
    for y in range(size):
        for x in range(size):
            for ky in range(kernel):
                for kx in range(kernel):
                    oy, ox = y * stride + ky - pad, x * stride + kx - pad
                    if 0 <= oy < side and 0 <= ox < side:
                        taps[oy * side + ox].append((y * size + x, ky * kernel + kx))
    return taps


@query("lin3_deconvolution", """with b as (select vec_id as n, unnest(embedding)::double as x, unnest(range(64))::int as i from embeddings), k as (select unnest(range(9))::int as k),
 o as (select n, x * (((i // 16) * 9 + k) % 5 - 2) / 4.0::double as v, ((i % 16) // 4) * 2 + k // 3 - 1 as oy, (i % 4) * 2 + k % 3 - 1 as ox from b, k)
 select n, (oy * 7 + ox)::int as i, """ + Q6("sum(v)") + " as y from o where oy between 0 and 6 and ox between 0 and 6 group by n, oy, ox")
def _(t):
    """4 channels of 4 x 4 to one of 7 x 7: kernel 3, stride 2, pad 1. Each output cell gathers its taps, without a shuffle."""
    taps = F.array(*(F.array(*(F.struct(F.lit(c * 16 + cell).alias("cell"), F.lit(((c * 9 + k) % 5 - 2) / 4.0).alias("w"))
                               for c in range(4) for cell, k in cells)) for cells in _taps(4, 3, 2, 1)))
    y = F.transform(taps, lambda cells: F.aggregate(cells, F.lit(0.0), lambda a, tap: a + F.get("v", tap["cell"]) * tap["w"]))
    return long(batch(t).withColumn("y", y), "y").select("n", "i", q6(F.col("x")).alias("y"))
