"""Tensor queries: the embeddings are a batch of instances, of 64 values or of 4 channels of 4 x 4."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import elementwise as e
from tessera.registry import Q6, q6, query

#: The long form of the batch in SQL: n, i (from 0), x.
LONG = """with b as (select vec_id as n, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as i, label
  from embeddings)"""


def batch(t):
    return t("embeddings").select(F.col("vec_id").alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def long(df, v="v", *keep):
    return df.select("n", *keep, F.posexplode(v).alias("i", "x"))


def weight(c, d):
    return ((c * 64 + d) % 7 - 3) / F.lit(10.0)


EACH = {
    "scl1_absval": (lambda x, i: F.abs(x), "abs(x)"),
    "scl2_relu": (lambda x, i: e.relu(x, 0.1), "greatest(x, 0.0::double) + 0.1::double * least(x, 0.0::double)"),
    "scl3_prelu": (lambda x, i: F.greatest(x, F.lit(0.0)) + (i % 5) * F.lit(0.01) * F.least(x, F.lit(0.0)),
                   "greatest(x, 0.0::double) + (i % 5) * 0.01::double * least(x, 0.0::double)"),
    "scl4_elu": (lambda x, i: e.elu(x), "greatest(x, 0.0::double) + (exp(least(x, 0.0::double)) - 1)"),
    "scl5_sigmoid": (lambda x, i: e.sigmoid(x), "1 / (1 + exp(-x))"),
    "scl6_tanh": (lambda x, i: F.tanh(x), "tanh(x)"),
    "scl7_bnll": (lambda x, i: e.bnll(x), "case when x > 0 then x + ln(1 + exp(-x)) else ln(1 + exp(x)) end"),
    "scl8_power": (lambda x, i: e.power(x, 2.0, 0.5, 1.0), "pow(0.5::double * x + 1, 2)"),
    "scl9_exp": (lambda x, i: e.exp(x, -1.0, 0.5, 0.1), "exp(0.5::double * x + 0.1::double)"),
    "scl10_log": (lambda x, i: e.log(x, 2.0, 0.5, 3.0), "ln(0.5::double * x + 3) / ln(2.0::double)"),
    "scl14_bias": (lambda x, i: x + i / F.lit(64.0), "x + i / 64.0::double"),
    "scl15_scale": (lambda x, i: x * (i % 3 + 1), "x * (i % 3 + 1)"),
    "flt2_threshold": (lambda x, i: e.threshold(x, 0.1), "case when x > 0.1::double then 1.0 else 0.0 end"),
    "scl1_absval_bwd": (lambda x, i: F.signum(x) * 0.5, "sign(x) * 0.5::double"),
    "scl5_sigmoid_bwd": (lambda x, i: e.sigmoid(x) * (1 - e.sigmoid(x)), "(1 / (1 + exp(-x))) * (1 - 1 / (1 + exp(-x)))"),
    "scl6_tanh_bwd": (lambda x, i: 1 - F.tanh(x) * F.tanh(x), "1 - tanh(x) * tanh(x)"),
}
for _name, (_f, _sql) in EACH.items():
    query(_name, f"{LONG} select n, i, {Q6(_sql)} as y from b")(
        lambda t, f=_f: long(batch(t).withColumn("v", e.each_at(F.col("v"), f))).select("n", "i", q6(F.col("x")).alias("y")))


@query("agg1_reduction", f"""{LONG} select n, {Q6('sum(x)')} as s, {Q6('2 * sum(abs(x))')} as asum, {Q6('sum(x * x)')} as sumsq,
  {Q6('avg(x)')} as mean from b group by n""")
def _(t):
    v = F.col("v")
    return batch(t).select("n", q6(e.reduce(v)).alias("s"), q6(e.reduce(v, "ASUM", 2.0)).alias("asum"),
                           q6(e.reduce(v, "SUMSQ")).alias("sumsq"), q6(e.reduce(v, "MEAN")).alias("mean"))


@query("agg3_argmax", f"""{LONG} select n, r - 1 as k, i, {Q6('x')} as x from (
  select *, row_number() over (partition by n order by x desc, i desc) as r from b) where r <= 5""")
def _(t):
    return batch(t).select("n", F.posexplode(e.top_k(F.col("v"), 5)).alias("k", "p")).select(
        "n", F.col("k").cast("long").alias("k"), F.col("p.index").alias("i"), q6(F.col("p.value")).alias("x"))


@query("agg5_mvn", f"""{LONG} select n, i, {Q6('(x - avg(x) over w) / (sqrt(avg(x * x) over w - pow(avg(x) over w, 2)) + 1e-9)')} as y
  from b window w as (partition by n)""")
def _(t):
    return long(batch(t).withColumn("v", e.mean_variance(F.col("v")))).select("n", "i", q6(F.col("x")).alias("y"))


@query("agg4_batch_norm", f"""{LONG} select n, i, {Q6('(x - avg(x) over w) / sqrt(var_pop(x) over w + 1e-5)')} as y
  from b window w as (partition by i // 16)""")
def _(t):
    rows = long(batch(t)).withColumn("c", F.floor(F.col("i") / 16))
    stats = rows.groupBy("c").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))  # one row a channel
    return rows.join(F.broadcast(stats), "c").select("n", "i", q6((F.col("x") - F.col("m")) / F.sqrt(F.col("s") + 1e-5)).alias("y"))


@query("agg8_lrn", f"""{LONG} select n, i, {Q6('x / pow(1 + 0.1::double / 5 * sum(x * x) over (partition by n, i % 16 order by i // 16 rows between 2 preceding and 2 following), 0.75)')} as y from b""")
def _(t):
    near = Window.partitionBy("n", F.col("i") % 16).orderBy(F.floor(F.col("i") / 16)).rowsBetween(-2, 2)
    return long(batch(t)).select("n", "i", q6(F.col("x") / F.pow(
        1 + F.lit(0.1) / 5 * F.sum(F.col("x") * F.col("x")).over(near), F.lit(0.75))).alias("y"))


@query("agg15_norms", f"{LONG} select {Q6('sum(abs(x))')} as asum, {Q6('sum(x * x)')} as sumsq, {Q6('sqrt(sum(x * x))')} as l2, count(*) as n from b")
def _(t):
    one = batch(t).select(e.reduce(F.col("v"), "ASUM").alias("a"), e.reduce(F.col("v"), "SUMSQ").alias("s"), F.size("v").alias("k"))
    return one.agg(q6(F.sum("a")).alias("asum"), q6(F.sum("s")).alias("sumsq"), q6(F.sqrt(F.sum("s"))).alias("l2"),
                   F.sum("k").cast("long").alias("n"))


@query("agg9_dataset_mean", f"{LONG} select i, {Q6('avg(x)')} as pixel_mean, {Q6('avg(avg(x)) over (partition by i // 16)')} as channel_mean from b group by i")
def _(t):
    own = long(batch(t)).groupBy("i").agg(F.avg("x").alias("m"))
    return own.select("i", q6(F.col("m")).alias("pixel_mean"),
                      q6(F.avg("m").over(Window.partitionBy(F.floor(F.col("i") / 16)))).alias("channel_mean"))


@query("agg10_merged_means", f"""{LONG}, p as (select n % 4 as part, i, avg(x) as m from b group by n % 4, i)
  select i, {Q6('avg(m)')} as mean from p group by i""")
def _(t):
    return long(batch(t)).groupBy((F.col("n") % 4).alias("part"), "i").agg(F.avg("x").alias("m")).groupBy("i").agg(
        q6(F.avg("m")).alias("mean"))


def pooled(t, kernel=3, stride=2, pad=0):
    """MAX with its first position and AVE of windows over each 4 x 4 channel."""
    picks = []
    for c in range(4):
        for oy, ox, y0, y1, x0, x1, area in e.cells(4, 4, kernel, stride, pad):
            at = [c * 16 + y * 4 + x for y in range(y0, y1) for x in range(x0, x1)]
            own = F.array(*(F.struct(F.col("v")[i].alias("x"), F.lit(-i).alias("j")) for i in at))
            picks.append(F.struct(F.lit(c).alias("c"), F.lit(oy).alias("oy"), F.lit(ox).alias("ox"),
                                  F.array_max(own).alias("top"), (e.total(F.array(*(F.col("v")[i] for i in at))) / area).alias("ave")))
    rows = batch(t).select("n", F.explode(F.array(*picks)).alias("p"))
    return rows.select("n", "p.c", "p.oy", "p.ox", q6(F.col("p.top.x")).alias("max"), (-F.col("p.top.j")).alias("mask"),
                       q6(F.col("p.ave")).alias("ave"))


POOL_SQL = f"""{LONG}, o as (select unnest(range({{n}})) as o),
 g as (select n, i, x, i // 16 as c, (i % 16) // 4 as y, i % 4 as xx from b),
 w as (select g.*, a.o as oy, d.o as ox from g, o a, o d
       where y >= a.o * {{s}} - {{p}} and y < a.o * {{s}} - {{p}} + {{k}} and xx >= d.o * {{s}} - {{p}} and xx < d.o * {{s}} - {{p}} + {{k}})
 select n, c::int as c, oy::int as oy, ox::int as ox, {Q6('max(x)')} as max, arg_min(i, (-x, i))::int as mask,
  {Q6('sum(x) / ((least(any_value(oy) * {s} - {p} + {k}, 4 + {p}) - (any_value(oy) * {s} - {p})) * (least(any_value(ox) * {s} - {p} + {k}, 4 + {p}) - (any_value(ox) * {s} - {p})))')} as ave
 from w group by n, c, oy, ox"""


def _pool_sql(n, k, s, p):
    return POOL_SQL.replace("{n}", str(n)).replace("{k}", str(k)).replace("{s}", str(s)).replace("{p}", str(p))


query("agg6_pooling", _pool_sql(2, 3, 2, 0).replace("arg_min(i, (-x, i))", "min(i) filter (x = mx)").replace(
    "select g.*, a.o", "select g.*, max(x) over (partition by n, c, a.o, d.o) as mx, a.o"))(lambda t: pooled(t, 3, 2, 0))
query("agg6_pooling_padded", _pool_sql(3, 3, 2, 1).replace("arg_min(i, (-x, i))", "min(i) filter (x = mx)").replace(
    "select g.*, a.o", "select g.*, max(x) over (partition by n, c, a.o, d.o) as mx, a.o"))(lambda t: pooled(t, 3, 2, 1))


@query("agg7_spp", f"""{LONG}, p as (
  select n, 0 as l, (i // 16)::int as c, 0 as bin, max(x) as m from b group by n, i // 16
  union all select n, 1, (i // 16)::int, (((i % 16) // 8) * 2 + (i % 4) // 2)::int, max(x) from b group by n, i // 16, ((i % 16) // 8) * 2 + (i % 4) // 2)
  select n, (row_number() over (partition by n order by l, c, bin) - 1)::int as k, {Q6('m')} as y from p""")
def _(t):
    v = F.col("v")
    whole = [F.array_max(F.slice(v, c * 16 + 1, 16)) for c in range(4)]
    parts = [F.greatest(*(v[c * 16 + (by * 2 + y) * 4 + bx * 2 + x] for y in (0, 1) for x in (0, 1)))
             for c in range(4) for by in (0, 1) for bx in (0, 1)]
    return long(batch(t).withColumn("v", F.array(*whole, *parts))).select("n", F.col("i").alias("k"), q6(F.col("x")).alias("y"))


@query("win25_im2col", f"""{LONG}, k as (select unnest(range(9)) as k), o as (select unnest(range(16)) as o),
  q as (select n, c, k, o, o // 4 + k // 3 - 1 as y, o % 4 + k % 3 - 1 as xx from (select distinct n from b), (select unnest(range(4)) as c), k, o)
  select q.n, (c * 9 + k)::int as row, o::int as col, {Q6('coalesce(x, 0)')} as y
  from q left join b on b.n = q.n and y between 0 and 3 and xx between 0 and 3 and b.i = c * 16 + y * 4 + xx""")
def _(t):
    v, rows = F.col("v"), []
    for c in range(4):
        for k in range(9):
            line = [(o // 4 + k // 3 - 1, o % 4 + k % 3 - 1) for o in range(16)]
            rows.append(F.array(*(v[c * 16 + y * 4 + x] if 0 <= y < 4 and 0 <= x < 4 else F.lit(0.0) for y, x in line)))
    return batch(t).select("n", F.posexplode(F.array(*rows)).alias("row", "line")).select(
        "n", "row", F.posexplode("line").alias("col", "x")).select("n", "row", "col", q6(F.col("x")).alias("y"))


@query("lin2_convolution", f"""{LONG}, k as (select unnest(range(9)) as k), o as (select unnest(range(16)) as o),
  q as (select o, f, c, k, o // 4 + k // 3 - 1 as y, o % 4 + k % 3 - 1 as xx from o, (select unnest(range(2)) as f), (select unnest(range(4)) as c), k)
  select n, f::int as f, o::int as o, {Q6('sum(x * (((f * 36 + c * 9 + k) % 7 - 3) / 10.0::double))')} as y
  from q join b on y between 0 and 3 and xx between 0 and 3 and b.i = c * 16 + y * 4 + xx group by n, f, o""")
def _(t):
    v, out = F.col("v"), []
    for f in range(2):
        for o in range(16):
            terms = [v[c * 16 + (o // 4 + k // 3 - 1) * 4 + o % 4 + k % 3 - 1] * (((f * 36 + c * 9 + k) % 7 - 3) / 10)
                     for c in range(4) for k in range(9) if 0 <= o // 4 + k // 3 - 1 < 4 and 0 <= o % 4 + k % 3 - 1 < 4]
            out.append(F.struct(F.lit(f).alias("f"), F.lit(o).alias("o"), e.total(F.array(*terms)).alias("y")))
    return batch(t).select("n", F.explode(F.array(*out)).alias("p")).select("n", "p.f", "p.o", q6(F.col("p.y")).alias("y"))


@query("lin1_inner_product", f"""{LONG}, w as (select unnest(range(10))::int as c)
  select n, c, {Q6('sum(x * (((c * 64 + i) % 7 - 3) / 10.0::double))')} as y from b, w group by n, c""")
def _(t):
    return long(batch(t).withColumn("v", F.array(*(e.total(e.each_at(F.col("v"), lambda x, i, c=c: x * weight(F.lit(c), i))) for c in range(10)))
                                    )).select("n", F.col("i").alias("c"), q6(F.col("x")).alias("y"))


SCORES = LONG + """, s as (select n, label, c, sum(x * (((c * 64 + i) % 7 - 3) / 10.0::double)) as s
  from b, (select unnest(range(10))::int as c) group by n, label, c),
 p as (select *, exp(s - max(s) over (partition by n)) / sum(exp(s - mx)) over (partition by n) as p,
  row_number() over (partition by n order by s desc, c desc) as r from (select *, max(s) over (partition by n) as mx from s))"""


def scored(t):
    s = F.array(*(e.total(e.each_at(F.col("v"), lambda x, i, c=c: x * weight(F.lit(c), i))) for c in range(10)))
    df = batch(t).withColumn("s", s)
    return df.withColumn("p", e.softmax(F.col("s"))).withColumn("top", F.transform(e.top_k(F.col("s"), 5), lambda x: x["index"]))


@query("scl12_softmax", f"{SCORES} select n, c, {Q6('p')} as p from p")
def _(t):
    return long(scored(t), "p").select("n", F.col("i").alias("c"), q6(F.col("x")).alias("p"))


@query("los2_softmax_loss", f"{SCORES} select {Q6('avg(-ln(greatest(p, 1.17549435e-38)))')} as loss, count(*) as n from p where c = label")
def _(t):
    return scored(t).agg(q6(F.avg(-F.log(F.greatest(F.col("p")[F.col("label")], F.lit(1.17549435e-38))))).alias("loss"),
                         F.count("*").alias("n"))


@query("agg2_accuracy", f"""{SCORES} select coalesce(label, -1) as class, {Q6('avg((r = 1)::int)')} as top1, {Q6('avg((r <= 5)::int)')} as top5, count(*) as n
  from p where c = label group by grouping sets ((label), ())""")
def _(t):
    hit = lambda k: F.avg(F.array_contains(F.slice("top", 1, k), F.col("label")).cast("int"))
    return scored(t).cube("label").agg(q6(hit(1)).alias("top1"), q6(hit(5)).alias("top5"), F.count("*").alias("n")).select(
        F.coalesce("label", F.lit(-1)).alias("class"), "top1", "top5", "n")


@query("los4_hinge", f"""{SCORES} select {Q6('sum(greatest(0, 1 + case when c = label then -s else s end)) / count(distinct n)')} as l1,
  {Q6('sum(pow(greatest(0, 1 + case when c = label then -s else s end), 2)) / count(distinct n)')} as l2 from s""")
def _(t):
    m = F.transform("s", lambda s, c: F.greatest(F.lit(0.0), 1 + F.when(c == F.col("label"), -s).otherwise(s)))
    return scored(t).select(m.alias("m")).agg(q6(F.sum(e.total(F.col("m"))) / F.count("*")).alias("l1"),
                                              q6(F.sum(e.dot(F.col("m"), F.col("m"))) / F.count("*")).alias("l2"))


@query("los5_infogain", f"""{SCORES} select {Q6('sum(-ln(greatest(p, 1e-20)) * case when c = label then 1.0 else 0.1 end) / count(distinct n)')} as loss from p""")
def _(t):
    own = F.transform("p", lambda p, c: -F.log(F.greatest(p, F.lit(1e-20))) * F.when(c == F.col("label"), 1.0).otherwise(0.1))
    return scored(t).agg(q6(F.sum(e.total(own)) / F.count("*")).alias("loss"))


@query("los6_multinomial", f"{SCORES} select {Q6('avg(-ln(greatest(p, 1e-20)))')} as loss from p where c = label")
def _(t):
    return scored(t).agg(q6(F.avg(-F.log(F.greatest(F.col("p")[F.col("label")], F.lit(1e-20))))).alias("loss"))


@query("los3_sigmoid_cross_entropy", f"""{SCORES} select {Q6('-sum(s * ((c = label)::int - (s >= 0)::int) - ln(1 + exp(s - 2 * s * (s >= 0)::int))) / count(distinct n)')} as loss from s""")
def _(t):
    one = F.transform("s", lambda s, c: s * ((c == F.col("label")).cast("int") - (s >= 0).cast("int"))
                      - F.log1p(F.exp(s - 2 * s * (s >= 0).cast("int"))))
    return scored(t).agg(q6(-F.sum(e.total(one)) / F.count("*")).alias("loss"))


PAIRS = """with e as (select vec_id as n, embedding::double[] as v, label from embeddings),
 j as (select a.n, a.v as a, b.v as b, a.label = b.label as same from e a join e b on b.n = a.n + 1)"""


def paired(t):
    """Each instance with the next one, by id."""
    a = batch(t)
    b = a.select((F.col("n") - 1).alias("n"), F.col("v").alias("w"), F.col("label").alias("other"))
    return a.join(b, "n")


@query("los1_euclidean", f"""{PAIRS} select {Q6('sum(list_sum(list_transform(range(1, 65), lambda i: pow(a[i] - b[i], 2)))) / (2 * count(*))')} as loss from j""")
def _(t):
    d = F.zip_with("v", "w", lambda x, y: (x - y) * (x - y))
    return paired(t).agg(q6(F.sum(e.total(d)) / (2 * F.count("*"))).alias("loss"))


@query("los7_contrastive", f"""{PAIRS}, d as (select same, list_sum(list_transform(range(1, 65), lambda i: pow(a[i] - b[i], 2))) as d from j)
  select {Q6('sum(case when same then d else pow(greatest(1 - sqrt(d), 0), 2) end) / (2 * count(*))')} as loss,
  {Q6('sum(case when same then d else greatest(1 - d, 0) end) / (2 * count(*))')} as legacy from d""")
def _(t):
    d = e.total(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)))
    df = paired(t).select(d.alias("d"), (F.col("label") == F.col("other")).alias("same"))
    gap = F.greatest(1 - F.sqrt("d"), F.lit(0.0))
    return df.agg(q6(F.sum(F.when(F.col("same"), F.col("d")).otherwise(gap * gap)) / (2 * F.count("*"))).alias("loss"),
                  q6(F.sum(F.when(F.col("same"), F.col("d")).otherwise(F.greatest(1 - F.col("d"), F.lit(0.0)))) / (2 * F.count("*"))).alias("legacy"))


@query("scl13_eltwise", f"""{PAIRS}, l as (select n, unnest(a) as x, unnest(b) as y, unnest(range(64))::int as i from j)
  select n, i, {Q6('x * y')} as prod, {Q6('x + y * 0.5::double')} as sum, {Q6('greatest(x, y)')} as max, (y > x)::int as arg from l""")
def _(t):
    own = F.arrays_zip(e.eltwise("PROD", F.col("v"), F.col("w")).alias("prod"), e.eltwise("SUM", F.col("v"), F.col("w"), coeff=(1.0, 0.5)).alias("sum"),
                       e.eltwise("MAX", F.col("v"), F.col("w")).alias("max"), F.zip_with("v", "w", lambda x, y: (y > x).cast("int")).alias("arg"))
    return paired(t).select("n", F.posexplode(own).alias("i", "p")).select(
        "n", "i", q6(F.col("p.prod")).alias("prod"), q6(F.col("p.sum")).alias("sum"), q6(F.col("p.max")).alias("max"), F.col("p.arg").alias("arg"))


@query("scl23_vector_math", f"""{PAIRS} select n, {Q6('list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i]))')} as dot,
  {Q6('list_sum(list_transform(range(1, 65), lambda i: 2 * a[i] + b[i]))')} as axpy, {Q6('list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))')} as asum,
  {Q6('list_sum(list_transform(range(1, 33), lambda i: a[2 * i - 1] * b[2 * i - 1]))')} as strided from j""")
def _(t):
    odd = lambda c: F.filter(c, lambda x, i: i % 2 == 0)
    return paired(t).select("n", q6(e.dot(F.col("v"), F.col("w"))).alias("dot"),
                            q6(e.total(F.zip_with("v", "w", lambda x, y: 2 * x + y))).alias("axpy"),
                            q6(e.total(F.zip_with("v", "w", lambda x, y: F.abs(x - y)))).alias("asum"),
                            q6(e.dot(odd("v"), odd("w"))).alias("strided"))


@query("flt1_filter", f"""select vec_id as n, {Q6('embedding[1]')} as first from embeddings where label % 2 = 1""")
def _(t):
    return batch(t).where("label % 2 <> 0").select("n", q6(F.col("v")[0]).alias("first"))


@query("flt3_batch_reindex", f"""with m as (select max(vec_id) as m from embeddings), p as (select vec_id as n, (vec_id * 7 + 3) % (m + 1) as src from embeddings, m)
  select p.n, src, {Q6('embedding[1]')} as first, {Q6('embedding[64]')} as last from p join embeddings e on e.vec_id = src""")
def _(t):
    x = batch(t)
    perm = x.select("n").crossJoin(F.broadcast(x.agg(F.max("n").alias("m")))).select("n", ((F.col("n") * 7 + 3) % (F.col("m") + 1)).alias("src"))
    return perm.join(x.select(F.col("n").alias("src"), "v"), "src").select("n", "src", q6(F.col("v")[0]).alias("first"), q6(F.col("v")[63]).alias("last"))


@query("flt3_batch_reindex_bwd", f"""{LONG}, g as (select n % 50 as src, i, sum(x) as g from b group by n % 50, i) select src, i, {Q6('g')} as g from g""")
def _(t):
    return long(batch(t)).groupBy((F.col("n") % 50).alias("src"), "i").agg(q6(F.sum("x")).alias("g"))


@query("flt4_embed", f"""with w as (select p_partkey as id, p_retailprice as w, p_size as b from part)
  select l_orderkey, l_linenumber, {Q6('w + b')} as y from lineitem join w on id = l_partkey""")
def _(t):
    w = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("w"), F.col("p_size").alias("b"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(w, "l_partkey").select(
        "l_orderkey", "l_linenumber", q6(F.col("w") + F.col("b")).alias("y"))


@query("flt4_embed_bwd", f"select l_partkey as id, {Q6('sum(l_discount)')} as g, count(*) as n from lineitem group by l_partkey")
def _(t):
    return t("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(q6(F.sum("l_discount")).alias("g"), F.count("*").alias("n"))


@query("flt5_slice", f"""{LONG} select n, case when i < 16 then 0 when i < 40 then 1 else 2 end as part,
  (i - case when i < 16 then 0 when i < 40 then 16 else 40 end)::int as i, {Q6('x')} as x from b""")
def _(t):
    v = F.col("v")
    parts = F.array(F.slice(v, 1, 16), F.slice(v, 17, 24), F.slice(v, 41, 24))
    return batch(t).select("n", F.posexplode(parts).alias("part", "v")).select("n", "part", F.posexplode("v").alias("i", "x")).select(
        "n", "part", "i", q6(F.col("x")).alias("x"))


@query("flt6_crop", f"""{LONG} select n, (i // 16)::int as c, ((i % 16) // 4 - 1)::int as y, (i % 4 - 1)::int as x, {Q6('x')} as v from b
  where (i % 16) // 4 between 1 and 2 and i % 4 between 1 and 2""")
def _(t):
    rows = long(batch(t)).withColumn("c", F.floor(F.col("i") / 16).cast("int")).withColumn("y", F.floor(F.col("i") % 16 / 4).cast("int") - 1)
    rows = rows.withColumn("w", (F.col("i") % 4).cast("int") - 1)
    return rows.where("y between 0 and 1 and w between 0 and 1").select("n", "c", "y", F.col("w").alias("x"), q6(F.col("x")).alias("v"))


@query("flt8_split_bwd", f"{LONG} select n, i, {Q6('x + 2 * x + abs(x)')} as g from b")
def _(t):
    v = F.col("v")
    return long(batch(t).withColumn("v", e.eltwise("SUM", v, e.each(v, lambda x: 2 * x), e.each(v, F.abs)))).select("n", "i", q6(F.col("x")).alias("g"))


@query("set1_concat", f"""{PAIRS}, l as (select n, unnest(list_concat(a, b)) as x, unnest(range(128))::int as i from j) select n, i, {Q6('x')} as x from l""")
def _(t):
    return long(paired(t).withColumn("v", F.concat("v", "w"))).select("n", "i", q6(F.col("x")).alias("x"))


@query("set1_concat_axis0", f"""with m as (select max(vec_id) + 1 as m from embeddings)
  select vec_id as n, {Q6('embedding[1]')} as x from embeddings union all select vec_id + m, {Q6('embedding[1]')} from embeddings, m""")
def _(t):
    x = batch(t).select("n", q6(F.col("v")[0]).alias("x"))
    offset = F.broadcast(x.agg((F.max("n") + 1).alias("m")))
    return x.unionByName(x.crossJoin(offset).select((F.col("n") + F.col("m")).alias("n"), "x"))


@query("scl16_tile", f"{LONG} select n, (i + 64 * k)::int as i, {Q6('x')} as x from b, (select unnest(range(3)) as k)")
def _(t):
    return long(batch(t).withColumn("v", e.tile(F.col("v"), 3))).select("n", "i", q6(F.col("x")).alias("x"))


@query("scl18_reshape", f"{LONG} select n, (i // 8)::int as row, (i % 8)::int as col, {Q6('x')} as x from b")
def _(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, 8))
    return batch(t).select("n", F.posexplode(rows).alias("row", "v")).select("n", "row", F.posexplode("v").alias("col", "x")).select(
        "n", "row", "col", q6(F.col("x")).alias("x"))


@query("scl17_flatten", f"{LONG} select n, i, {Q6('x')} as x from b")
def _(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, 8))
    return long(batch(t).withColumn("v", F.flatten(rows))).select("n", "i", q6(F.col("x")).alias("x"))


@query("scl25_transform", f"""{LONG} select n, (i // 16)::int as c, ((i % 16) // 4 - 1)::int as y, (2 - i % 4)::int as x,
  {Q6('(x - (i // 16) * 0.01::double) * 2')} as v from b where (i % 16) // 4 between 1 and 2 and i % 4 between 1 and 2""")
def _(t):
    """Centre crop, mirror, channel means and scale."""
    rows = long(batch(t)).select("n", F.floor(F.col("i") / 16).cast("int").alias("c"), F.floor(F.col("i") % 16 / 4).cast("int").alias("y"),
                                 (F.col("i") % 4).cast("int").alias("w"), "x").where("y between 1 and 2 and w between 1 and 2")
    return rows.select("n", "c", (F.col("y") - 1).alias("y"), (2 - F.col("w")).alias("x"), q6((F.col("x") - F.col("c") * F.lit(0.01)) * 2).alias("v"))


@query("scl27_oversample", f"""{LONG}, o as (select * from (values (0, 0), (0, 2), (2, 0), (2, 2), (1, 1)) as o(oy, ox)),
  g as (select n, oy, ox, avg(x) as m from b, o where (i % 16) // 4 between oy and oy + 1 and i % 4 between ox and ox + 1 group by n, oy, ox)
  select n, {Q6('avg(m)')} as mean, {Q6('max(m)')} as top from g group by n""")
def _(t):
    """Means of the ten crops: corners and centre, and their mirror images, whose means are the same."""
    v = F.col("v")
    crops = [[c * 16 + (oy + y) * 4 + ox + x for c in range(4) for y in (0, 1) for x in (0, 1)] for oy, ox in ((0, 0), (0, 2), (2, 0), (2, 2), (1, 1))]
    means = F.array(*(e.total(F.array(*(v[i] for i in at))) / len(at) for at in [*crops, *crops]))
    return batch(t).select("n", means.alias("m")).select("n", q6(e.total(F.col("m")) / 10).alias("mean"), q6(F.array_max("m")).alias("top"))


@query("scl28_flip", f"{LONG} select n, (i - i % 4 + 3 - i % 4)::int as i, {Q6('x')} as x from b")
def _(t):
    lines = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.reverse(F.slice("v", r * 4 + 1, 4)))
    return long(batch(t).withColumn("v", F.flatten(lines))).select("n", "i", q6(F.col("x")).alias("x"))


def flagship(t):
    """Loss and accuracy of a linear softmax classifier with set weights."""
    return scored(t).agg(
        F.count("*").alias("n"), q6(F.avg(-F.log(F.greatest(F.col("p")[F.col("label")], F.lit(1.17549435e-38))))).alias("loss"),
        q6(F.avg(F.array_contains(F.slice("top", 1, 1), F.col("label")).cast("int"))).alias("top1"),
        q6(F.avg(F.array_contains("top", F.col("label")).cast("int"))).alias("top5"))


query("flagship_classifier", f"""{SCORES} select count(*) as n, {Q6('avg(-ln(greatest(p, 1.17549435e-38)))')} as loss,
  {Q6('avg((r = 1)::int)')} as top1, {Q6('avg((r <= 5)::int)')} as top5 from p where c = label""")(flagship)
