"""Verbs of the parameter server's clients, test scores, statistics, windows over events and image transforms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.tensor import LONG, batch
from tessera.registry import Q6, q6, query

G = """with g as (select l_linenumber as table_id, l_partkey as row_id, l_suppkey % 4 as worker, l_orderkey // 1000 as clock, l_discount - l_tax as g from lineitem)"""


def gradients(t):
    return t("lineitem").select(F.col("l_linenumber").alias("table_id"), F.col("l_partkey").alias("row_id"), (F.col("l_suppkey") % 4).alias("worker"),
                                F.floor(F.col("l_orderkey") / 1000).alias("clock"), (F.col("l_discount") - F.col("l_tax")).alias("g"))


@query("ps1_access_plan", f"""{G} select worker, table_id, clock, count(distinct row_id) as n_rows, min(row_id) as first, max(row_id) as last from g group by worker, table_id, clock""")
def _(t):
    """What a worker declares before its clocks: for each table the rows that it reads and updates."""
    rows = gradients(t).select("worker", "table_id", "clock", "row_id").distinct()
    return rows.groupBy("worker", "table_id", "clock").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query("ps4_local_rows", f"""{G}, s as (select worker, row_id, clock, max(table_id) >= 4 as keep, sum(g) as g from g group by worker, row_id, clock),
 r as (select *, coalesce((select count(*) from s p where p.worker = s.worker and p.row_id = s.row_id and p.clock < s.clock and not p.keep), 0) as run from s)
 select a.worker, a.row_id, a.clock, {Q6('sum(b.g)')} as w from r a join r b on b.worker = a.worker and b.row_id = a.row_id and b.run = a.run and b.clock <= a.clock group by a.worker, a.row_id, a.clock""")
def _(t):
    """A worker's own rows: an access fetches what the last one kept and starts from zero after one that kept nothing."""
    own = gradients(t).groupBy("worker", "row_id", "clock").agg((F.max("table_id") >= 4).alias("keep"), F.sum("g").alias("g"))
    before = Window.partitionBy("worker", "row_id").orderBy("clock").rowsBetween(Window.unboundedPreceding, -1)
    runs = own.withColumn("run", F.coalesce(F.sum((~F.col("keep")).cast("int")).over(before), F.lit(0)))
    kept = Window.partitionBy("worker", "row_id", "run").orderBy("clock").rowsBetween(Window.unboundedPreceding, 0)
    return runs.select("worker", "row_id", "clock", q6(F.sum("g").over(kept)).alias("w"))


@query("ps5_clock", f"""{G}, c as (select table_id, worker, clock, sum(g) as g, count(*) as n from g group by table_id, worker, clock)
 select a.table_id, a.worker, a.clock, max(a.n) as flushed, sum(b.n)::bigint as total, {Q6('sum(b.g)')} as w from c a join c b on b.table_id = a.table_id and b.worker = a.worker and b.clock <= a.clock
 group by a.table_id, a.worker, a.clock""")
def _(t):
    """Each clock flushes a worker's updates and makes a version: its updates, those so far and their sum."""
    w = Window.partitionBy("table_id", "worker").orderBy("clock").rowsBetween(Window.unboundedPreceding, 0)
    c = gradients(t).groupBy("table_id", "worker", "clock").agg(F.sum("g").alias("g"), F.count("*").alias("flushed"))
    return c.select("table_id", "worker", "clock", "flushed", F.sum("flushed").over(w).alias("total"), q6(F.sum("g").over(w)).alias("w"))


@query("ps11_branch_report", f"""{G} select g.worker, g.clock, clock % 5 as branch, n_name as tunable, {Q6('avg(abs(g))')} as progress from g left join nation on n_nationkey = clock % 5
  group by g.worker, g.clock, n_name""")
def _(t):
    """A worker's report of a clock, with the branch that the clock belongs to and its setting."""
    reports = gradients(t).groupBy("worker", "clock").agg(q6(F.avg(F.abs("g"))).alias("progress")).withColumn("branch", F.col("clock") % 5)
    settings = t("nation").select(F.col("n_nationkey").alias("branch"), F.col("n_name").alias("tunable"))
    return reports.join(settings, "branch", "left").select("worker", "clock", "branch", "tunable", "progress")


@query("agg14_test_score", f"""{G}, m as (select table_id as output, avg(abs(g)) as score, count(*) as n from g group by table_id)
  select output, {Q6('score')} as score, {Q6('score / output')} as weighted, n from m union all select -1, {Q6('sum(score)')}, {Q6('sum(score / output)')}, sum(n)::bigint from m""")
def _(t):
    """The mean of each output over the test iterations, weighted by its loss weight; -1 is the net's."""
    m = gradients(t).groupBy(F.col("table_id").alias("output")).agg(F.avg(F.abs("g")).alias("score"), F.count("*").alias("n")).withColumn(
        "weighted", F.col("score") / F.col("output"))
    whole = m.agg(F.lit(-1).alias("output"), F.sum("score").alias("score"), F.sum("weighted").alias("weighted"), F.sum("n").alias("n"))
    return m.unionByName(whole).select("output", q6(F.col("score")).alias("score"), q6(F.col("weighted")).alias("weighted"), "n")


@query("top2_sorted_results", f"select p_partkey as point, {Q6('p_retailprice / p_size')} as loss from part order by p_retailprice / p_size, p_partkey")
def _(t):
    """A search's results from the best on: a range sort, no window."""
    loss = F.col("p_retailprice") / F.col("p_size")
    return t("part").orderBy(loss, "p_partkey").select(F.col("p_partkey").alias("point"), q6(loss).alias("loss"))


@query("jn7_boxes", "select l_orderkey, l_linenumber, p_name as image, case when l_discount * 10 >= 0.5::double then p_size else 0 end as label from lineitem, part where p_partkey = l_partkey")
def _(t):
    """Boxes with their image, by its index; the background's label is 0."""
    boxes = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), (F.col("l_discount") * 10 >= 0.5).alias("fg"))
    return boxes.join(t("part").select("p_partkey", "p_name", "p_size"), "p_partkey").select(
        "l_orderkey", "l_linenumber", F.col("p_name").alias("image"), F.when(F.col("fg"), F.col("p_size")).otherwise(0).alias("label"))


@query("src18_json_stats", f"""{G} select worker, json_object('worker', worker, 'updates', count(*), 'tables', count(distinct table_id), 'clock', max(clock))::varchar as stats from g group by worker""")
def _(t):
    """A worker's statistics as a line of JSON."""
    own = gradients(t).groupBy("worker").agg(F.count("*").alias("updates"), F.count_distinct("table_id").alias("tables"), F.max("clock").alias("clock"))
    return own.select("worker", F.to_json(F.struct("worker", "updates", "tables", "clock")).alias("stats"))


@query("scl26_transformer", f"""{LONG}, s as (select n, i, x as back, case i // 16 when 0 then 2 when 2 then 0 else i // 16 end as c, i % 16 // 4 as h, i % 4 as w from b)
  select n, (c * 16 + w * 4 + h)::int as i, {Q6('(back * 255 - (c + 1) * 10) * 0.5::double')} as y, {Q6('back')} as back from s""")
def _(t):
    """Transposes height and width, swaps the channels 0 and 2, scales by 255, takes the channel's mean off, scales by a
    half; ``back`` is the inverse, at the place where the value stands now."""
    source = F.array(*(F.lit((2, 1, 0, 3)[c] * 16 + h * 4 + w) for c in range(4) for w in range(4) for h in range(4)))
    mean = lambda i: (F.floor(i / 16) + 1) * 10
    y = F.transform(source, lambda at, i: (F.get("v", at) * 255 - mean(i)) * 0.5)
    back = F.transform(y, lambda x, i: (x / 0.5 + mean(i)) / 255)
    return batch(t).select("n", F.posexplode(F.arrays_zip(y.alias("y"), back.alias("back"))).alias("i", "p")).select(
        "n", "i", q6(F.col("p.y")).alias("y"), q6(F.col("p.back")).alias("back"))


def events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_sliding_windows", """with e as (select epoch_us(ts) // 1000000 as s, event_type from events), w as (select (s // 21600 - k) * 21600 as start, event_type from e, (select unnest(range(4)) as k))
  select start, event_type, count(*) as n from w group by start, event_type""")
def _(t):
    """A day's window every six hours, as ``tessera.streaming.progress.sliding`` gives them over a stream."""
    from tessera.streaming.progress import sliding

    return sliding(events(t), width="24 hours", slide="6 hours").select(F.col("start").cast("long").alias("start"), "event_type", "n")


@query("str_session_windows", """with e as (select user_id, epoch_us(ts) as s from events), l as (select *, lag(s) over (partition by user_id order by s) as p from e),
 r as (select user_id, s, sum(case when s - p < 43200000000 then 0 else 1 end) over (partition by user_id order by s rows unbounded preceding) as run from l)
 select user_id, min(s) as first, max(s) as last, count(*) as n from r group by user_id, run""")
def _(t):
    """A user's events less than twelve hours apart."""
    from tessera.streaming.progress import sessions

    return sessions(events(t), gap="12 hours").select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query("win21_loss_blocks", """with l as (select user_id % 8 as log, list(epoch_us(ts) // 1000000 % 86400 order by ts, event_id) as s, list(event_id order by ts, event_id) as c,
  list(value order by ts, event_id) as v from events group by user_id % 8),
 b as (select *, unnest(range(len(s) // 4)) as b, list_transform(s, lambda x: case when x < s[1] then x + 86400 else x end) as t from l)
 select log, b as block, c[4 * b + 4] as clock, t[4 * b + 4] - t[4] as seconds, """ + Q6("(v[4 * b + 1] + v[4 * b + 2] + v[4 * b + 3] + v[4 * b + 4]) / 4") + " as loss from b")
def _(t):
    """The summary of a log of losses from four workers: of each whole block of four lines the last line's clock, its time
    of day since the first block's last line, and the mean loss. A time before the log's first is of the next day. A log is
    one partition, as its lines have one order."""
    lines = Window.partitionBy("log").orderBy("ts", "event_id")
    rows = events(t).select((F.col("user_id") % 8).alias("log"), "ts", "event_id", "value", (F.unix_seconds("ts") % 86400).alias("s"))
    first = F.first("s").over(lines)
    rows = rows.withColumn("line", F.row_number().over(lines) - 1).withColumn("s", F.when(F.col("s") < first, F.col("s") + 86400).otherwise(F.col("s")))
    blocks = rows.groupBy("log", F.floor(F.col("line") / 4).alias("block")).agg(
        F.count("*").alias("n"), F.max_by("event_id", "line").alias("clock"), F.max_by("s", "line").alias("s"), F.avg("value").alias("loss")).where("n = 4")
    base = F.first("s").over(Window.partitionBy("log").orderBy("block"))
    return blocks.select("log", "block", "clock", (F.col("s") - base).alias("seconds"), q6(F.col("loss")).alias("loss"))


@query("src21_net_summary", """select 1 as place, 'ip1' as layer, 'InnerProduct' as type, 'data' as bottom, 'ip1' as top, max(len(embedding)) * count(distinct label) + count(distinct label) as params from embeddings
  union all select 2, 'prob', 'Softmax', 'ip1', 'prob', 0 union all select 3, 'loss', 'SoftmaxWithLoss', 'ip1,label', 'loss', 0""")
def _(t):
    """The layers of the classifier over the embeddings in order, with the parameters that each holds for these data."""
    size = t("embeddings").agg(F.max(F.size("embedding")).alias("inputs"), F.count_distinct("label").alias("outputs"))  # one row
    layers = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(a).alias("layer"), F.lit(b).alias("type"), F.lit(c).alias("bottom"), F.lit(d).alias("top"), F.lit(w).alias("w"))
                       for k, a, b, c, d, w in ((1, "ip1", "InnerProduct", "data", "ip1", 1), (2, "prob", "Softmax", "ip1", "prob", 0), (3, "loss", "SoftmaxWithLoss", "ip1,label", "loss", 0))))
    return size.select(F.explode(layers).alias("l"), ((F.col("inputs") + 1) * F.col("outputs")).alias("p")).select(
        "l.place", "l.layer", "l.type", "l.bottom", "l.top", (F.col("p") * F.col("l.w")).alias("params"))
