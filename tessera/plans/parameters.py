"""Parameter tables: update rules as ordered folds, versions, branches and bounded staleness.

Gradients come from lineitem: row = l_partkey, ordered by (l_shipdate, l_orderkey, l_linenumber). Each update is one step
of a fold over a row's own gradients, after a shuffle by row. A rule is written once, in SQL over the weight w, the
states h and z, the gradient g and the ordinal k, and both the fold and the recursive oracle read it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import ORACLES, QUERIES, Q6, q6, shared

LR = "0.01::double"
#: name: (next w, next h, next z); ``{h'}`` and ``{z'}`` stand for the next states.
RULES = {
    "upd1_blank": ("{w} + {g}", "{h}", "{z}"),
    "upd2_momentum": (f"{{w}} - {LR} * {{h'}}", "0.1::double * {g} + 0.9::double * {h}", "{z}"),
    "upd3_adadelta": (f"{{w}} - {LR} * ({{g}} * sqrt(({{z}} + 1e-8) / ({{h'}} + 1e-8)))", "0.9::double * {h} + 0.1::double * {g} * {g}",
                      "0.9::double * {z} + 0.1::double * ({g} * sqrt(({z} + 1e-8) / ({h'} + 1e-8))) * ({g} * sqrt(({z} + 1e-8) / ({h'} + 1e-8)))"),
    "upd4_adagrad": (f"{{w}} - {LR} * {{g}} / (sqrt({{h'}}) + 1e-8)", "{h} + {g} * {g}", "{z}"),
    "upd5_adam": (f"{{w}} - {LR} * sqrt(1 - pow(0.999::double, {{k}})) / (1 - pow(0.9::double, {{k}})) * {{h'}} / (sqrt({{z'}}) + 1e-8)",
                  "0.9::double * {h} + 0.1::double * {g}", "0.999::double * {z} + 0.001::double * {g} * {g}"),
    "upd6_nesterov": ("{w} + 1.9::double * {h'} - 0.9::double * {h}", f"-{LR} * {{g}} + 0.9::double * {{h}}", "{z}"),
    "upd7_rmsprop": (f"{{w}} - {LR} * {{g}} / (sqrt({{h'}}) + 1e-8)", "0.99::double * {h} + 0.01::double * {g} * {g}", "{z}"),
    "upd8_adarevision_momentum": (f"{{w}} - {LR} / sqrt({{z'}} + 1) * {{h'}}", "0.9::double * {h} + 0.1::double * {g}",
                                  "{z} + {h'} * {h'}"),
    "upd9_adadelta_momentum": (f"{{w}} - {LR} * sqrt({{z}} + 1e-8) / sqrt({{h'}} * {{h'}} + 1e-8) * {{h'}}", "0.9::double * {h} + 0.1::double * {g}",
                               f"0.9::double * {{z}} + 0.1::double * pow({LR} * sqrt({{z}} + 1e-8) / sqrt({{h'}} * {{h'}} + 1e-8) * {{h'}}, 2)"),
    "upd10_adagrad_momentum": (f"{{w}} - {LR} * {{h'}} / sqrt({{z'}} + 1e-8)", "0.9::double * {h} + 0.1::double * {g}", "{z} + {h'} * {h'}"),
    "upd11_rmsprop_momentum": (f"{{w}} - {LR} * {{h'}} / sqrt({{z'}} + 1e-8)", "0.9::double * {h} + 0.1::double * {g}",
                               "0.99::double * {z} + 0.01::double * {h'} * {h'}"),
}


def _filled(e: str, names: dict[str, str]) -> str:
    for key in ("{z'}", "{h'}", "{w}", "{h}", "{z}", "{g}", "{k}"):
        e = e.replace(key, names.get(key, key))
    return e


def steps(rule: tuple[str, str, str], names: dict[str, str]) -> tuple[str, str, str]:
    """The rule's expressions in terms of the state before the step."""
    w, h, z = rule
    h = _filled(h, names)
    z = _filled(z.replace("{h'}", f"({h})"), names)
    return _filled(w.replace("{z'}", f"({z})").replace("{h'}", f"({h})"), names), h, z


def gradients(lineitem):
    g = (F.col("l_discount") - F.col("l_tax")) * F.lit(0.7310585786)
    return lineitem.select(F.col("l_partkey").alias("row_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", g.alias("g")).alias("u"))


def folded(updates, rule: tuple[str, str, str]):
    """The weight and states of each row after its updates in order, from zero. ``updates``: row_id and u, a struct whose
    first fields give the order and whose ``g`` is the gradient."""
    w, h, z = steps(rule, {"{w}": "a.w", "{h}": "a.h", "{z}": "a.z", "{g}": "x.g", "{k}": "(a.k + 1)"})
    fold = f"""aggregate(us, named_struct('w', 0D, 'h', 0D, 'z', 0D, 'k', 0L),
      (a, x) -> named_struct('w', {w}, 'h', {h}, 'z', {z}, 'k', a.k + 1L))"""
    return updates.groupBy("row_id").agg(F.array_sort(F.collect_list("u")).alias("us")).select("row_id", F.expr(fold).alias("s"))


for _name, _rule in RULES.items():
    QUERIES[_name] = lambda spark, d, r=_rule: folded(gradients(spark.read.parquet(f"{d}/lineitem.parquet")), r).select(
        "row_id", q6(F.col("s.w")).alias("w"), q6(F.col("s.h")).alias("h"), F.col("s.k").alias("n"))
    _w, _h, _z = steps(_rule, {"{w}": "w", "{h}": "h", "{z}": "z", "{g}": "u.g", "{k}": "(f.k + 1)"})
    ORACLES[_name] = f"""with recursive u as (select l_partkey as row_id, (l_discount - l_tax) * 0.7310585786::double as g,
        row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) as k from lineitem),
      f as (select distinct row_id, 0::bigint as k, 0::double as w, 0::double as h, 0::double as z from u
        union all select f.row_id, f.k + 1, {_w}, {_h}, {_z} from f join u on u.row_id = f.row_id and u.k = f.k + 1)
      select row_id, {Q6('arg_max(w, k)')} as w, {Q6('arg_max(h, k)')} as h, max(k) as n from f group by row_id"""

G = "with g as (select l_linenumber as table_id, l_partkey as row_id, l_suppkey % 4 as worker, floor(l_orderkey / 1000)::bigint as clock, l_discount - l_tax as g from {lineitem})"
shared("ps3_oplog", f"{G} select table_id, row_id, clock, {Q6('sum(g)')} as g, count(*) as n from g group by table_id, row_id, clock")
shared("ps7_server_clock", f"{G}, c as (select table_id, worker, max(clock) as c from g group by table_id, worker) select table_id, min(c) as global_clock, max(c) as newest from c group by table_id")
shared("ps8_fork_branch", f"{G}, w as (select 0 as branch, table_id, row_id, sum(g) as w from g group by table_id, row_id) select branch, table_id, row_id, {Q6('w')} as w from w union all select 1, table_id, row_id, {Q6('w')} from w")
shared("ps9_inactivate_branch", f"{G} select worker as branch, table_id, {Q6('sum(g)')} as w from g where worker <> 2 group by worker, table_id")
shared("ps13_shards", f"{G}, n as (select max(row_id) + 1 as n from g) select distinct row_id, floor(row_id * 8 / n)::bigint as shard from g, n")
shared("jn8_stale_read", f"""{G}, v as (select row_id, clock as version, sum(g) as w from g where table_id = 1 group by row_id, clock),
  r as (select row_id, max(clock) as clock from g group by row_id)
  select r.row_id, r.clock, max(v.version) as version from r join v on v.row_id = r.row_id and v.version <= r.clock and v.version >= r.clock - 40 group by r.row_id, r.clock""")
shared("ps2_bounded_read", f"{G}, r as (select row_id, clock, sum(g) as g from g group by row_id, clock) select row_id, clock, {Q6('sum(g) over (partition by row_id order by clock rows between unbounded preceding and 1 preceding)')} as w from r")
shared("jn3_gradient_join", f"{G}, p as (select p_partkey as row_id, p_retailprice as w from {{part}}) select table_id, g.row_id, {Q6('sum(w - 0.1::double * g)')} as w from g join p on p.row_id = g.row_id group by table_id, g.row_id")
shared("agg11_worker_progress", f"{G} select table_id as branch, clock, {Q6('sum(g) / 4')} as progress from g group by table_id, clock having count(distinct worker) = 4")
shared("agg13_vector_clock", f"{G}, c as (select worker, max(clock) as c from g group by worker) select min(c) as lo, max(c) as hi from c")
shared("agg16_clip", f"{G}, t as (select row_id, sum(g) as g from g group by row_id), l as (select sqrt(sum(g * g)) as l from t) select row_id, {Q6('case when l > 10 then g * 10 / l else g end')} as g from t, l")
shared("agg19_row_add", f"{G} select row_id, {Q6('sum(g)')} as total, {Q6('sum(case when table_id = 1 then g end)')} as first from g group by row_id")
shared("los9_regularize", f"{G}, t as (select row_id, sum(g) as g, avg(g) as w from g group by row_id) select row_id, {Q6('g + 0.0005::double * w')} as l2, {Q6('g + 0.0005::double * sign(w)')} as l1 from t")
shared("los10_normalize", f"{G} select row_id, {Q6('sum(g) * 0.25::double')} as g from g group by row_id")
shared("los8_total_loss", f"{G}, l as (select table_id, avg(abs(g)) as loss from g group by table_id) select {Q6('sum(loss * case when table_id = 1 then 1.0::double else 0.3::double end)')} as loss from l")
shared("flt12_gather", "with i as (select l_orderkey as id1, l_partkey as id0 from {lineitem} where l_linenumber = 1) select id1, p_retailprice as v from i join {part} on p_partkey = id0")
shared("flt13_scatter", "with n as (select l_partkey as k, max(l_quantity) as v from {lineitem} where l_linenumber = 1 group by l_partkey) select p_partkey, coalesce(n.v, p_retailprice) as v from {part} left join n on n.k = p_partkey")
shared("agg20_row_placement", f"{G}, f as (select row_id, worker, count(*) as n from g group by row_id, worker) select row_id, worker from (select *, row_number() over (partition by row_id order by n desc, worker) as r from f) x where r = 1")
shared("jn5_lineage", "with recursive b as (select n_nationkey as branch, floor(n_nationkey / 3)::int as parent from {nation}), l as (select branch, branch as up, 0 as depth from b union all select l.branch, b.parent, depth + 1 from l join b on b.branch = l.up where b.parent <> l.up) select branch, max(depth) as depth from l group by branch")
