"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in a shuffled order (by a hash of their id). A document's virtual finish time is the
source's words up to and including it, over the source's target; a source whose target is above its own size queues
again, up to three times. All copies are sorted by finish time over all sources, by range, and taken until the next
one would pass the total budget.

Cumulative sums are taken in parts: per slice of the hash within a source, and per range of the global sort, with the
sums of the parts before. No source and no range is brought into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD_BREAK, Scratch, read

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST_COPIES = 3
#: The targets of so many sources may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_BREAK), "")).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each source: rank, source_size and target. Targets share the sum of all sizes by weight; those at
    MOST_COPIES times their source's size stop there and leave the rest to the others: the smaller of that bound and
    of level x weight, where the level makes the sum right."""
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_rank))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    bound = F.col("source_size") * MOST_COPIES
    fill = Window.orderBy(bound / F.col("weight"), "rank")
    everyone = Window.partitionBy()
    own = own.withColumn("full_at", bound / F.col("weight")).withColumn(
        "level", (F.sum("source_size").over(everyone)
                  - F.coalesce(F.sum(bound).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    open_ = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))
    own = own.withColumn("level", F.min(open_).over(everyone)["level"])
    return own.select("source", "rank", "source_size",
                      F.when(F.col("full_at") <= F.col("level"), bound.cast("double"))
                      .otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, carry: dict[str, Column] | None = None
        ) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, copies and taken.

    A null text has no words; a null source is a source, the last. Documents without words, and all rows of a table
    without words, are taken with 0 words. Rows that share an id queue one after the other. The order depends on ids and
    sizes alone, so reruns agree. ``carry``: further columns by name, computed from ``docs``; other columns are
    ignored.
    """
    scratch = Scratch(spark, "mix")
    carry = carry or {}
    sized = scratch.table(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"), *(c.alias(k) for k, c in carry.items()))
        .withColumn("row", F.monotonically_increasing_id()), "sized")
    goal = scratch.table(targets(sized, weights), "targets")
    goal = F.broadcast(goal) if goal.count() <= BROADCAST_SOURCES else goal
    place = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))), 1, 16)
    queue = sized.join(goal.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    queue = queue.withColumn("place", place).withColumn("slice", F.substring("place", 1, 3))

    line = queue.select("row", "rank", "slice", "place", "doc_id", "size", "source_size", "target")
    slices = line.groupBy("rank", "slice").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("rank", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("rank", "slice").orderBy("place", F.col("doc_id"), "size", "row").rowsBetween(
        Window.unboundedPreceding, 0)
    line = line.withColumn("upto", F.sum("size").over(within)).join(slices, ["rank", "slice"])
    turns = F.greatest(F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(MOST_COPIES)), F.lit(1)).cast("int")
    line = line.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    line = line.withColumn("words", F.col("turn") * F.col("source_size") + F.col("ahead") + F.col("upto"))
    line = scratch.table(line.select("row", "rank", "place", "doc_id", "size", "turn", "words", "target",
                                     (F.col("words") / F.col("target")).alias("finish")), "line")

    # what has finished by 1 fits; beyond, a copy can only fit if its own source leaves it room
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    room = line.where("finish <= 1").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used")).crossJoin(budget).select(
        "budget", (F.col("budget") - F.col("used")).alias("room"))
    few = line.crossJoin(F.broadcast(room)).where("finish <= 1 or words - target <= room")
    order = ["finish", "rank", "place", "doc_id", "size", "turn", "row"]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch.table(few.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
                           .select("part", "budget", *order), "ranged")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    taken = ranged.withColumn("upto", F.sum("size").over(within)).join(sums, "part").where(
        "ahead + upto <= budget").groupBy("row").agg(F.count("*").alias("copies"))
    return queue.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("copies", F.lit(0).cast("long")).alias("copies"),
        (F.col("size") * F.coalesce("copies", F.lit(0))).cast("long").alias("taken"), *carry)


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns stay. Rows without words go."""
    key = {"__id": F.col("doc_id").cast("long"), "__mark": F.xxhash64("text", "source")}
    found = Scratch(spark, "mixed").table(mix(spark, docs, weights, {"__mark": key["__mark"]}).where("size > 0"), "found")
    plan = found.groupBy(F.col("doc_id").alias("__i"), F.col("__mark").alias("__m")).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    rows = docs.withColumns(key).join(plan, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__mark") == F.col("__m")))
    again = F.lit(0)
    if not plan.where("__rows > 1").isEmpty():  # rows that repeat share their copies out
        again = F.row_number().over(Window.partitionBy("__i", "__m").orderBy("__id")) - 1
    rows = rows.withColumn("__nth", again).withColumn(
        "__copies", F.floor((F.col("__copies") + F.col("__rows") - 1 - F.col("__nth")) / F.col("__rows")).cast("int"))
    rows = rows.where("__copies > 0").withColumn("__turn", F.explode(F.sequence(F.lit(1), "__copies")))
    return rows.select(*(docs[c] for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(spark, read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
with sized as (
  select row_number() over () as r, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
own as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from sized group by source),
levels as (
  select *, (3 * source_size)::double / weight as full_at,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over (
            order by (3 * source_size)::double / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
         / (sum(weight) over (
            order by (3 * source_size)::double / weight, rank rows between current row and unbounded following))::double
           as lev
  from own),
goal as (
  select source, rank, source_size,
         case when full_at <= l.level then (3 * source_size)::double else l.level * weight end as target
  from levels, (select arg_min(lev, full_at) as level from levels where lev <= full_at) l),
queue as (
  select r, doc_id, size, source_size, target, rank,
         substr(md5('mix:' || coalesce(doc_id::varchar, '-')), 1, 16) as place
  from sized join goal on sized.source is not distinct from goal.source),
line as (
  select *, sum(size) over (partition by rank order by place, doc_id, size, r
                            rows between unbounded preceding and current row) as upto
  from queue),
copies as (
  select *, (turn * source_size + upto)::double / target as finish
  from line, (select unnest([0, 1, 2]) as turn)
  where size > 0 and (turn = 0 or turn < ceil(target / source_size))),
cut as (
  select *, sum(size) over (order by finish, rank, place, doc_id, size, turn, r
                            rows between unbounded preceding and current row) as total
  from copies),
took as (
  select r, sum(size)::bigint as taken from cut where total <= (select sum(size) from sized) group by r)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from queue left join took using (r)
"""
