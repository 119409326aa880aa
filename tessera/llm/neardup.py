"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct word shingles (``shingles.shingle_set``). Two documents are linked when
|A & B| >= similarity * |A | B|. The steps:

1. one pass over the texts gives each document the key of its set, its band keys and its odd sketch: MinHash samples
   folded into a parity bitmap, whose XOR population count estimates a high similarity closely;
2. documents with equal sets become one node (the smallest doc_id), so copies cost nothing further;
3. each node is paired with the smallest node that it shares a bucket with, one pair a node and not all pairs; a pair
   goes on if its odd sketches allow the similarity, and is a link if the full sets confirm it;
4. where a bucket still holds more than one component, its pairs between components are compared in blocks by their odd
   sketches, and those that pass are confirmed on full sets too, the closest first, as components that they join need
   no further pairs;
5. components of the links, by contraction in tables.

With 40 bands of 5 samples a pair at similarity 0.75 shares no bucket with probability 2e-5 (0.85: 4e-11).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, read, small_batches
from tessera.llm.links import components
from tessera.llm.shingles import Sketcher, popcounts, shingle_set

#: Estimates come from samples; a pair goes on to the full sets from this far below the similarity asked for.
SLACK = 0.16
#: Buckets that stay open are compared by finer sketches: samples, bits, and how far below they may estimate (four
#: standard deviations).
FINE_SAMPLES, FINE_BITS, FINE_SLACK = 1500, 4096, 0.06
#: Members that one task confirms against one centre, and nodes of a bucket in one block of comparisons.
SALT_ROWS, BLOCK = 2048, 1024
#: So many ids (some 30 MB) may be broadcast to pick the texts to confirm; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _signed(words: int, sketcher: Sketcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, sizes, bands, odd = [], [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py(), words)
                sizes.append(len(values))
                if len(values):
                    samples = sketcher.samples(values)
                    keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                    bands.append(sketcher.band_keys(samples))
                    odd.append(sketcher.odd_sketch(samples))
                else:
                    keys.append(None), bands.append(None), odd.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "bands", "odd"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["node", "held"])
    return run


def _finer(words: int, sketcher: Sketcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [sketcher.odd_sketch(sketcher.samples(shingle_set(text.as_py(), words))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd, pa.binary())], names=["node", "odd"])
    return run


def _confirm(part: Fraction):
    """Rows sorted so that a centre's set stands before its members'. Keeps one set in memory besides the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, node, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                values = np.frombuffer(held, dtype=np.uint64)
                if node is None:
                    centre, own = (hub, salt), values
                elif centre == (hub, salt):
                    both = len(np.intersect1d(own, values, assume_unique=True))
                    if part.denominator * both >= part.numerator * (len(own) + len(values) - both):
                        a.append(hub)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _blocks(most: int, limit: int | None):
    """Rows sorted by block. Within a block, each minor node against all nodes of other components: pairs whose
    sketches pass; of those with one component, the ``limit`` closest. ``cut`` says that some were left for later.
    Nodes that share several buckets meet in each; the pair leaves the first of them only."""
    def compare(bucket: int, block: list[tuple]) -> Iterator[tuple]:
        nodes = np.array([r[0] for r in block], dtype=np.int64)
        groups = np.array([r[1] for r in block], dtype=np.int64)
        odd = np.frombuffer(b"".join(r[3] for r in block), dtype=np.uint64).reshape(len(block), -1)
        minor = np.array([r[2] for r in block], dtype=bool)
        bands = np.stack([r[4] for r in block])
        for i in np.flatnonzero(minor):
            off = popcounts(odd, odd[i])
            # of two minor nodes, the smaller one asks
            fit = np.flatnonzero((off <= most) & (groups != groups[i]) & (~minor | (nodes > nodes[i])))
            fit = fit[bands[i][(bands[fit] == bands[i]).argmax(axis=1)] == bucket]
            if limit is None:
                for j in fit:
                    yield int(nodes[i]), int(nodes[j]), False
                continue
            fit = fit[np.lexsort((off[fit], groups[fit]))]
            first = np.concatenate(([0], np.flatnonzero(groups[fit][1:] != groups[fit][:-1]) + 1, [len(fit)]))
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                for j in fit[lo : min(hi, lo + limit)]:
                    yield int(nodes[i]), int(nodes[j]), bool(hi > lo + limit)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        a, b, cut = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.bool_())],
                                          names=["a", "b", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []
        for batch in batches:
            rows = []
            bands = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else ()
            for bucket, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), bands, strict=True):
                if at != (bucket, i, j):
                    rows += compare(at[0], block) if block else ()
                    at, block = (bucket, i, j), []
                block.append(tuple(row))
            yield out(rows)
        if block:
            yield out(list(compare(at[0], block)))
    return run


class NearDuplicates:
    """``words`` a shingle, links from ``similarity`` on; bands, rows and bits as in ``Sketcher``."""

    def __init__(self, spark: SparkSession, words: int = 5, similarity: Fraction | float = Fraction(3, 4),
                 bands: int = 40, rows: int = 5, bits: int = 1024):
        self.spark, self.words = spark, words
        self.part = Fraction(similarity).limit_denominator(10_000)
        self.sketcher = Sketcher(bands, rows, bits)
        self.most = self.sketcher.most_odd(float(self.part) - SLACK)
        self.scratch = Scratch(spark, "neardup")

    def classes(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row (doc_id, n_shingles, component_id) for each row of ``docs``.

        Null or empty texts and texts of white space have no shingles and stay alone: their component is their own
        id. Rows without an id have a null component, link nothing and are linked with nothing else. Rows that share an id are one
        document. Repeated rows give repeated results; other columns are ignored, whatever their names.
        """
        small_batches(self.spark)
        table, drop = self.scratch.table, self.scratch.drop
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        signed = table(docs.mapInArrow(
            _signed(self.words, self.sketcher),
            "doc_id long, n_shingles long, set_key binary, bands array<long>, odd binary"), "signed")

        # equal sets become one node
        classes = table(signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
                        .agg(F.min("doc_id").alias("node")), "classes")
        nodes = table(signed.join(classes.withColumnRenamed("node", "doc_id"), ["set_key", "doc_id"], "left_semi")
                      .select(F.col("doc_id").alias("node"), "bands", "odd").dropDuplicates(["node", "odd"]), "nodes")
        # rows that share an id are one document, whatever their texts
        same = signed.where("doc_id is not null").join(classes, "set_key").groupBy("doc_id").agg(
            F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1).select(
            "a", F.explode("all").alias("b"))

        # buckets with at least two nodes, and the centre of each
        held = nodes.select("node", F.explode("bands").alias("bucket"))
        centres = held.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where(
            "centre < last").select("bucket", "centre")
        live = table(held.join(centres, "bucket"), "live")
        odd = nodes.select("node", "odd")
        star = live.where("node <> centre").groupBy(F.col("node").alias("b")).agg(F.min("centre").alias("a"))
        known = table(star.select("a", "b"), "known")
        links = self._confirmed(docs, self._allowed(known, odd), "star")
        links = links.union(same)
        joined = components(self.scratch, links, "star")
        still = table(self._open(live, joined).select(F.col("node").alias("end")).distinct(), "still")
        few = 0 < still.count()
        if few:
            finer = Sketcher(1, FINE_SAMPLES, FINE_BITS, seed=1009)
            most = finer.most_odd(float(self.part) - FINE_SLACK)
            fine = self._texts(docs, still).mapInArrow(_finer(self.words, finer), "node long, odd binary")
            fine = table(fine.join(nodes.select("node", "bands"), "node"), "fine")
        for turn, limit in enumerate((4, 64, None) if few else ()):
            between = table(self._between(live, joined, fine, limit, most), f"between{turn}")
            # a pair that is known says too that others were left for later
            cut = not between.where("cut").isEmpty()
            pairs = table(between.select("a", "b").join(known, ["a", "b"], "left_anti"), f"pairs{turn}")
            if not pairs.isEmpty():
                more = self._confirmed(docs, pairs, f"more{turn}")
                known = known.union(pairs)
                if not more.isEmpty():
                    links = links.union(more)
                    joined = components(self.scratch, links, f"more{turn}")
            if not cut:
                break
        drop("nodes", "live")
        found = classes.join(joined, "node", "left").select("set_key", F.coalesce("component", "node").alias("linked"))
        return signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left").select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("linked", "doc_id")).alias("component_id"))

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with one document of each class: that with the smallest id, once if equal rows repeat it. All
        columns stay; rows without an id or without words stay as they are."""
        found = self.scratch.table(self.classes(docs, id_col, text_col), "found")
        key = docs[id_col].cast("long")
        gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
        kept = docs.join(gone, key == F.col("__gone"), "left_anti")
        again = found.where("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").count().where("count > 1")
        if again.isEmpty():
            return kept
        again = again.select(F.col("doc_id").alias("__again"))
        words = F.coalesce(docs[text_col], F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
        once = kept.where(words).join(again, key == F.col("__again"), "left_semi").dropDuplicates([id_col])
        rest = kept.where(~words | key.isNull()).unionByName(
            kept.where(words & key.isNotNull()).join(again, key == F.col("__again"), "left_anti"))
        return rest.unionByName(once)

    def _allowed(self, pairs: DataFrame, odd: DataFrame) -> DataFrame:
        """The pairs whose odd sketches allow the similarity."""
        a = odd.select(F.col("node").alias("a"), F.col("odd").alias("odd_a"))
        b = odd.select(F.col("node").alias("b"), F.col("odd").alias("odd_b"))
        most = self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64)
                            .reshape(batch.num_rows, -1) for i in (2, 3))
                    batch = batch.filter(pa.array(popcounts(x, y) <= most))
                yield batch.select([0, 1])

        return pairs.join(a, "a").join(b, "b").select("a", "b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")

    def _confirmed(self, docs: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs whose full sets are similar enough. A centre's set travels once for SALT_ROWS members."""
        table, drop = self.scratch.table, self.scratch.drop
        pairs = table(pairs, f"{tag}-pairs")
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
        ends = table(pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct(), f"{tag}-ends")
        sets = table(self._texts(docs, ends).mapInArrow(_sets(self.words), "node long, held binary"), f"{tag}-sets")
        centre = salts.join(sets, salts.a == sets.node).select(
            F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
            F.lit(None).cast("long").alias("node"), "held")
        member = pairs.join(salts, "a").join(sets, pairs.b == sets.node).select(
            F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"),
            F.col("b").alias("node"), "held")
        rows = centre.unionByName(member).repartition("hub", "salt").sortWithinPartitions(
            "hub", "salt", F.col("node").asc_nulls_first())
        links = table(rows.mapInArrow(_confirm(self.part), "a long, b long"), f"{tag}-links")
        drop(f"{tag}-sets", f"{tag}-pairs")
        return links

    def _texts(self, docs: DataFrame, ends: DataFrame) -> DataFrame:
        """The rows of ``docs`` whose id is an ``end``."""
        if ends.count() <= BROADCAST_IDS:
            ends = F.broadcast(ends)
        return docs.join(ends, docs.doc_id == ends.end, "left_semi").dropDuplicates(["doc_id", "text"]).select("doc_id", "text")

    def _open(self, live: DataFrame, joined: DataFrame) -> DataFrame:
        """The rows (bucket, node, component) of buckets with more than one component."""
        rows = live.select("bucket", "node").join(joined, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component"))
        open_ = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return rows.join(open_.select("bucket"), "bucket", "left_semi")

    def _between(self, live: DataFrame, joined: DataFrame, odd: DataFrame, limit: int | None, most: int) -> DataFrame:
        """Pairs (a < b) of one bucket but of different components, by their odd sketches. Of each bucket, nodes outside its largest component are compared with all of its nodes, block by block."""
        rows = self._open(live, joined)
        sizes = rows.groupBy("bucket", "component").count()
        whole = sizes.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("big"),
                                            F.sum("count").alias("n"))
        whole = whole.select("bucket", F.col("big.component").alias("major"),
                             F.ceil((F.col("n") - F.col("big.count")) / BLOCK).cast("int").alias("n_minor"),
                             F.ceil(F.col("n") / (4 * BLOCK)).cast("int").alias("n_all"))
        rows = rows.join(whole, "bucket").withColumn("minor", F.col("component") != F.col("major"))
        i = F.pmod(F.xxhash64("node"), F.col("n_minor")).cast("int")
        j = F.pmod(F.xxhash64("component", "node"), F.col("n_all")).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        asks = rows.where("minor").withColumn("i", i).withColumn("j", F.explode(every("n_all"))).withColumn(
            "asks", F.lit(True))
        told = rows.withColumn("j", j).withColumn("i", F.explode(every("n_minor"))).withColumn("asks", F.lit(False))
        cells = asks.unionByName(told).groupBy("bucket", "i", "j", "node", "component").agg(
            F.max("asks").alias("asks"), F.max("minor").alias("minor"))
        # a minor node that is here only to be asked counts as one of the rest
        cells = cells.join(odd, "node").select("bucket", "i", "j", "node", "component", "asks", "odd", "bands")
        cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return cells.mapInArrow(_blocks(most, limit), "a long, b long, cut boolean").groupBy(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cut").alias("cut"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles, its class and whether it is the one that stays."""
    found = NearDuplicates(spark).classes(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
