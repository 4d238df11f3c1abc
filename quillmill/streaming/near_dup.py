"""Near duplicates in batches: an index of accepted sets that each batch is held against, then added to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.similarity import alike, by_slots, distinct_sets, dropped, led_pairs, numbered_sets, postings, slot_counts, with_twins
from quillmill.session import Scratch

#: Ranks of one batch; later batches rank behind.
ROOM = 1 << 46
SETS, POSTS, IDS = "k long, n int, hashes array<long>", "k long, n int, pos int, h long", "k long, id {}"


class AcceptedIndex:
    """Accepted sets, their prefix elements and ids, as Parquet folders a batch under ``path``, which all executors see.

    The order of elements is fixed by the first batch that has sets; it steers how
    many candidates meet, never a result. A batch that runs again writes the
    same folders again and reads those of earlier batches only, so replays after a failure change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", pct: int = 80):
        self.spark, self.path, self.pct = spark, path.rstrip("/"), pct
        self.schemas = {"sets": SETS, "posts": POSTS, "ids": IDS.format(id_type), "order": "counts binary"}

    def read(self, table: str, before: int) -> DataFrame:
        """The rows of batches before one; a batch without rows has no folder."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [p.getPath().toString() for p in fs.listStatus(top)] if fs.exists(top) else []
        earlier = [p for p in found if int(p.rpartition("=")[2]) < before]
        schema = self.schemas[table]
        return self.spark.read.schema(schema).parquet(*earlier) if earlier else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def order(self, sets: DataFrame, batch: int) -> Callable[[Column], Column]:
        known = self.read("order", batch).first()
        if known is None:
            counts = slot_counts(sets.withColumnRenamed("k", "id"))
            if not sets.isEmpty():
                self.write(self.spark.createDataFrame([(bytearray(counts),)], self.schemas["order"]), "order", batch)
            return by_slots(counts)
        return by_slots(bytes(known["counts"]))

    def judge(self, docs: DataFrame, batch: int, id_col: str, text_col: str, rank: list[Column]) -> DataFrame:
        """(id, twin) of a batch whose documents all rank behind those of earlier batches: twin is null for accepted ones, which enter the index.

        As ``similarity.survivors`` says of all batches together. An empty batch gives an empty result.
        """
        with Scratch(self.spark) as scratch:
            order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
            base = docs.select(F.col(id_col).alias("id"), order.alias("r"), F.col(text_col).alias("text"))
            placed = scratch.stash(numbered_sets(base).withColumn("k", F.col("k") + F.lit(batch) * ROOM))
            sets = scratch.stash(distinct_sets(placed))
            posts = scratch.stash(postings(sets, self.pct, self.order(sets, batch)))
            met = led_pairs(self.read("posts", batch), posts, self.pct)
            old = scratch.stash(alike(met, self.read("sets", batch), self.pct, sets).groupBy(F.col("b").alias("k")).agg(F.min("a").alias("twin")))
            fresh = scratch.stash(sets.join(old, "k", "left_anti"))
            new = dropped(fresh, posts.join(old, "k", "left_anti"), self.pct, scratch)
            gone = scratch.stash(old.unionByName(new))
            accepted = scratch.stash(fresh.join(new, "k", "left_anti").select("k", "n", "hashes"))
            self.write(accepted, "sets", batch)
            self.write(posts.join(accepted.select("k"), "k"), "posts", batch)
            self.write(placed.select("k", "id").join(accepted.select("k"), "k"), "ids", batch)
            told = with_twins(placed, gone.join(placed.select("k"), "k", "left_semi"))
            # a twin of an earlier batch has its id in the index
            best = placed.where("n > 0").groupBy("sig").agg(F.min("k").alias("best"))
            of = placed.select("id", "sig").join(best, "sig").join(old.withColumnRenamed("k", "best"), "best").join(self.read("ids", batch).select(F.col("k").alias("twin"), F.col("id").alias("earlier")), "twin").select("id", "earlier")
            return scratch.finish(told.join(of, "id", "left").select("id", F.coalesce("earlier", "twin").alias("twin")))


def near_dup_batches(index: AcceptedIndex, id_col: str, text_col: str, rank: Callable[[], list[Column]], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: judges each batch and hands (id, twin) and the batch's number to ``sink``, which must bear replays."""

    def each(docs: DataFrame, batch: int) -> None:
        sink(index.judge(docs, batch, id_col, text_col, rank()), batch)

    return each
