"""What several operators share: shared-folder tables, Arrow passes, word splitting, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.session import bound_batches, shared_dir

#: Characters that separate words in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables written in the shared folder to cut lineage; dropped at the end of a ``with`` block, after errors too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quillmill-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def stash(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again."""
        self.n += 1
        path = f"{self.path}/t{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` checkpointed (Spark removes it with its last reference), all tables dropped."""
        out = df.checkpoint(eager=True)
        self.drop()
        return out


def give_back() -> None:
    """Return memory that Arrow and the C library hold for reuse, as Python workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def through(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with small batches, its memory given back when a task ends."""
    bound_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id's text modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def picked(share: float, *cols: Column | str) -> Column:
    """Whether a row's hash over ``cols`` falls in the first ``share`` of all hashes."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) < int(min(1.0, max(0.0, share)) * (1 << 40))


#: Ids that may be broadcast: 8 bytes each, so 8 MB.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A narrow table with a broadcast hint if its counted size allows one."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): component is the smallest node that links reach.

    ``edges`` has long columns a and b. Every round each node is merged into the
    neighbour (or itself) of least hashed rank and links between merged nodes
    fall away; as at least one link falls in each round, the rounds go on until
    none is left, a few for any shape. Hubs cost one partial aggregate. No rows
    are gathered in one place.
    """
    links = scratch.stash(edges.where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not links.isEmpty():
        turn = len(maps)
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), c.alias("v"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        step = scratch.stash(near.select("a", F.least(F.col("m"), rank(F.col("a")))["v"].alias("p")))
        maps.append(step)
        left = links.join(step.select("a", F.col("p").alias("pa")), "a")
        right = left.join(step.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
        links = scratch.stash(right.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("a").alias("root"), F.col("p").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = scratch.stash(out)
    least = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(least, "root").select("node", "component")


class WordHashes(dict):
    """64-bit hashes of words, kept until there are too many."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        import xxhash

        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.hash(word)
        return value
