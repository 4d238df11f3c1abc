"""Near-duplicate candidates by MinHash bands: an approximate way beside the exact prefix join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.similarity import alike

#: Bands and rows of a band: sets with Jaccard 0.8 share a band with probability 1 - (1 - 0.8^5)^24 = 0.9999, with 0.5 in about half of the cases.
BANDS, ROWS = 24, 5
#: Sets of a band's key that are all compared with each other; longer lists are compared with their first set.
SHORT = 32


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n maps of 64-bit hashes, the same everywhere."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def band_keys(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(k, band, key) of sets (k, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(bands * rows)
        for batch in batches:
            keys = np.empty((len(batch), bands), np.int64)
            for i, x in enumerate(batch.column(1)):
                h = np.asarray(x.values).view(np.uint64)
                least = np.full(bands * rows, ~np.uint64(0))
                for at in range(0, len(h), 4096):
                    mixed = h[at : at + 4096, None] * a + b
                    least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
                key = np.zeros(bands, np.uint64)
                for row in least.reshape(bands, rows).T:
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + row
                keys[i] = key.view(np.int64)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys.reshape(-1))], names=["k", "band", "key"])

    return sets.select("k", "hashes").mapInArrow(run, "k long, band int, key long")


def banded_pairs(sets: DataFrame, pct: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b), a < b: pairs of sets (k, n, hashes) that share a band and whose Jaccard, counted exactly, is pct / 100 or more.

    Pairs that share no band are missed, as are, in lists of over SHORT sets, those
    without the list's first set, so that a large group of near copies costs a
    comparison a member and band; its members are still linked through that set.
    """
    keys = band_keys(sets, bands, rows)
    lists = keys.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("k").alias("first")).where("m > 1")
    found = keys.join(lists, ["band", "key"])
    star = found.where(f"m > {SHORT} and k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    few = found.where(f"m <= {SHORT}").select("band", "key", "k")
    meet = few.withColumnRenamed("k", "a").join(few.withColumnRenamed("k", "b"), ["band", "key"]).where("a < b").select("a", "b")
    sizes = lambda c: sets.select(F.col("k").alias(c), F.col("n").alias("n" + c))
    pairs = star.union(meet).distinct().join(sizes("a"), "a").join(sizes("b"), "b").where(100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")).select("a", "b")
    return alike(pairs, sets, pct)
