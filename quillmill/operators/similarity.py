"""Near duplicates by word shingles: exact pairs, and the best-ranked survivors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import let
from quillmill.session import Scratch, bound_batches

#: Slots of the table that tells how often shingles occur, a byte each.
SLOTS = 1 << 16


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct shingles of ``size`` words of a-z and 0-9 (lower case); a shorter text is one shingle, an empty one none."""
    words = shingle_words(text)
    many = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < size, F.array(F.array_join(w, " "))).otherwise(many(w)))


def shingle_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """64-bit hashes of the shingles, distinct; the strings are not built."""
    many = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))
    return let(shingle_words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(many(w)))


def similar_pairs(docs: DataFrame, id_col: str, text_col: str, pct: int = 80, size: int = 5) -> DataFrame:
    """(a, b, inter, total): pairs of distinct shingle sets with Jaccard >= pct / 100; a < b are the sets' smallest ids.

    See :func:`shingle_classes` for the documents of each set. Candidates share one of
    the first ``n - ceil(pct*n/100) + 1`` shingles, rare ones first, which loses no pair.
    """
    return pairs_of(shingle_classes(docs, id_col, text_col, size), pct)


def shingle_classes(docs: DataFrame, id_col: str, text_col: str, size: int = 5) -> DataFrame:
    """(id, rep, n, hashes): documents with equal sets share the smallest id as rep."""
    hashes = F.sort_array(shingle_hashes(F.col(text_col), size))
    sets = docs.select(F.col(id_col).alias("id"), hashes.alias("hashes")).withColumn("sig", F.sha2(F.array_join("hashes", ","), 256))
    reps = sets.groupBy("sig").agg(F.min("id").alias("rep"))
    return sets.join(reps, "sig").select("id", "rep", F.size("hashes").alias("n"), F.when(F.col("id") == F.col("rep"), F.col("hashes")).alias("hashes"))


def rare_first(reps: DataFrame, share: int = 16, least: int = 6) -> Callable[[Column], Column]:
    """An order of hashes that puts those which one set in ``share`` shows often last; it is the same for every set, so it steers how many candidates meet, never a result."""
    return by_slots(slot_counts(reps, share, least))


def slot(h: Column) -> Column:
    return F.pmod(h, F.lit(SLOTS))


def slot_counts(reps: DataFrame, share: int = 16, least: int = 6) -> bytes:
    """How often the most frequent hash of each slot occurs in one set in ``share``, on a scale of its own (at most SLOTS rows of the sample's reach the driver)."""
    part = reps.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    seen = part.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    counts = bytearray(SLOTS)
    for r in seen.groupBy(slot(F.col("h")).alias("slot")).agg(F.max("c").alias("c")).collect():
        counts[r["slot"]] = min(255, 4 * r["c"].bit_length())
    return bytes(counts)


def by_slots(counts: bytes) -> Callable[[Column], Column]:
    return lambda h: F.struct(F.substring(F.lit(counts), (slot(h) + 1).cast("int"), F.lit(1)).alias("often"), h.alias("h"))


def candidates(reps: DataFrame, pct: int) -> DataFrame:
    """(a, b): pairs of sets (id, n, hashes) that share a prefix element, by sizes and places not too unlike."""
    rare = F.sort_array(F.transform("hashes", rare_first(reps)))
    prefix = F.slice(rare, 1, F.col("n") - F.ceil(F.col("n") * pct / 100).cast("int") + 1)
    posts = reps.select("id", "n", F.posexplode(F.transform(prefix, lambda x: x["h"])).alias("pos", "h"))
    a, b = (posts.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("pos").alias("pos" + x), "h") for x in "ab")
    size = (100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    # for a pair's first common shingle, what follows it in both sets bounds their intersection
    enough = (100 + pct) * F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= pct * (F.col("na") + F.col("nb"))
    return a.join(b, "h").where(size & enough).select("a", "b").distinct()


def pairs_of(classes: DataFrame, pct: int) -> DataFrame:
    """The similar pairs of :func:`shingle_classes`."""
    reps = classes.where((F.col("id") == F.col("rep")) & (F.col("n") > 0)).select("id", "n", "hashes").dropDuplicates(["id"])
    return compared(candidates(reps, pct), reps, pct)


def compared(met: DataFrame, reps: DataFrame, pct: int) -> DataFrame:
    """(a, b, inter, total): the pairs (a, b) of sets (id, n, hashes) with Jaccard >= pct / 100."""
    left, right = (reps.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("hashes").alias("h" + x)) for x in "ab")
    both = met.join(left, "a").join(right, "b").withColumn("inter", F.size(F.array_intersect("ha", "hb")))
    both = both.withColumn("total", F.col("na") + F.col("nb") - F.col("inter"))
    return both.where(100 * F.col("inter") >= pct * F.col("total")).select("a", "b", "inter", "total")


def pairs_and_copies(docs: DataFrame, id_col: str, text_col: str, pct: int, scratch: Scratch) -> DataFrame:
    """(a, b, inter, total): the rows of :func:`similar_pairs`, and each other document b whose set is not empty and equal to that of a, the smallest one with it.

    Hashes are written once, and only those of likely pairs are moved.
    """
    placed = scratch.stash(hashed_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    best = scratch.stash(placed.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "k")).alias("x")).select("sig", F.col("x.id").alias("rep"), "x.k"))
    reps = among(placed, scratch.stash(marks(best))).select("id", "k", "n", "hashes")
    sketched = scratch.stash(sketches(reps.select(F.col("id").alias("k"), "n", "hashes")))
    few = scratch.stash(likely(candidates(reps.select("id", "n", "hashes"), pct), sketched, pct))
    met = few.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    pairs = compared(few, among(reps, marks(best.join(met, "rep"))), pct)
    n = F.col("n")
    copies = placed.select("id", "sig", "n").join(best.select("sig", "rep"), "sig").where((n > 0) & (F.col("id") != F.col("rep")))
    return pairs.unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), n.alias("inter"), n.alias("total")))


def survivors(ranked: DataFrame, id_col: str, text_col: str, rank: list[Column], pct: int = 80) -> DataFrame:
    """(id, twin): twin is null for survivors, else the first accepted better-ranked document that is nearly the same.

    Goes through documents from the best rank down and drops one that is similar to an
    accepted one, as :func:`dropped` does for distinct sets. ``rank`` must order
    documents completely.
    """
    with Scratch(ranked.sparkSession) as scratch:
        order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
        base = ranked.select(F.col(id_col).alias("id"), order.alias("r"), F.col(text_col).alias("text"))
        placed = scratch.stash(numbered_sets(base))
        sets = among(placed, scratch.stash(marks(best_of(placed)))).select("k", "n", "hashes")
        gone = dropped(sets, scratch.stash(postings(sets, pct)), pct, scratch)
        return scratch.finish(with_twins(placed, gone))


def numbered_sets(base: DataFrame) -> DataFrame:
    """(id, k, sig, n, hashes) of (id, r, text): k rises with r; rows with an equal sig have an equal set."""
    return hashed_sets(base.repartitionByRange("r").sortWithinPartitions("r"))


def hashed_sets(rows: DataFrame) -> DataFrame:
    """(id, k, sig, n, hashes) of (id, text), numbered as the rows come."""
    sets = rows.select("id", F.monotonically_increasing_id().alias("k"), F.sort_array(shingle_hashes(F.col("text"))).alias("hashes"))
    return sets.select("id", "k", F.sha2(F.array_join("hashes", ","), 256).alias("sig"), F.size("hashes").alias("n"), "hashes")


def distinct_sets(placed: DataFrame) -> DataFrame:
    """(k, sig, n, hashes): each set that is not empty once, with the k of its best-ranked document."""
    return among(placed, marks(best_of(placed))).select("k", "sig", "n", "hashes")


def best_of(placed: DataFrame) -> DataFrame:
    """(k): the best-ranked document of each set that is not empty."""
    return placed.where("n > 0").groupBy("sig").agg(F.min("k").alias("k")).select("k")


#: Keys that a row of marks covers, as many as Spark's bitmaps hold.
MARKED = 1 << 15


def marks(keys: DataFrame) -> DataFrame:
    """(bucket, bits): a bit a key k, for keys without large gaps, as numbered rows have."""
    return keys.groupBy(F.floor(F.col("k") / MARKED).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("k", F.lit(MARKED))).alias("bits"))


def among(df: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of df whose k is marked; wide rows are not moved, the marks (a bit a numbered row) are."""
    at = F.pmod("k", F.lit(MARKED)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2))
    return df.withColumn("bucket", F.floor(F.col("k") / MARKED)).join(F.broadcast(marked), "bucket").where(bit == 1).select(df.columns)


def postings(sets: DataFrame, pct: int, order: Callable[[Column], Column] | None = None) -> DataFrame:
    """(k, n, pos, h): the prefix elements of each set, rare ones first unless another order is given."""
    order = order or rare_first(sets.withColumnRenamed("k", "id"))
    prefix = F.slice(F.sort_array(F.transform("hashes", order)), 1, F.col("n") - F.ceil(F.col("n") * pct / 100).cast("int") + 1)
    return sets.select("k", "n", F.posexplode(F.transform(prefix, lambda x: x["h"])).alias("pos", "h"))


def with_twins(placed: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, twin) of all documents from the sets (k, twin) that go."""
    best = placed.where("n > 0").groupBy("sig").agg(F.min("k").alias("best"))
    member = placed.select("id", "k", "sig").join(best, "sig", "left").join(gone.select(F.col("k").alias("best"), "twin"), "best", "left")
    # a copy of an accepted document is its twin's; a copy of a dropped one has the same twin
    told = member.select("id", F.coalesce("twin", F.when(F.col("k") != F.col("best"), F.col("best"))).alias("k"))
    return told.join(placed.select("k", F.col("id").alias("twin")), "k", "left").select("id", "twin")


#: Best-ranked undecided sets of a list that all others in it are compared with in the first round, and how many times more in each round after it.
LEADERS, MORE = 32, 16


def led_pairs(lead: DataFrame, posts: DataFrame, pct: int) -> DataFrame:
    """(a, b): pairs of a leader and a worse-ranked set of the same list, by sizes and places not too unlike."""
    side = lambda df, x: df.select(F.col("k").alias(x), F.col("n").alias("n" + x), F.col("pos").alias("pos" + x), "h")
    size = (100 * F.least("na", "nb") >= pct * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    enough = (100 + pct) * F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= pct * (F.col("na") + F.col("nb"))
    return side(lead, "a").join(side(posts, "b"), "h").where(size & enough).select("a", "b").distinct()


def alike(pairs: DataFrame, sets: DataFrame, pct: int, others: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of sets, b of ``others`` if given, with Jaccard >= pct / 100."""
    left, right = (df.select(F.col("k").alias(x), F.col("hashes").alias("h" + x)) for x, df in (("a", sets), ("b", sets if others is None else others)))
    inter = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").where(100 * inter >= pct * (F.size("ha") + F.size("hb") - inter)).select("a", "b")


def sketches(sets: DataFrame) -> DataFrame:
    """(k, n, sketch): parities of the counts of hashes by their low bits, a power of two of 2n bits or more.

    Where two sets' sketches differ, so do the sets: they differ in at least as many hashes as bits.
    """
    bound_batches(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(2):
                h = x.values.to_numpy()
                bits = 1 << max(6, (2 * len(h) - 1).bit_length())
                made.append(np.packbits((np.bincount(h & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["k", "n", "sketch"])

    return sets.select("k", "n", "hashes").mapInArrow(run, f"k {sets.schema['k'].dataType.simpleString()}, n int, sketch binary")


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the other's length."""
    size = 8 * min(len(x), len(y))
    both = int.from_bytes(x, "little") ^ int.from_bytes(y, "little") if len(x) == len(y) else 0
    if len(x) != len(y):
        for one in (x, y):
            rest = int.from_bytes(one, "little")
            while rest:
                both ^= rest & ((1 << size) - 1)
                rest >>= size
    return both.bit_count()


def likely(pairs: DataFrame, sketched: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out a Jaccard of pct / 100; none that has it is lost."""

    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([bits_apart(a, b) for a, b in zip(x, y, strict=True)], dtype="int32")

    left, right = (sketched.select(F.col("k").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)) for x in "ab")
    # sets with Jaccard >= pct / 100 differ in at most this share of all their hashes
    met = pairs.join(left, "a").join(right, "b").withColumn("apart", apart("sa", "sb"))
    return met.where((100 + pct) * F.col("apart") <= (100 - pct) * (F.col("na") + F.col("nb"))).select("a", "b")


def alike_of(pairs: DataFrame, sets: DataFrame, sketched: DataFrame, pct: int, scratch: Scratch) -> DataFrame:
    """As :func:`alike`, for numbered sets: only the sets of likely pairs are moved."""
    few = scratch.stash(likely(pairs, sketched, pct))
    left, right = (among(sets, marks(few.select(F.col(x).alias("k")))) for x in "ab")
    return alike(few, left, pct, right)


def dropped(sets: DataFrame, posts: DataFrame, pct: int, scratch: Scratch) -> DataFrame:
    """(k, twin): the sets that a walk from the smallest k up drops, and the smallest accepted one that each is similar to.

    In a round, the first undecided sets of each list (its leaders) are compared with
    all undecided sets of the list. A set that is a leader in all its lists knows
    all better-ranked sets that it may be similar to, so its fate follows from
    theirs; a set similar to an accepted one goes at once. The next round has
    only what is left. So a group of near copies costs a few comparisons a member,
    not a member each, and where a list holds many sets that are not similar, as a
    frequent passage makes, each is compared with the accepted ones. The first
    undecided set of all is decided in every round.
    """
    lists = posts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    every = scratch.stash(posts.join(lists, "h"))
    sketched = scratch.stash(sketches(sets))
    undecided, leaders, turn = every, LEADERS, 0
    fates: list[DataFrame] = []
    twins: list[DataFrame] = []
    while not undecided.isEmpty():
        lead = scratch.stash(undecided.withColumn("_r", F.row_number().over(Window.partitionBy("h").orderBy("k"))).where(F.col("_r") <= leaders).drop("_r"))
        edges = scratch.stash(alike_of(led_pairs(lead, undecided, pct), sets, sketched, pct, scratch))
        led = lead.groupBy("k").agg(F.count("*").alias("led"))
        informed = scratch.stash(undecided.groupBy("k").agg(F.count("*").alias("lists")).join(led, "k").where("led = lists").select("k"))
        fate = decided(edges, informed, scratch)
        twins.append(edges.join(fate.where("kept").select(F.col("k").alias("a")), "a").groupBy(F.col("b").alias("k")).agg(F.min("a").alias("twin")))
        fates.append(fate.withColumn("turn", F.lit(turn)))
        undecided = scratch.stash(undecided.join(fate.select("k"), "k", "left_anti"))
        leaders, turn = leaders * MORE, turn + 1
    if not fates:
        return sets.select("k", F.col("k").alias("twin")).limit(0)
    fate = reduce(DataFrame.unionByName, fates)
    rejected = scratch.stash(fate.where("not kept").join(reduce(DataFrame.unionByName, twins), "k").select("k", "twin", "turn"))
    if turn == 1:
        return rejected.select("k", "twin")
    # a set that went in an early round may be similar to a better one that was accepted later
    late = every.join(fate.where("kept and turn > 0").select("k", F.col("turn").alias("late")), "k")
    early = every.join(rejected, "k")
    side = lambda df, x, *more: df.select(F.col("k").alias(x), F.col("n").alias("n" + x), F.col("pos").alias("pos" + x), "h", *more)
    met = side(late, "a", "late").join(side(early, "b", "twin", "turn"), "h").where("late > turn and a < twin").select("a", "b").distinct()
    better = alike_of(met, sets, sketched, pct, scratch).groupBy(F.col("b").alias("k")).agg(F.min("a").alias("better"))
    return scratch.stash(rejected.join(better, "k", "left").select("k", F.least("twin", "better").alias("twin")))


def decided(edges: DataFrame, informed: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, kept): what follows from edges (a, b), a before b, for sets that know all edges to better ones."""
    found: list[DataFrame] = []
    while True:
        free = informed.join(edges.select(F.col("b").alias("k")).distinct(), "k", "left_anti")
        lost = edges.join(free.select(F.col("k").alias("a")), "a").select(F.col("b").alias("k")).distinct()
        now = scratch.stash(free.select("k", F.lit(True).alias("kept")).unionByName(lost.select("k", F.lit(False).alias("kept"))))
        found.append(now)
        if now.where("not kept").isEmpty():  # nobody's better neighbours have changed
            return reduce(DataFrame.unionByName, found)
        # edges of decided sets say nothing more: an accepted one's neighbours went, a dropped one's do not mind it
        gone = lambda c: now.select(F.col("k").alias(c))  # noqa: B023, E731
        edges = edges.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti")
        informed = informed.join(now.select("k"), "k", "left_anti")
