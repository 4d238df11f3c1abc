"""N-gram Jaccard join: grouped prefix join with exact verification.

A document is the set of its distinct word n-grams, each a 64-bit hash. Two sets
with Jaccard >= t share an element of their prefixes (the first
``n - ceil(t*n) + 1`` elements in a common order). Documents with the same size
and prefix form one group; groups meet in the lists of their prefix elements.
The order puts elements that a sample of documents shows to be frequent last;
the sample only steers the order and never a result.

Lists of few members give all their pairs. In long lists (large groups of near
copies, in one group of equal prefixes or several) every member meets the list's
leader first; what then lies in one component needs no further comparison, and
pairs across components are compared. So no link between components is lost, and
a large group of near copies costs rows in proportion to its size. Candidates pass a size test, a position test, a bitmap test and,
where sets are long, a test of longer sketches (none loses a link) before their
whole sets are intersected, and pairs that are connected already are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, WordHashes, components, sized, through

M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Lists of up to so many members, over all their groups, give all their pairs.
SHORT = 48
#: Bits of a set's bitmap.
BITS = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence if there are fewer words."""
    ws = text.translate(LOWER).split()
    if not ws:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    k = min(n, len(w))
    h = w[: len(w) - k + 1] + np.uint64(k)
    for j in range(1, k):
        h = mixed(h) * M[j % len(M)] + w[j : len(w) - k + 1 + j]
    return np.unique(mixed(h))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the elements on each of BITS places: two bitmaps differ in no more places than the sets have unlike elements."""
    return np.packbits(np.bincount((s >> np.uint64(50)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1).tobytes()


def sketch(s: np.ndarray) -> bytes:
    """As bitmap, on two places or more an element; empty for sets of which bitmap has as many."""
    if 2 * len(s) <= BITS:
        return b""
    m = 1 << (2 * len(s) - 1).bit_length()
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def unlike(x: np.ndarray, y: np.ndarray) -> int:
    """Places where two sketches differ; the longer one is folded."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_pass(docs: DataFrame, id_col: str, text_col: str, n: int, make, schema: str) -> DataFrame:
    """One narrow pass over whole texts; make(ids, sets) gives a batch's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", words, n) for x in part.column(1)]
                yield make(part.column(0).to_numpy(zero_copy_only=False), sets)

    return through(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null"), run, schema)


def frequent(docs: DataFrame, id_col: str, text_col: str, n: int, scratch: Scratch, share: int = 16, least: int = 6, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Elements that one document in ``share`` shows often, with their counts; at most ``most`` (1.6 MB), those above one bound on counts."""

    def make(ids, sets):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

    part = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(share)) == 0)
    seen = scratch.stash(set_pass(part, id_col, text_col, n, make, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= least))
    octave = F.floor(8 * F.log2("c")).cast("int")
    bound, total = 1 << 30, 0
    for r in seen.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).orderBy(F.desc("o")).collect():  # at most 8 x 63 rows
        total += r["n"]
        if total > most:
            break
        bound = r["o"]
    rows = sorted(seen.where(octave >= bound).collect(), key=lambda r: r["h"] % (1 << 64))
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["c"] for r in rows], np.int64)


def similar(a: Column, b: Column, pct: int) -> Column:
    """Whether two sizes allow a link."""
    return 100 * F.least(a, b) >= pct * F.greatest(a, b)


def reachable(na: Column, pa_: Column, nb: Column, pb: Column, pct: int) -> Column:
    """Whether the overlap can still suffice if the shared element at these places is the first one."""
    return (100 + pct) * (1 + F.least(na - pa_ - 1, nb - pb - 1)) >= pct * (na + nb)


def near_bits(a: str, b: str, na: str, nb: str, pct: int) -> Column:
    words = [F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(BITS // 64)]
    return (100 + pct) * sum(words[1:], words[0]) <= (100 - pct) * (F.col(na) + F.col(nb))


def sketched(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) of nodes of ``classes`` whose sketches leave a link open; none that links is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for size, x, y in zip(batch.column(2).to_numpy(), batch.column(3), batch.column(4), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                keep.append(not len(s) or not len(t) or (100 + pct) * unlike(s, t) <= (100 - pct) * int(size))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").cast("long").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("na") + F.col("nb")).alias("size"), "sa", "sb")
    return through(both, run, "a long, b long")


def whole_sets(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, scratch: Scratch) -> DataFrame:
    """(node, set) of the documents that pairs name, made anew as they are read: no table of sets is kept."""

    def whole(ids, sets):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    named = scratch.stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(sized(named), "id", "left_semi")
    return set_pass(texts, "id", text_col, n, whole, "node long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) whose whole sets link; sets has node and set (sorted 64-bit hashes as bytes), which is shuffled once for both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([s, t]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= pct * (len(s) + len(t) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return through(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components of ``found`` (node, component)."""
    ends = pairs.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, pct: int = 85) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, class_id.

    Two documents link when 100 * |A and B| >= ``pct`` * |A or B| over their sets of
    distinct ``n``-word shingles (ASCII lower case; the whole sequence if shorter).
    component_id is the smallest id that links reach, the document's own at least;
    class_id the smallest id with the very same set. Null, empty and wordless texts
    have size 0 and link with nothing. Rows with a null id come back with null
    component; a repeated id counts as one document with each of its texts. An
    empty table gives an empty result; extra columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.finish(classes_of(docs, id_col, text_col, n, pct, scratch))


def classes_of(docs: DataFrame, id_col: str, text_col: str, n: int, pct: int, scratch: Scratch) -> DataFrame:
    hot, count = frequent(docs, id_col, text_col, n, scratch)
    words64 = BITS // 64

    def make(ids, sets):
        import xxhash

        prefixes, sigs, gids, maps, sketches = [], [], [], [], []
        for s in sets:
            size = len(s)
            if len(hot) and size:
                at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                order = np.argsort(np.where(hot[at] == s, count[at], 0), kind="stable")
            else:
                order = np.arange(size)
            first = s[order[: size - -(-pct * size // 100) + 1]] if size else s
            prefixes.append(first.view(np.int64))
            sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
            gids.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=size))
            maps.append(np.frombuffer(bitmap(s), np.int64))
            sketches.append(sketch(s))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        bits = np.stack(maps, 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary()), pa.array(np.array(gids, np.uint64).view(np.int64)), pa.StructArray.from_arrays([pa.array(x) for x in bits], names=[f"w{i}" for i in range(words64)]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes))), pa.array(sketches, pa.binary())],
            names=["id", "n", "sig", "gid", "bits", "prefix", "sketch"],
        )

    schema = f"id long, n int, sig binary, gid long, bits struct<{','.join(f'w{i}:long' for i in range(words64))}>, prefix array<long>, sketch binary"
    every = scratch.stash(set_pass(docs, id_col, text_col, n, make, schema))
    full = every.where("n > 0")
    classes = scratch.stash(full.groupBy("sig").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch")))
    members = classes.groupBy("gid").agg(F.count("*").alias("members"), F.min("node").alias("node"))
    carriers = full.select("id", "gid", "n", "prefix").join(members.select(F.col("node").alias("id"), "gid", "members"), ["id", "gid"]).dropDuplicates(["gid"])
    # size and place travel in one number, as most of what is shuffled are these rows
    entries = carriers.select("gid", "n", "members", F.posexplode("prefix").alias("pos", "h")).select("gid", "members", "h", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("np")).repartition("h")
    of = Window.partitionBy("h")  # a list's size and leader by windows, so that its rows are shuffled once
    shared = entries.withColumns({"nodes": F.sum("members").over(of), "lead": F.min(F.struct(F.xxhash64("gid", "h").alias("r"), "gid")).over(of)}).where("nodes > 1")
    shared = scratch.stash(shared.select("h", "gid", F.shiftright("np", 32).cast("int").alias("n"), "members", F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "nodes", F.col("lead.gid").alias("lead")))

    # short lists: all pairs of groups, and of members within a group
    side = lambda x: shared.where(F.col("nodes") <= SHORT).select("h", *(F.col(c).alias(c + x) for c in ("gid", "n", "pos", "members")))
    meet = side("a").join(side("b"), "h").where((F.col("gida") < F.col("gidb")) | ((F.col("gida") == F.col("gidb")) & (F.col("membersa") > 1)))
    meet = meet.where(similar(F.col("na"), F.col("nb"), pct) & reachable(F.col("na"), F.col("posa"), F.col("nb"), F.col("posb"), pct))
    met = meet.select("gida", "gidb").distinct()
    node = lambda x: classes.select(*(F.col(c).alias(c + x) for c in ("gid", "node", "bits", "n")))
    close = near_bits("bitsa", "bitsb", "na", "nb", pct)
    expand = lambda pairs: pairs.join(node("a"), "gida").join(node("b"), "gidb").where(F.col("nodea") != F.col("nodeb")).where(close)
    ordered = lambda df: df.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"))
    # long lists: each member, of the leading group too, and the leader, which is that group's first member
    long = shared.where(F.col("nodes") > SHORT)
    led = long.where("gid <> lead or members > 1").select(F.col("gid").alias("gida"), F.col("lead").alias("gidb")).distinct()
    head = members.select(F.col("node").alias("nodeb"), F.col("gid").alias("gidb")).join(node("b").drop("gidb"), "nodeb")
    leads = led.join(node("a"), "gida").join(head, "gidb").where((F.col("nodea") != F.col("nodeb")) & similar(F.col("na"), F.col("nb"), pct) & close)
    pairs = scratch.stash(sketched(ordered(expand(met)).union(ordered(leads)).distinct(), classes, pct))

    # an id whose rows hold several texts joins their components
    several = full.groupBy("id").agg(F.min("sig").alias("sig"), F.max("sig").alias("other")).where("sig <> other").select("id")
    held = full.select("id", "sig").distinct().join(several, "id").join(classes.select("sig", "node"), "sig").select("id", "node")
    same = held.groupBy("id").agg(F.min("node").alias("a")).join(held, "id").select("a", F.col("node").alias("b")).where("a <> b")
    # each document meets the smallest other one first; of the remaining pairs only those across components are compared
    check = lambda some: verified(some, whole_sets(some, docs, id_col, text_col, n, scratch), pct)
    first = scratch.stash(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = scratch.stash(check(first).union(same))
    found = scratch.stash(components(links, scratch))
    remain = scratch.stash(apart(pairs.join(first, ["a", "b"], "left_anti"), found))
    if not remain.isEmpty():
        links = links.union(scratch.stash(check(remain)))
        found = scratch.stash(components(links, scratch))

    # long lists once more: pairs across components
    own = F.coalesce("component", "node")
    placed = long.select("h", "gid", "pos").join(classes.select("gid", "node", "n", "bits"), "gid").join(found, "node", "left").select("h", "pos", "node", "n", "bits", own.alias("comp"))
    placed = scratch.stash(placed)
    sizes = placed.groupBy("h", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("h", "main")
    split = scratch.stash(placed.join(main, "h"))
    few = split.where("comp <> main").select("h", *(F.col(c).alias(c + "a") for c in ("node", "n", "pos", "bits", "comp")))
    rest = split.select("h", F.col("main").alias("mainb"), *(F.col(c).alias(c + "b") for c in ("node", "n", "pos", "bits", "comp")))
    across = few.join(rest, "h").where((F.col("compa") != F.col("compb")) & ((F.col("compb") == F.col("mainb")) | (F.col("nodea") < F.col("nodeb"))) & similar(F.col("na"), F.col("nb"), pct) & reachable(F.col("na"), F.col("posa"), F.col("nb"), F.col("posb"), pct) & close)
    more = scratch.stash(check(scratch.stash(sketched(ordered(across).distinct(), classes, pct))))
    if not more.isEmpty():
        found = scratch.stash(components(links.union(more), scratch))

    ids = every.select("id", "n", "sig").join(classes.select("sig", "node"), "sig", "left")
    out = ids.join(found, "node", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("id")).alias("component_id"), F.coalesce("node", "id").alias("class_id"))
    nulls = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias(id_col), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(nulls)
