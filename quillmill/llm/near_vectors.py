"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one kept row per group.

Every pair with cosine >= t is found. Let x lie in cell A and y in cell B, with
unit vectors and centroids a, b. Then x.(b-a) <= 0 <= y.(b-a), and these two
numbers differ by at most |x-y| |b-a| <= sqrt(2-2t) |b-a|. So at least one of the
two vectors lies within half of that of the cells' border, and "visits" the other
cell. Each cell compares its own rows with each other and with its visitors; a
pair that meets twice counts in the cell of the visitor that comes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, components, picked, through

#: Rows for fitting the centroids, about, which steer speed only, and their bytes. Own rows and other rows that one task compares, and bytes of each, about.
FIT_ROWS, FIT_BYTES, BLOCK, OTHERS, BLOCK_BYTES, MAX_CELLS = 20_000, 64 << 20, 2048, 16_384, 64 << 20, 1024
#: Vectors, and their bytes, up to which one task compares all vectors of a rare length.
SMALL_ROWS, SMALL_BYTES = 4096, 2 << 20


def spherical_kmeans(x: np.ndarray, k: int, turns: int = 6) -> np.ndarray:
    """Unit centroids of unit rows; starts from evenly spaced rows, empty cells keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        cell = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    single = bool(raw) and len(raw[0]) == 4 * dim
    if any(len(r) != len(raw[0]) for r in raw):
        raw, single = [np.frombuffer(r, np.float32).astype(np.float64).tobytes() if len(r) == 4 * dim else r for r in raw], False
    x = np.frombuffer(b"".join(raw), np.float32 if single else np.float64).astype(np.float64).reshape(len(raw), dim)
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares overflow nor tiny ones vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    Vectors link when their cosine in double precision is >= ``threshold`` (above 0).
    n_links counts the other rows linked directly, component_id is the smallest id
    that links reach, kept marks the row that carries that id. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths do not link. Rows with a null id come back with no
    links and a null component, and take no part; repeated rows with one id each
    count as a vector. Extra columns are ignored; an empty table gives an empty result.
    """
    with Scratch(vectors.sparkSession) as scratch:
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
        # identical vectors are one row with a weight
        rows = rows.select("id", "v", F.coalesce(good & F.col("id").isNotNull(), F.lit(False)).alias("good"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import hashlib

            for b in batches:
                raw = [np.array(v, np.float64) + 0.0 for v in b.column(1).to_pylist()]
                with np.errstate(over="ignore"):
                    short = [v.astype(np.float32) for v in raw]
                size = [len(v) for v in raw]
                raw = [(f if np.array_equal(f.astype(np.float64), v) else v).tobytes() for f, v in zip(short, raw, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array(raw, pa.binary()), pa.array([hashlib.sha256(b"%d:" % n + v).digest() for n, v in zip(size, raw, strict=True)], pa.binary())], names=["id", "dim", "raw", "sig"])

        flat = scratch.stash(through(rows.where("good").select("id", "v"), packed, "id long, dim int, raw binary, sig binary"))
        uniq = scratch.stash(flat.groupBy("sig").agg(F.min("id").alias("node"), F.count("*").alias("w"), F.first("dim").alias("dim"), F.first("raw").alias("raw")))
        # rare lengths with few vectors in one pass, a group each; the others one by one
        totals = uniq.groupBy("dim").agg(F.count("*").alias("n"))
        large = {r["dim"]: r["n"] for r in totals.orderBy(F.desc("n"), "dim").limit(1).union(totals.where((F.col("n") > SMALL_ROWS) | (F.col("n") * F.col("dim") * 8 > SMALL_BYTES))).collect()}
        pieces = few_vectors(uniq.where(~F.col("dim").isin(*large)), threshold)
        for d, n in sorted(large.items()):
            pieces = pieces.union(one_length(uniq.where(F.col("dim") == d), d, n, threshold, scratch))
        pieces = scratch.stash(pieces)
        links = pieces.groupBy("node").agg(F.sum("links").alias("links"))
        comps = components(pieces.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
        per = uniq.select("sig", "node", "w").join(links, "node", "left").join(comps, "node", "left")
        per = per.select("sig", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
        linked = flat.select("id", "sig").join(per, "sig").select("id", "n_links", "component_id")
        alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = linked.unionByName(alone)
        return scratch.finish(out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))


def above(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of unit x and y whose product in double precision reaches the threshold.

    Single precision finds the candidates: its error is below (length + 8) * 2**-23 for
    unit vectors. Where many are near, double precision takes the whole block.
    """
    s = x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(threshold - (x.shape[1] + 8) * 2.4e-7)
    if np.count_nonzero(s) > 0.01 * s.size:
        return np.nonzero(x @ y.T >= threshold)
    i, j = np.nonzero(s)
    step = max(1, (1 << 21) // x.shape[1])
    sure = [np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) >= threshold for k in range(0, len(i), step)]
    sure = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[sure], j[sure]


PIECES = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def pieces_of(node: np.ndarray, links: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    """(node, links, root) from rows' nodes and link counts and the pairs of rows that link."""
    names, at = np.unique(node, return_inverse=True)
    label = names.copy()
    join(label, at[i], at[j])
    total = np.bincount(at, links, len(names)).astype(np.int64)
    hit = np.nonzero((total > 0) | (label != names))[0]
    return pa.Table.from_arrays([pa.array(names[hit], pa.int64()), pa.array(total[hit]), pa.array(label[hit], pa.int64())], schema=PIECES)


def few_vectors(uniq: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) of the distinct vectors of lengths with SMALL_ROWS vectors and SMALL_BYTES at most."""

    def compare(table: pa.Table) -> pa.Table:
        x = unit(table.column("raw").to_pylist(), table.column("dim")[0].as_py())
        w = table.column("w").to_numpy()
        i, j = above(x, x, threshold)
        i, j = i[i != j], j[i != j]
        return pieces_of(table.column("node").to_numpy(), np.bincount(i, w[j], len(x)).astype(np.int64), i, j)

    return uniq.select("dim", "node", "raw", "w").groupBy("dim").applyInArrow(compare, "node long, links long, root long")


def one_length(uniq: DataFrame, dim: int, n: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links, root) of the distinct vectors of one length; links are to be summed."""
    k = int(min(MAX_CELLS, max(1, round(math.sqrt(n) / 6))))
    fit = sorted(uniq.where(picked(min(FIT_ROWS, FIT_BYTES // (8 * dim)) / n, "sig")).select("node", "raw").collect())  # FIT_ROWS rows and FIT_BYTES, about
    fit = fit or uniq.select("node", "raw").limit(1).collect()
    x = unit([bytes(r["raw"]) for r in fit], dim)
    block, others = (max(16, min(most, BLOCK_BYTES // (8 * dim))) for most in (BLOCK, OTHERS))
    c = spherical_kmeans(x, min(k, len(x)))
    k = len(c)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) * (math.sqrt(max(0.0, 2 - 2 * threshold)) / 2) + 1e-9

    def visits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x @ c.T
        home = np.argmax(s, 1)
        out = s[np.arange(len(x)), home][:, None] - s <= gap[home]
        out[np.arange(len(x)), home] = False
        return home, out

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                home, out = visits(unit(part.column(1).to_pylist(), dim))
                row, cell = np.nonzero(out)
                row, cell = np.concatenate([np.arange(len(part)), row]), np.concatenate([home, cell])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(home[row], pa.int32()), *(part.column(i).take(take) for i in range(3))], names=["cell", "home", "node", "raw", "w"])

    placed = scratch.stash(through(uniq.select("node", "raw", "w"), assign, "cell int, home int, node long, raw binary, w long"))
    # tasks: a block of a cell's own rows with a block of all its rows
    sizes = placed.groupBy("cell").agg(F.count(F.when(F.col("home") == F.col("cell"), 1)).alias("own"), F.count("*").alias("all")).collect()  # at most MAX_CELLS rows
    number = lambda name, most: F.create_map(*[F.lit(int(v)) for r in sizes for v in (r["cell"], -(-r[name] // most))])[F.col("cell")]
    n_own, n_all = number("own", block), number("all", others)
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own_block, all_block = F.pmod(F.xxhash64("node"), n_own).cast("int"), F.pmod(F.xxhash64("node", F.lit("all")), n_all).cast("int")
    cols = ["cell", "home", "node", "raw", "w"]
    mine = placed.where("home = cell").select(*cols, own_block.alias("i"), upto(n_all).alias("j"), F.lit(True).alias("mine"))
    rest = placed.where(n_own > 0).select(*cols, upto(n_own).alias("i"), all_block.alias("j"), F.lit(False).alias("mine"))
    tasks = mine.unionByName(rest)

    def compare(table: pa.Table) -> pa.Table:
        """Links between own rows and others, counted on the own side, and for visitors on both."""
        is_own = table.column("mine").to_numpy()
        if not is_own.any() or is_own.all():
            return PIECES.empty_table()
        cell = table.column("cell")[0].as_py()
        node, home, w = (table.column(i).to_numpy() for i in ("node", "home", "w"))
        own, other = np.nonzero(is_own)[0], np.nonzero(~is_own)[0]
        raw = table.column("raw")
        y = unit(raw.take(pa.array(own)).to_pylist(), dim)
        back = visits(y)[1]  # whether own rows visit other cells
        links, found = np.zeros(len(node), np.int64), []
        for at in range(0, len(other), 4096):
            sel = other[at : at + 4096]
            i, j = above(y, unit(raw.take(pa.array(sel)).to_pylist(), dim), threshold)
            far = home[sel][j]
            # pairs that meet in both cells count in the one of the lower number
            once = (far == cell) | ~(back[i, far] & (far < cell))
            i, j = own[i[once]], sel[j[once]]
            real = node[i] != node[j]
            i, j = i[real], j[real]
            np.add.at(links, i, w[j])
            out = home[j] != cell
            np.add.at(links, j[out], w[i[out]])
            found.append(np.stack([i, j]))
        return pieces_of(node, links, *np.concatenate(found, 1))

    if not sizes:
        return uniq.sparkSession.createDataFrame([], "node long, links long, root long")
    return tasks.groupBy("cell", "i", "j").applyInArrow(compare, "node long, links long, root long")


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each pair, and all that has their labels, the least label."""
    while len(i):
        a, b = label[i], label[j]
        diff = a != b
        i, j, a, b = i[diff], j[diff], a[diff], b[diff]
        if not len(i):
            return
        names, at = np.unique(label, return_inverse=True)
        to = names.copy()
        np.minimum.at(to, np.searchsorted(names, np.maximum(a, b)), np.minimum(a, b))
        label[:] = to[at]
