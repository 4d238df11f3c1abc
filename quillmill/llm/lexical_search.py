"""Ranked lexical search: segments of compressed posting blocks with maximum impacts, searched by Block-Max WAND.

The index is a table. Each task cuts its documents into segments of bounded size
(documents and tokens), and writes a row a term and segment: the segment's
postings of that term in blocks of BLOCK documents. A block's document gaps and
term frequencies are variable bytes; beside them stand its first and last
document and its maximum impact, which can be read without decompression. One more
row a segment holds the ids and lengths of its documents.

A query moves over a segment in intervals between block borders, in which no
term changes its block. The shallow move gives, for each interval, the sum of its
blocks' maximum impacts; intervals whose sum is below the threshold are skipped
and their blocks stay compressed. The threshold is the score of rank k found so far;
a first pass over one segment in FIRST gives all others a threshold to start with.
Both bounds are exact, so the result is that of scoring every document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, ascii_lower, bound_batches, through
from quillmill.session import spread

#: A term is a maximal run of ASCII digits and letters and of characters beyond ASCII: fixed by op11's contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8 bytes: other bytes become blanks, A-Z lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Postings of a block; documents and tokens of a segment (a document that has more is a segment of its own).
BLOCK, SEG_DOCS, SEG_TOKENS = 128, 1 << 16, 4 << 20
#: One segment in so many is searched first and gives the others their threshold.
FIRST = 16
#: Terms of a block of queries, about; each block is sent to all tasks and is one pass over the index. Words of the queries that restrict an index, at most.
QUERY_TERMS, RESTRICT = 200_000, 500_000

INDEX = "seg long, term string, docs long, firsts array<int>, lasts array<int>, tops array<long>, ends array<int>, data binary, ids array<long>, lens array<int>"


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's score without its term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_norm(n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    return 100 - 50 + (50 * n * docs) // max(tokens, 1)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative values as variable bytes, and the number of bytes of each."""
    size = 1 + sum((values >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[start[has] + k] = ((values[has] >> 7 * k) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(data) else np.empty(0, np.int64)
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, start) if len(data) else np.empty(0, np.int64)


def segment(seg: int, ids: list[int], lens: list[int], codes: list[np.ndarray], terms: np.ndarray, docs: int, tokens: int) -> pa.RecordBatch:
    """The rows of one segment; codes are places in terms, an array a document."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    n = np.array(lens, np.int64)[order]
    code = np.concatenate([*codes, np.empty(0, np.int64)]).astype(np.int64)
    key, tf = np.unique(code << 16 | np.repeat(place, [len(c) for c in codes]), return_counts=True)
    code, doc = key >> 16, key & 0xFFFF
    top = impact(tf.astype(np.int64), length_norm(n, docs, tokens)[doc])
    start = np.flatnonzero(np.diff(code, prepend=-1))  # of each term
    size = np.diff(np.append(start, len(code)))
    blocks = -(-size // BLOCK)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(start, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))  # of each block
    end = np.minimum(at + BLOCK, np.repeat(start + size, blocks))
    gap = np.diff(doc, prepend=0)
    gap[at] = 0
    data, width = packed(np.stack([gap, tf], 1).reshape(-1))
    byte = np.concatenate([[0], np.cumsum(width)])[::2]  # before each posting
    of = np.append(first, len(at)).astype(np.int32)  # a term's blocks
    from_byte = byte[np.append(start, len(code))].astype(np.int32)
    listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.append(np.zeros(1, np.int32), of)), pa.array(x, kind))
    reach = (byte[end] - np.repeat(from_byte[:-1], blocks)) if len(at) else np.empty(0)
    blob = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(from_byte.tobytes()), pa.py_buffer(data.tobytes())])
    rows = len(start) + 1
    none = lambda x, kind: pa.concat_arrays([pa.array([x], kind), pa.nulls(rows - 1, kind)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, seg)),
            pa.concat_arrays([pa.nulls(1, pa.string()), pa.array([terms[c].decode("utf-8", "replace") for c in code[start]], pa.string())]),
            pa.array(np.append(len(ids), size)),
            listed(doc[at], pa.int32()),
            listed(doc[end - 1], pa.int32()),
            listed(np.maximum.reduceat(top, at) if len(at) else at, pa.int64()),
            listed(reach, pa.int32()),
            pa.concat_arrays([pa.nulls(1, pa.binary()), blob]),
            none(np.array(ids, np.int64)[order], pa.list_(pa.int64())),
            none(n.astype(np.int32), pa.list_(pa.int32())),
        ],
        names=["seg", "term", "docs", "firsts", "lasts", "tops", "ends", "data", "ids", "lens"],
    )


def corpus_size(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, over all rows that have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = tokens = 0
        for batch in batches:
            for x in batch.column(0):
                n = len(x.as_buffer().to_pybytes().translate(FOLD).split()) if x.is_valid else 0
                docs, tokens = docs + (n > 0), tokens + n
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([tokens])], names=["docs", "tokens"])

    seen = through(docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string")), run, "docs long, tokens long")
    row = seen.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
    return row["docs"] or 0, row["tokens"] or 0


def build_index(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """The index rows (INDEX) of all documents; ``size`` is corpus_size's.

    ``words`` restricts postings to those terms (lengths still count all). Rows with
    a null id are left out; rows with an equal id are documents of their own; null and
    termless texts hold no posting. Tasks keep one segment in memory. Segments are
    numbered by partition, so write the table before using it twice.
    """
    n_docs, n_tokens = size
    known = None if words is None else {w.encode(): k for k, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        terms: dict[bytes, int] = {} if known is None else known
        ids: list[int] = []
        lens: list[int] = []
        codes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = x.as_buffer().to_pybytes().translate(FOLD).split() if x.is_valid else []
                if not ws:
                    continue
                if ids and (len(ids) == SEG_DOCS or held + len(ws) > SEG_TOKENS):
                    yield segment(seg, ids, lens, codes, np.array(list(terms), object), n_docs, n_tokens)
                    seg, ids, lens, codes, held = seg + 1, [], [], [], 0
                    terms = {} if known is None else known
                if known is None:
                    for w in ws:
                        terms.setdefault(w, len(terms))
                    found = [terms[w] for w in ws]
                else:
                    found = [terms[w] for w in ws if w in terms]
                ids.append(key)
                lens.append(len(ws))
                codes.append(np.array(found, np.int32))
                held += len(ws)
        if ids:
            yield segment(seg, ids, lens, codes, np.array(list(terms), object), n_docs, n_tokens)

    table = spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return through(table, run, INDEX)


class Postings:
    """One term's blocks in a segment; blocks are decompressed when first asked for."""

    def __init__(self, docs: int, firsts: np.ndarray, lasts: np.ndarray, tops: np.ndarray, ends: np.ndarray, data: np.ndarray, norm: np.ndarray):
        self.docs, self.firsts, self.lasts, self.tops, self.ends, self.data, self.norm = docs, firsts, lasts, tops, ends, data, norm
        self.open = np.zeros(len(lasts), bool)
        self.doc = self.impact = np.empty(0, np.int64)

    def read(self, blocks: np.ndarray) -> np.ndarray:
        """Places of the blocks' postings in doc and impact."""
        if not len(self.doc):
            self.doc, self.impact = np.empty(self.docs, np.int64), np.empty(self.docs, np.int64)
        size = np.minimum(BLOCK, self.docs - BLOCK * blocks)
        new = ~self.open[blocks]
        if new.any():
            want = blocks[new]
            at = np.where(want > 0, self.ends[want - 1], 0)
            pairs = unpacked(np.concatenate([self.data[a:b] for a, b in zip(at, self.ends[want], strict=True)])).reshape(-1, 2)
            part = size[new]
            start = np.cumsum(part) - part
            total = np.cumsum(pairs[:, 0])
            doc = total - np.repeat(total[start] - self.firsts[want], part)
            to = spans(BLOCK * want, part)
            self.doc[to], self.impact[to] = doc, impact(pairs[:, 1], self.norm[doc])
            self.open[want] = True
        return spans(BLOCK * blocks, size)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each span, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def best(lists: list[tuple[int, Postings]], docs: int, k: int, theta: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, blocks opened): the k best documents of a segment with score of theta and above 0, by weights and postings."""
    border = np.unique(np.concatenate([p.lasts for _, p in lists]))
    bound = np.zeros(len(border), np.int64)
    block = []
    for w, p in lists:  # the shallow move of all intervals at once
        at = np.searchsorted(p.lasts, border)
        inside = at < len(p.lasts)
        at[~inside] = 0
        inside &= p.firsts[at] <= border
        bound += np.where(inside, w * p.tops[at], 0)
        block.append(np.where(inside, at, -1))
    order = np.argsort(-bound, kind="stable")
    score, chosen = np.zeros(docs, np.int64), np.zeros(docs, bool)
    found = np.empty(0, np.int64)
    at, step, opened = 0, 32, 0
    while at < len(order) and bound[order[at]] >= max(theta, 1):
        part = order[at : at + step]
        part = part[bound[part] >= max(theta, 1)]
        at, step = at + len(part), min(step * 2, 4096)
        low = np.where(part > 0, border[part - 1] + 1, 0)
        here = spans(low, border[part] + 1 - low)
        chosen[here] = True
        for (w, p), blocks in zip(lists, block, strict=True):
            want = np.unique(blocks[part])
            want = want[want >= 0]
            if len(want):
                opened += len(want)
                got = p.read(want)
                got = got[chosen[p.doc[got]]]
                score[p.doc[got]] += w * p.impact[got]
        chosen[here] = False
        found = np.concatenate([found, here[score[here] >= max(theta, 1)]])
        found = found[np.lexsort((found, -score[found]))][:k]
        if len(found) == k:
            theta = max(theta, int(score[found[-1]]))
    found = found[score[found] >= max(theta, 1)]
    return found, score[found], opened


def search(index: DataFrame, queries: DataFrame, size: tuple[int, int], k: int, scratch: Scratch) -> DataFrame:
    """(item_id, doc_id, score): for each query, the k best of each segment at least where they can be among its k best of all.

    ``queries`` holds (item_id, term, w); it is cut into blocks of about QUERY_TERMS rows, by a hash of item_id, a pass over the index each.
    """
    blocks = -(-queries.count() // QUERY_TERMS)
    out = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).where("w > 0")
        asked: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for r in part.collect():  # one block
            asked[r["item_id"]].append((r["term"], r["w"]))
        lead = F.pmod(F.xxhash64("seg"), F.lit(FIRST)) == 0
        wanted = index.join(F.broadcast(part.select("term").distinct()), "term", "left_semi").unionByName(index.where("term is null"))
        begun = scratch.stash(one_pass(wanted.where(lead), dict(asked), {}, size, k))
        rank = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        at_k = begun.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k)
        floor = {r["item_id"]: r["score"] for r in at_k.select("item_id", "score").collect()}  # a row a query of the block
        out += [begun, one_pass(wanted.where(~lead), dict(asked), floor, size, k)]
    empty = index.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for x in out:
        empty = empty.unionByName(x)
    return empty


def one_pass(index: DataFrame, asked: dict[int, list[tuple[str, int]]], floor: dict[int, int], size: tuple[int, int], k: int) -> DataFrame:
    n_docs, n_tokens = size

    def run(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        col = {c: rows.column(c).chunk(0) for c in rows.column_names}
        terms = col["term"].to_pylist()
        head = terms.index(None)
        ids = np.asarray(col["ids"][head].values)
        norm = length_norm(np.asarray(col["lens"][head].values).astype(np.int64), n_docs, n_tokens)
        array = lambda c, i: np.asarray(col[c][i].values).astype(np.int64)
        held = {t: Postings(col["docs"][i].as_py(), array("firsts", i), array("lasts", i), array("tops", i), array("ends", i), np.frombuffer(col["data"][i].as_buffer(), np.uint8), norm) for i, t in enumerate(terms) if t is not None}
        items, docs, scores = [], [], []
        for item, words in asked.items():
            lists = [(w, held[t]) for t, w in words if t in held]
            if lists:
                doc, score, _ = best(lists, len(ids), k, floor.get(item, 0))
                items.append(np.full(len(doc), item, np.int64))
                docs.append(ids[doc])
                scores.append(score)
        none = [np.empty(0, np.int64)]
        return pa.table([pa.array(np.concatenate(x + none)) for x in (items, docs, scores)], names=["item_id", "doc_id", "score"])

    bound_batches(index.sparkSession)
    return index.groupBy("seg").applyInArrow(run, "item_id long, doc_id long, score long")


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item; a repeated id has those of all its rows, a null id none."""
    said = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(TERM), 0)).alias("term"))
    return said.distinct()


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank, doc_id, score.

    Scores are sums over an item's terms, once each, of w * impact in 64-bit
    integers (see ``impact``, ``length_norm``; w is 1000 * ln((2N+2)/(2df+1))
    rounded down), ranked by score, ties by the smaller doc_id. Documents and
    items with a null id, and null, empty and termless texts, are left out; rows with
    an equal doc_id are ranked each for itself; rows with an equal item_id are one
    item. An item whose terms no document holds has no row; empty tables give an
    empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        size = corpus_size(docs, doc_id, doc_text)
        terms = scratch.stash(query_terms(items, item_id, item_text))
        words = [r["term"] for r in terms.select("term").distinct().limit(RESTRICT + 1).collect()]
        index = scratch.stash(build_index(docs, size, doc_id, doc_text, words if len(words) <= RESTRICT else None))
        held = index.where("term is not null").groupBy("term").agg(F.sum("docs").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(float(size[0])) + 2) / (2 * F.col("df") + 1))).cast("long")
        queries = scratch.stash(terms.join(held, "term").select("item_id", "term", weight.alias("w")))
        found = search(index, queries, size, k, scratch)
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
        return scratch.finish(found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    finally:
        scratch.drop()
