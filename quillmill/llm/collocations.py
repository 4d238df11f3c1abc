"""Phrase collocation mining: distinct pieces with multiplicities, weighted n-gram counts by duckdb per hash bucket, parts looked up by shuffled requests.

Five steps. (1) Texts are cut into pieces of words; equal pieces of a language
become one row with a multiplicity, so copies of documents, lines and passages
are counted once from here on. (2) Words, then pairs, then windows of three or
four words are counted. A phrase cannot be more frequent than what is in it, so a
bitmap of the hashes of frequent words, and then of frequent pairs, tells tasks where a
phrase must end. (3) Each task sums the pairs or windows of its pieces and sends them, in order and compressed, to
the bucket of their hash (of their first three words). A frequent pair thus
costs a task one row, however often it occurs. (4) A bucket is counted by
duckdb, which spills to its task's own folder beyond its memory limit; what
occurs often enough is kept. (5) Every part and every longer phrase of a candidate is at
least as frequent as the candidate or asks for it, so all of them are in that
table: candidates send requests to the rows of their parts and of the phrases inside them.
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import UPPER, Scratch, through
from quillmill.session import spread

#: Bytes that end a piece (fixed by op13's contract); words are parted by blanks and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
CUT = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if chr(c) in UPPER else c for c in range(256))
#: Words of a phrase, at most; a candidate's least count; a longer phrase with so many hundredths of its count displaces it; phrases a language.
LONGEST, LEAST, COVER, FIRST = 4, 30, 80, 2000
#: Words that a task sums before it sends them on; bytes of pieces that a bucket stands for, about; duckdb's memory in a task; buckets that a task deals to at once.
RUN_WORDS, BUCKET_BYTES, DUCK_MB, DEAL = 2 << 20, 4 << 20, 256, 4096
#: Different words that a task counts before it sends them on; bits a frequent phrase in a bitmap, of a whole bitmap at most (16 MB; a fuller one lets more phrases pass and loses none), and of a row of it.
HELD, BITS, MOST_BITS, ROW_BITS = 300_000, 16, 1 << 27, 1 << 15


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, m): distinct pieces, words joined by single blanks, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                count: dict[tuple[str, bytes], int] = {}
                for lang, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if x.is_valid:
                        for piece in x.as_buffer().to_pybytes().translate(CUT).split(b"\n"):
                            key = lang, b" ".join([w for w in piece.split(b" ") if w])
                            if key[1]:
                                count[key] = count.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["lang", "piece", "m"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return through(spread(rows), run, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their first, second, .. words."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for x in words:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x
    return h ^ (h >> np.uint64(32))


def one_hash(word: int) -> int:
    """phrase_hash of one word."""
    h = (0x9E3779B97F4A7C15 + word) % (1 << 64)
    return h ^ (h >> 32)


def summed(size: int, word: np.ndarray, left: np.ndarray, m: np.ndarray, names: pa.Array, langs: pa.Array, hashes: np.ndarray) -> tuple[pa.Table, np.ndarray] | None:
    """(table of lang, g, w, m; hashes of lang and g) of the distinct phrases: g is the first ``size`` words (2 or 3), w after three the fourth (or empty).

    Per place: its word's number, how many words from it on can be a phrase (0 or
    more), its piece's multiplicity. Per number: its word, language and hash; 0 is
    no word.
    """
    at = np.flatnonzero(left >= size)
    if not len(at):
        return None
    pad = np.concatenate([word, np.zeros(4, word.dtype)]).astype(np.int64)
    key = pad[at] << 32 | pad[at + 1]
    if size == 3:
        last = np.where(left[at] > 3, pad[at + 3], 0)
        _, rank = np.unique(np.concatenate([key, pad[at + 2] << 32 | last]), return_inverse=True)
        key = rank[: len(at)] << 32 | rank[len(at) :]
    order = np.argsort(key, kind="stable")
    where = at[order]
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    total, first = np.add.reduceat(m[where], start), where[start]
    of = [pad[first + j] for j in range(size)]
    g = pc.binary_join_element_wise(*[names.take(pa.array(ids)) for ids in of], " ")
    w = names.take(pa.array(np.where(left[first] > 3, pad[first + 3], 0) if size == 3 else np.zeros(len(first), np.int64)))
    return pa.table([langs.take(pa.array(of[0])), g, w, pa.array(total)], names=["lang", "g", "w", "m"]), phrase_hash([hashes[ids] for ids in of])


def shipped(table: pa.Table, h: np.ndarray, buckets: int, twice: bool) -> Iterator[pa.RecordBatch]:
    """A row a bucket: (bucket, rows), the bucket's rows of the table compressed, with their hashes where they are dealt twice."""
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    if twice:
        table = table.append_column("h", pa.array(h))
    table = table.take(pa.array(order)).combine_chunks()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.slice(a, b - a))
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[order[a]])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "rows"])


def listed(batch: pa.RecordBatch) -> list[list]:
    """The columns lang, piece (in UTF-8) and m."""
    return [batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()]


def word_counts(found: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f): the words that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[bytes, int]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, count in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, piece, m in zip(*listed(batch), strict=True):
                count = seen.setdefault(lang, {})
                get = count.get
                for w in piece.split(b" "):
                    count[w] = get(w, 0) + m
            if sum(map(len, seen.values())) > HELD:
                yield from send()
                seen = {}
        yield from send()

    per = through(found, run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return per.where(F.col("f") >= least).select("lang", "phrase", F.lit(1).alias("k"), "f")


def word_hash(lang: str, word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def bitmap(phrases: DataFrame) -> bytes:
    """Bits at the hashes of phrases of one length, BITS a phrase (a power of two in all, MOST_BITS at most); in rows of ROW_BITS, so that no task holds it all."""
    bits = ROW_BITS
    n = phrases.count()
    while bits < min(MOST_BITS, BITS * n):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [[word_hash(lang, w.encode()) for w in p.split(" ")] for lang, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if said:
                at = (phrase_hash([np.array(x, np.uint64) for x in zip(*said, strict=True)]) % np.uint64(bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // ROW_BITS), pa.array(at % ROW_BITS)], names=["row", "at"])

    def one(table: pa.Table) -> pa.Table:
        part = np.zeros(ROW_BITS, np.uint8)
        part[np.asarray(table["at"])] = 1
        return pa.table([table["row"].slice(0, 1), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["row", "bits"])

    out = bytearray(bits // 8)
    for r in through(phrases.select("lang", "phrase"), run, "row long, at long").distinct().groupBy("row").applyInArrow(one, "row long, bits binary").collect():  # MOST_BITS at most
        out[r["row"] * ROW_BITS // 8 : (r["row"] + 1) * ROW_BITS // 8] = r["bits"]
    return bytes(out)


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(len(bits) * 8)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def partial_counts(found: DataFrame, size: int, often: list[bytes], buckets: int) -> DataFrame:
    """(bucket, rows): each task's own sums of pairs, or of windows, by bucket; ``often`` holds the bitmaps of the words, and of the pairs, that can be in them."""
    sent, twice = found.sparkSession.sparkContext.broadcast(often), buckets > DEAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x, np.uint8) for x in sent.value]

        class Numbers(dict):
            """Numbers of a language's words, from 1; a word that is not frequent is 0."""

            def __init__(self, lang: str, run: Words):
                super().__init__()
                self.lang, self.run = lang, run

            def __missing__(self, word: bytes) -> int:
                h = word_hash(self.lang, word)
                at = one_hash(h) % (8 * len(sent.value[0]))
                number = 0
                if sent.value[0][at >> 3] >> (7 - (at & 7)) & 1:
                    number = len(self.run.names)
                    self.run.names.append(word)
                    self.run.langs.append(self.lang)
                    self.run.hashes.append(h)
                self[word] = number
                return number

        class Words:
            """The pieces of a run."""

            def __init__(self) -> None:
                self.names, self.langs, self.hashes, self.ids = [b""], [""], [0], {}
                self.flat, self.size, self.m = array("i"), [], []

            def add(self, lang: str, words: list[bytes], m: int) -> None:
                if lang not in self.ids:
                    self.ids[lang] = Numbers(lang, self).__getitem__
                self.flat.extend(map(self.ids[lang], words))
                self.size.append(len(words))
                self.m.append(m)

            def send(self) -> Iterator[pa.RecordBatch]:
                word, count = np.frombuffer(self.flat, np.int32), np.array(self.size, np.int64)
                hashes = np.array(self.hashes, np.uint64)
                after = np.append(word[1:], 0)
                after[np.cumsum(count) - 1] = 0
                link = (word > 0) & (after > 0)  # whether the next word may follow in a phrase
                for pairs in bits[1:]:
                    at = np.flatnonzero(link)
                    link[at] = marked(pairs, phrase_hash([hashes[word[at]], hashes[after[at]]]))
                place = np.arange(len(word))
                stop = np.minimum.accumulate(np.where(link, len(word), place)[::-1])[::-1]
                left = np.where(word > 0, stop - place + 1, 0)
                m = np.repeat(np.array(self.m, np.int64), count)
                got = summed(size, word, left, m, pa.array(self.names, pa.binary()).cast(pa.string()), pa.array(self.langs), hashes)
                if got:
                    yield from shipped(*got, buckets, twice)

        run = Words()
        for batch in batches:
            for lang, piece, m in zip(*listed(batch), strict=True):
                run.add(lang, piece.split(b" "), m)
                if len(run.flat) >= RUN_WORDS:
                    yield from run.send()
                    run = Words()
        if run.size:
            yield from run.send()

    return through(found, run, "bucket long, rows binary")


def unshipped(blob: pa.Scalar) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(blob.as_buffer()) as source:
        yield from source


def dealt(parts: DataFrame, buckets: int) -> DataFrame:
    """parts in ``buckets`` partitions at least. Beyond DEAL buckets a task's rows of one would be few: then they go to DEAL groups first, whose tasks send them on."""
    if buckets <= DEAL:
        return parts.repartition(buckets, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for blob in batch.column(1):
                held += unshipped(blob)
                if sum(map(len, held)) >= RUN_WORDS:
                    yield from shipped(pa.Table.from_batches(held).drop_columns("h"), np.concatenate([np.asarray(x["h"]) for x in held]), buckets, False)
                    held = []
        if held:
            yield from shipped(pa.Table.from_batches(held).drop_columns("h"), np.concatenate([np.asarray(x["h"]) for x in held]), buckets, False)

    groups = parts.withColumn("bucket", F.pmod("bucket", F.lit(DEAL))).repartition(DEAL, "bucket")
    return through(groups, run, "bucket long, rows binary").repartition(buckets, "bucket")


def frequent(parts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f): the phrases of k words that occur ``least`` times; parts are dealt by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        kind = pa.schema([("lang", pa.string()), ("g", pa.string()), ("w", pa.string()), ("m", pa.int64())])
        rows = (x.select(kind.names) for batch in batches for blob in batch.column(1) for x in unshipped(blob))
        sent = pa.RecordBatchReader.from_batches(kind, rows)
        with tempfile.TemporaryDirectory(prefix="spill-") as spill, duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCK_MB}MB", "temp_directory": spill, "preserve_insertion_order": False}) as db:
            db.register("sent", sent)
            counted = f"""SELECT lang, CASE WHEN whole = 1 THEN g ELSE g || ' ' || w END AS phrase, CASE WHEN whole = 1 THEN length(g) - length(replace(g, ' ', '')) + 1 ELSE 4 END::INT AS k, f
                FROM (SELECT lang, g, w, grouping(w) AS whole, sum(m)::BIGINT AS f FROM sent GROUP BY GROUPING SETS ((lang, g, w), (lang, g)) HAVING sum(m) >= {least}) WHERE whole = 1 OR w <> ''"""
            yield from db.sql(counted).to_arrow_reader(1 << 16)

    return through(parts, run, "lang string, phrase string, k int, f long")


def inner(words, k: int) -> list:
    """The contiguous phrases of two words or more inside phrases of k words, themselves left out."""
    return [F.array_join(F.slice(words, at + 1, n), " ") for n in range(2, k) for at in range(k - n + 1)]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, cover: int = COVER, first: int = FIRST) -> DataFrame:
    """Each language's ``first`` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    a, l and r count a phrase and its two parts at the cut of the lowest score
    (ties: the fewest words before it); the score is 2000000 * a / (l + r) rounded
    down, n the words of the language. Phrases that occur under ``least`` times, and those inside a
    longer one that occurs ``cover`` hundredths as often or more, are left out. A null
    language is "und", a null or empty text has no words; equal rows count each; an
    empty table gives an empty result; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        found = scratch.stash(pieces(docs, lang_col, text_col))
        long = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "))) + 1
        words = scratch.stash(found.groupBy("lang").agg(F.sum(F.col("m") * long).alias("n"), F.sum(F.octet_length("piece")).alias("bytes")))
        volume = words.agg(F.sum("bytes")).first()[0] or 0
        buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-volume // BUCKET_BYTES))
        single = scratch.stash(word_counts(found, least))
        often = [bitmap(single)]
        pairs = scratch.stash(frequent(dealt(partial_counts(found, 2, often, buckets), buckets), least))
        often.append(bitmap(pairs))
        windows = scratch.stash(frequent(dealt(partial_counts(found, 3, often, buckets), buckets), least))
        return scratch.finish(ranked(single.unionByName(pairs).unionByName(windows), words.select("lang", "n"), cover, first))
    finally:
        scratch.drop()


def ranked(known: DataFrame, words: DataFrame, cover: int, first: int) -> DataFrame:
    """The result from frequent()'s rows and the words of each language."""
    longer = known.where("k > 2").withColumn("x", F.split("phrase", " "))
    spread_out = F.when(F.col("k") == 3, F.array(*inner(F.col("x"), 3))).otherwise(F.array(*inner(F.col("x"), LONGEST)))
    inside = longer.select("lang", F.explode(spread_out).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = known.where("k > 1").join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("f"))).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("x"))
    # a request for each part goes to the part's row
    side = lambda at, k: F.struct(F.lit(k).alias("cut"), F.lit(at == 0).alias("head"), F.array_join(F.slice(F.col("x"), 1, k) if at == 0 else F.slice(F.col("x"), k + 1, LONGEST), " ").alias("part"))
    asks = F.filter(F.array(*[side(at, k) for k in range(1, LONGEST) for at in (0, 1)]), lambda s: s["cut"] < F.size("x"))
    requests = left.select("lang", "phrase", "a", F.explode(asks).alias("s")).select("lang", "phrase", "a", "s.*")
    answers = requests.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = answers.groupBy("lang", "phrase", "cut").agg(F.first("a").alias("a"), F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    score = F.expr("(cast(2000000 as decimal(12,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)").cast("long")
    cuts = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("s")).select("lang", "phrase", "s.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = cuts.withColumn("rank", rank).where(F.col("rank") <= first)
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
