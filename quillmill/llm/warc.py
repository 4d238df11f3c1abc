"""Deterministic sharded WARC writer and reader.

Records are sorted by id and a hash of url and body, and cut into shards by the
running sum of their bytes, so files do not depend on how the input is
partitioned. Each shard is one task, which rolls files by compressed size. Tasks
write under temporary names that no other attempt shares; only files of attempts
that Spark committed are renamed to their final names, by tasks that may be run
again. The manifest, in parts of many files each, is renamed into place last.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, through

#: Fixed record fields.
DATE, VERSION, SOFTWARE = "2020-01-01T00:00:00Z", "WARC/1.1", "quillmill"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that a record has besides its payload, about; files in a part of the manifest; the place of null ids in the order.
HEADER_BYTES, PART_FILES, LAST = 700, 20_000, (1 << 63) - 1


def filesystem(uri: str):
    """pyarrow file system and path of a shared-folder URI, usable on any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def record_id(kind: str, page: int | None, mark: int | str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind}:{page}:{mark}:{copy}'.encode()).digest()[:16])}>"


def header_safe(value: str | None) -> str:
    """A header value on one line; control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value or "")


def record(page: int | None, u: int, url: str | None, payload: bytes, digest: str, first: tuple[int, int] | None, copy: int) -> bytes:
    """One uncompressed record; ``first`` (id and hash of the response) is set for a revisit."""
    length = len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
    block = http + (payload if first is None else b"")
    kind = "response" if first is None else "revisit"
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page, u, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_safe(url)}"]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id('response', *first, 0)}", f"WARC-Refers-To-Page: {first[0]}"]
    head += [f"WARC-Page: {'' if page is None else page}", f"WARC-Payload-Length: {length}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without time or name."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def shard_starts(keys: DataFrame, shard_bytes: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(key, u) of the first record of each shard, from rows (key, u, size): a row a shard comes to the driver, 16 bytes each.

    Rows are range-sorted; a partition's running sums start from the sums of those before it.
    """
    dealt = scratch.stash(keys.repartitionByRange("key", "u").withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for r in dealt.groupBy("part").agg(F.sum("size").alias("b")).orderBy("part").collect():  # a row a partition
        before[r["part"]] = total
        total += r["b"]
    if not before:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = keys.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    run = F.sum("size").over(Window.partitionBy("part").orderBy("key", "u").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("run", run).join(F.broadcast(offsets), "part")  # a row a partition
    shard = F.floor((F.col("before") + F.col("run") - F.col("size")) / shard_bytes)
    starts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("key", "u")).alias("at")).select("at.key", "at.u").distinct().collect()
    starts = sorted((r["key"], r["u"]) for r in starts)
    return np.array([k for k, _ in starts], np.int64), np.array([u for _, u in starts], np.int64)


def shard_of(key: np.ndarray, u: np.ndarray, starts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The last shard that starts at or before each (key, u)."""
    k, v = starts
    lo, hi = np.searchsorted(k, key, "left"), np.searchsorted(k, key, "right")
    out = lo - 1
    for at in np.unique(lo[hi > lo]):  # keys that a shard starts at
        rows = np.nonzero((lo == at) & (hi > lo))[0]
        out[rows] = at - 1 + np.searchsorted(v[at : hi[rows[0]]], u[rows], "right")
    return np.maximum(out, 0)


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", shard_bytes: int = 24 << 20, file_bytes: int = 8 << 20, least: int = 0) -> dict:
    """Write one record per row under ``out`` and return the manifest's head (parts, files, records, size).

    The payload is the body in UTF-8 (null: empty). Of rows with equal payloads of at
    least ``least`` bytes the smallest id (then the first by hash of url and body) is
    the response and the others are revisits of it; a row with a null id is always a
    response. Fully equal rows are told apart by a copy number in the record id and stay
    in one shard. An empty table gives a manifest without files. Extra columns are ignored.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
        rows = rows.withColumns({"key": F.coalesce("page", F.lit(LAST)), "u": F.xxhash64("url", "body")})
        # equal payloads: by length and SHA-256
        ids = scratch.stash(rows.select("page", "key", "u", F.octet_length("body").cast("long").alias("bytes"), F.unhex(F.sha2("body", 256)).alias("sig")))
        groups = ids.where((F.col("bytes") >= least) & F.col("page").isNotNull()).groupBy("sig", "bytes").agg(F.min(F.struct("page", "u")).alias("first"), F.count("*").alias("n")).where("n > 1")
        revisits = ids.where("page is not null").join(groups, ["sig", "bytes"]).select("key", "u", "sig", "first").distinct()
        starts = shard_starts(ids.select("key", "u", (F.col("bytes") + HEADER_BYTES).alias("size")), shard_bytes, scratch)
        cut = spark.sparkContext.broadcast(starts)  # 16 bytes a shard

        @F.pandas_udf("int")
        def shard(key: pd.Series, u: pd.Series) -> pd.Series:
            return pd.Series(shard_of(key.to_numpy(), u.to_numpy(), cut.value))

        body = rows.select("key", "u", F.lit(1).alias("kind"), "page", "url", "body", F.lit(None).cast("binary").alias("sig"), F.lit(None).cast("struct<page:long,u:long>").alias("first"))
        marks = revisits.select("key", "u", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("body"), "sig", "first")
        dealt = body.union(marks).withColumn("shard", shard("key", "u")).repartitionById(max(1, len(starts[0])), F.col("shard")).sortWithinPartitions("key", "u", "kind")
        run_id = uuid.uuid4().hex
        columns = dealt.select("shard", "key", "u", "kind", "page", "url", "body", "sig", F.col("first.page").alias("first_page"), F.col("first.u").alias("first_u"))
        done = scratch.stash(through(columns, writer(out, run_id, file_bytes), "shard long, n long, tmp string, records long, size long, sha256 string"))
        return commit(done, out, run_id)


def writer(out: str, run_id: str, file_bytes: int):
    """The task that writes one shard's files under temporary names; yields a row a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(out)
        attempt = uuid.uuid4().hex
        state: dict = {"shard": None, "file": None, "done": []}

        def close() -> None:
            if state["file"] is not None:
                state["file"].close()
                state["done"].append((state["shard"], state["n"], state["tmp"], state["records"], state["size"], state["sum"].hexdigest()))
                state["file"] = None

        def put(raw: bytes, records: int = 1) -> None:
            if state["file"] is None:
                state.update(n=state["n"] + 1, records=0, size=0, sum=hashlib.sha256())
                state["tmp"] = f"tmp-{run_id}/{attempt}-{state['shard']:06d}-{state['n']:04d}"
                store.create_dir(f"{root}/tmp-{run_id}", recursive=True)
                state["file"] = store.open_output_stream(f"{root}/{state['tmp']}", compression=None)
                info = f"software: {SOFTWARE}\r\nformat: {VERSION}\r\n".encode()
                name = f"{state['shard']:06d}-{state['n']:04d}"
                head = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id('warcinfo', None, name, 0)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}.warc.gz\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                put(member(head.encode() + info + b"\r\n\r\n"), 0)
            state["file"].write(raw)
            state["sum"].update(raw)
            state["size"] += len(raw)
            state["records"] += records
            if state["size"] >= file_bytes:
                close()

        place, marks, copy = None, {}, -1
        for b in batches:
            for shard, key, u, kind, page, url, text, sig, first_page, first_u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != state["shard"]:
                    close()
                    state.update(shard=shard, n=-1)
                if (key, u) != place:
                    place, marks, copy = (key, u), {}, -1
                if kind == 0:
                    marks[sig] = (first_page, first_u)
                    continue
                payload = text.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                first = marks.get(hashlib.sha256(payload).digest()) if marks and page is not None else None
                copy += 1
                put(member(record(page, u, url, payload, digest, None if first == (page, u) and copy == 0 else first, copy)))
        close()
        if state["done"]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*state["done"], strict=True)], names=["shard", "n", "tmp", "records", "size", "sha256"])

    return write


def moved(store, source: str, target: str) -> None:
    """Rename a file; done before, it is left as it is."""
    from pyarrow import fs

    if store.get_file_info(source).type != fs.FileType.NotFound:
        store.move(source, target)
    elif store.get_file_info(target).type == fs.FileType.NotFound:
        raise FileNotFoundError(source)


def commit(done: DataFrame, out: str, run_id: str) -> dict:
    """Rename the files that ``done`` lists and write the manifest: parts with a line a file, then its head."""
    from pyarrow import fs

    store, root = filesystem(out)
    store.create_dir(root, recursive=True)
    sums = done.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = filesystem(out)
        lines, parts = [], []
        for b in batches:
            for shard, n, tmp, records, size, sha256 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = f"{shard:06d}-{n:04d}.warc.gz"
                moved(store, f"{root}/{tmp}", f"{root}/{name}")
                lines.append(json.dumps({"file": name, "records": records, "size": size, "sha256": sha256}) + "\n")
        if lines:
            part = f"manifest-{lines[0][10:21]}.jsonl"
            tmp = f"{root}/{part}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(tmp) as f:
                f.write("".join(lines).encode())
            if store.get_file_info(f"{root}/{part}").type == fs.FileType.NotFound:
                store.move(tmp, f"{root}/{part}")
            else:  # by an earlier attempt, with the same lines
                store.delete_file(tmp)
            parts.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["part"])

    many = max(1, -(-sums["files"] // PART_FILES))
    listed = done.repartitionByRange(many, "shard", "n").sortWithinPartitions("shard", "n").select("shard", "n", "tmp", "records", "size", "sha256")
    parts = sorted(r["part"] for r in through(listed, rename, "part string").collect())  # a row for PART_FILES files
    head = {"version": VERSION, "parts": parts, **sums.asDict()}
    with store.open_output_stream(f"{root}/manifest-{run_id}.tmp") as f:
        f.write(json.dumps(head, indent=1).encode())
    store.move(f"{root}/manifest-{run_id}.tmp", f"{root}/manifest.json")
    if store.get_file_info(f"{root}/tmp-{run_id}").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/tmp-{run_id}")
    return head


def manifest_files(spark: SparkSession, out: str) -> DataFrame:
    """(file, records, size, sha256) of the archives under ``out``."""
    store, root = filesystem(out)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    schema = "file string, records long, size long, sha256 string"
    return spark.read.schema(schema).json([f"{out}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip archive, member by member."""
    z, left = zlib.decompressobj(31), b""
    raw = bytearray()
    while True:
        data = left or stream.read(1 << 20)
        left = b""
        if not data:
            if raw:
                raise ValueError("truncated archive")
            return
        raw += z.decompress(data)
        if z.eof:
            left = z.unused_data
            z = zlib.decompressobj(31)
            head, _, rest = bytes(raw).partition(b"\r\n\r\n")
            raw.clear()
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            if len(rest) != n + 4:
                raise ValueError("record length")
            yield fields, rest[:n]


def read_warc(spark: SparkSession, out: str, full: bool = False) -> DataFrame:
    """Records of the archives that the manifest under ``out`` lists, with digests checked.

    page_id, payload_bytes, payload_digest, record_type, refers_to; with ``full`` also
    url and payload (empty for revisits). Lost or altered files raise an error.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * full

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(out)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block in read_records(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if base64.b32encode(hashlib.sha1(block).digest()).decode() != h["WARC-Block-Digest"].removeprefix("sha1:") or h["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(h["WARC-Payload-Length"])):
                            raise ValueError(f"{name}: a digest differs")
                        page, to = h["WARC-Page"], h.get("WARC-Refers-To-Page")
                        rows.append((int(page) if page else None, int(h["WARC-Payload-Length"]), digest, h["WARC-Type"], int(to) if to else None, *((h["WARC-Target-URI"], payload) if full else ())))
                        size += len(payload) * full
                        if size > 16 << 20 or len(rows) >= 20_000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        n = 5 + 2 * full
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds[:n], strict=True)], names=names[:n])

    files = manifest_files(spark, out).select("file")
    many = min(max(1, files.count()), 100_000)
    return through(files.repartition(many), read, schema)
