"""Secret scan: fixed patterns, and strings in sensitive context that compression knows nothing of.

Besides three base patterns, strings near a sensitive word are candidates. A
candidate's novelty is what it adds to the compressed size of the text around it, per
byte, under a zstandard dictionary of the corpus's identifiers: words, names and
repetitions of what stands nearby compress to little, keys and random passwords do not.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch, through
from quillmill.session import spread

Spans = list[tuple[str, int, int]]
KINDS = ("assign", "access", "hex")
#: Base patterns and least lengths: fixed by op12's contract. ASSIGN reads text whose A-Z are lower-cased; its length is that of the group.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ASSIGN_WORDS, ASSIGN_LEAST = (b"passw", b"secret", b"token", b"api"), 12
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]{14,}"), re.compile(rb"[0-9a-f]{16,}")
#: Words after which, or with which, a secret may stand (text lower-cased).
SENSITIVE = re.compile(rb"pass(?:w|phrase|code)|passwd|pwd|secret|token|api_?key|access_?key|private_?key|secret_?key|_key\b|\bkey\b|auth|bearer|credential|client_?id|login|signature|webhook|cookie|session_?id|\bsalt\b|\bgh[opsu]_|\bxox[abprs]-|\bsk[-_]|\beyj")
#: A candidate, and how far behind a sensitive word one begins.
CANDIDATE, REACH = re.compile(rb"[A-Za-z0-9+/_.~!@#$%^&*-]{12,}={0,2}"), 64
EDGE = b".!#$%^&*"
#: Bytes of text before and after a candidate that it is measured against; compressed bytes a byte from which it is reported; zstandard's level.
AROUND, NOVEL, LEVEL = 512, 0.9, 19
#: Bytes of the dictionary that go before what is measured, so that a block is never stored as it is; bytes measured at once, too few for letter statistics of their own.
LEAD, AT_ONCE = 128, 48
#: Bytes of the identifier dictionary, and identifiers that are looked at for it, from the most frequent on.
DICT_BYTES, DICT_WORDS = 1 << 16, 20_000
#: Runs of these are words; a word is an identifier if it has letters and underscores only and occurs so often at least.
WORDS, IDENTIFIER, OFTEN = bytes(c if chr(c).isalnum() and c < 128 or c in b"_+/=!@#$%^&*~" or c >= 128 else 32 for c in range(256)), re.compile(rb"[A-Za-z_\x80-\xff]{4,24}"), 5
#: Identifiers that a task counts before it sends them on.
HELD = 300_000


def base_spans(text: bytes) -> Spans:
    """Base spans in byte offsets, by start and then kind as listed."""
    out: Spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(low) if len(m[1]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Strings on the line of a sensitive word that hold it or begin at most REACH bytes behind it."""
    low, out, done = text.lower(), [], 0
    for word in SENSITIVE.finditer(low):
        line = low.find(b"\n", word.end())
        last = min(word.end() + REACH, line if line >= 0 else len(text))
        at = max(done, word.start())
        while (m := CANDIDATE.search(text, at)) and m.start() < last:
            s, e = m.span()
            at = done = e
            while e > s and text[e - 1] in EDGE:
                e -= 1
            while s < e and text[s] in EDGE:
                s += 1
            if e - s >= 12:
                out.append((s, e))
    return out


def novelty(text: bytes, s: int, e: int, known: bytes) -> float:
    """Bytes that the string adds to a compressed text, per byte of its own, given the identifiers and the text around it."""
    around = known + text[e : e + AROUND] + text[max(0, s - AROUND) : s]
    zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(around, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
    lead = around[:LEAD]
    none = len(zstd.compress(lead))
    return sum(len(zstd.compress(lead + text[i : min(e, i + AT_ONCE)])) - none for i in range(s, e, AT_ONCE)) / (e - s)


def mixed(word: bytes) -> bool:
    """Whether a string has digits and others, or letters of both cases and signs."""
    digit, lower, upper, sign = (re.search(x, word) is not None for x in (rb"[0-9]", rb"[a-z]", rb".[A-Z]", rb"[^A-Za-z0-9]"))
    return digit + lower + upper + sign >= (2 if digit else 3)


def novel_spans(text: bytes, base: Spans, known: bytes) -> Spans:
    """Candidates that no base span meets, of mixed characters, whose novelty is NOVEL or more."""
    free = [(s, e) for s, e in candidates(text) if not any(a < e and s < b for _, a, b in base)]
    return [("novel", s, e) for s, e in free if mixed(text[s:e]) and novelty(text, s, e, known) >= NOVEL]


def in_code_points(text: bytes, spans: Spans) -> Spans:
    at = n = 0
    place = {}
    for x in sorted({x for _, s, e in spans for x in (s, e)}):
        n += len(text[at:x].decode("utf-8", "replace"))
        at = place[x] = x
        place[x] = n
    return [(kind, place[s], place[e]) for kind, s, e in spans]


def said(spans: Spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def identifier_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The most frequent identifiers (letters and underscores, 4 to 24 bytes) of all texts, DICT_BYTES at most, the most frequent last.

    Strings with digits or signs never enter, so that a key in many copies stays unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            words = [w for w in seen if IDENTIFIER.fullmatch(w)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "c"])

        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    seen.update(x.as_buffer().to_pybytes().translate(WORDS).split())
                    if len(seen) > HELD:
                        yield send()
                        seen.clear()
        yield send()

    with Scratch(docs.sparkSession) as scratch:
        counts = through(spread(docs.select(F.col(f"`{text_col}`").cast("string"))), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
        counts = scratch.stash(counts.withColumn("worth", F.col("c") * (F.octet_length("word") - 3)).withColumn("octave", F.floor(8 * F.log2("worth")).cast("int")))
        bound, total = 1 << 30, 0
        for r in counts.groupBy("octave").agg(F.count("*").alias("n")).orderBy(F.desc("octave")).collect():  # at most 8 x 63 rows
            total += r["n"]
            if total > DICT_WORDS:
                break
            bound = r["octave"]
        best = sorted(counts.where(F.col("octave") >= bound).collect(), key=lambda r: (-r["worth"], r["word"]))  # DICT_WORDS rows of 24 bytes at most
    out: list[bytes] = []
    size = 0
    for r in best:
        size += len(r["word"]) + 1
        if size > DICT_BYTES:
            break
        out.append(bytes(r["word"]))
    return b" ".join(reversed(out))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in each whole text: ``id_col``, n_assign, n_access, n_hex (base spans), base_sha256, spans, n_novel.

    Spans are ``kind:start:end`` in code points, by start and then kind; the method's kind
    is ``novel``. A null text counts as empty and has none. Repeated rows and ids
    give repeated results, a null id stays; an empty table gives an empty result;
    extra columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, text_col))  # DICT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(1):
                text = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                base = base_spans(text)
                more = novel_spans(text, base, known.value)
                both = in_code_points(text, sorted(base + more, key=lambda x: (x[1], (*KINDS, "novel").index(x[0]))))
                own = said([x for x in both if x[0] in KINDS])
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS), hashlib.sha256(own.encode()).hexdigest(), said(both), len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, types)], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    kind = docs.schema[id_col].dataType.simpleString()
    return through(spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))), run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
