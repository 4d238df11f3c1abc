"""Folders of writing as tables of text samples and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import is_blank
from quillmill.operators.budget import BUDGET_CHARS
from quillmill.operators.triage import triage

# Accepted suffixes with their types, and limits of one run.
TEXT = {".txt", ".md", ".markdown", ".rst", ".org", ".tex", ".csv", ".json", ".eml", ".mbox", ".html", ".htm", ".vtt", ".srt", ".log", ".text"}
BINARY = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff"}
MAX_FILES, MAX_BYTES = 60, 8 << 20


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


class SourceError(ValueError):
    """A path that is not there, or holds nothing to read."""


def exists(spark: SparkSession, path: str) -> str | None:
    """``file``, ``folder`` or None, through Hadoop's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return None if not fs.exists(at) else "file" if fs.getFileStatus(at).isFile() else "folder"


def expand(spark: SparkSession, paths: str | list[str], max_files: int = MAX_FILES) -> DataFrame:
    """path, length, place of supported files: named ones, and those below folders, none with a dot-name on the way.

    First ones in order of the paths given and of name, each once. A path that is not
    there, a named file of another kind, and nothing found raise SourceError. Contents
    are not read.
    """
    out = None
    for n, path in enumerate([paths] if isinstance(paths, str) else paths):
        kind = exists(spark, path)
        if kind is None:
            raise SourceError(f"no such file or folder: {path}")
        if kind == "file" and "." + path.rpartition(".")[2].lower() not in TEXT | BINARY.keys():
            raise SourceError(f"{path}: unsupported file type")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.lit(n).alias("place"))
        hidden = F.col("path").rlike(r"/\.[^/]") if kind == "folder" else F.lit(False)
        found = found.where(suffix(F.col("path")).isin(*sorted(TEXT | BINARY.keys())) & ~hidden)
        out = found if out is None else out.unionByName(found)
    once = out.groupBy("path").agg(F.min("place").alias("place"), F.first("length").alias("length")).select("path", "length", "place").orderBy("place", "path").limit(max_files)
    if once.isEmpty():
        raise SourceError("no readable writing samples in those paths")
    return once


def load(spark: SparkSession, folder: str | list[str], max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(samples, files): texts (cut at max_bytes characters, blank ones left out) and binary files; a larger binary file raises an error."""
    rows = expand(spark, folder, max_files).collect()  # at most max_files paths
    places = spark.createDataFrame([(r["path"], i + 1) for i, r in enumerate(rows)], "path string, pos long")
    read = spark.read.format("binaryFile").load([r["path"] for r in rows]).join(F.broadcast(places), "path")
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    samples = read.where(suffix(F.col("path")).isin(*sorted(TEXT))).select("path", F.col("pos").alias("sample_id"), "pos", F.lit("file").alias("kind"), name.alias("origin"), F.left(text, F.lit(max_bytes)).alias("text"), F.lit(None).cast("string").alias("author"), F.lit(0).alias("tokens"))
    mime = F.create_map(*[F.lit(x) for kv in BINARY.items() for x in kv])[suffix(F.col("path"))]
    content = F.when(F.col("length") > max_bytes, F.raise_error(F.concat(F.col("path"), F.lit(" is too large"))).cast("binary")).otherwise(F.col("content"))
    files = read.where(suffix(F.col("path")).isin(*sorted(BINARY))).select("path", F.col("pos").alias("sample_id"), "pos", name.alias("filename"), mime.alias("mimetype"), content.alias("content"))
    return samples.where(~is_blank(F.col("text"))), files


def describe(files: DataFrame) -> DataFrame:
    """A line per binary file with its size in KB."""
    return files.select("filename", F.format_string("%s (%s, %d KB)", "filename", "mimetype", F.round(F.length("content") / 1024).cast("long")).alias("line"))


def load_triaged(spark: SparkSession, paths: str | list[str], max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, budget_chars: int = BUDGET_CHARS) -> DataFrame:
    """load, then triage: every file judged, none lost; the order of ids is that of expand."""
    samples, files = load(spark, paths, max_files, max_bytes)
    return triage(samples, files.drop("content"), budget_chars)
