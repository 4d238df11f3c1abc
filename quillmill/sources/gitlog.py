"""Parsers of exported log, blame and review text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.running import running


def parse_log(df: DataFrame, raw: str = "raw") -> DataFrame:
    """pos, sha, email, name, body from records that end with \\x1e and have four fields between \\x1f."""
    rec = df.select(F.posexplode(F.split(raw, "\x1e")).alias("pos", "rec")).where(F.trim("rec") != "").withColumn("f", F.split("rec", "\x1f", 4)).where(F.size("f") == 4)
    return rec.select(F.col("pos").cast("long").alias("pos"), *(F.trim(F.col("f")[i]).alias(n) if i < 2 else F.col("f")[i].alias(n) for i, n in enumerate(("sha", "email", "name", "body"))))


def parse_blame(rows: DataFrame, local_user: str, path: str = "path", pos: str = "pos", line: str = "line", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """path, line_no, author from porcelain lines in order (pos is a whole number, different for each line of a path): an author-mail holds until the next; a TAB line is one line of text.

    What the lines say (no text) is read twice; ``keep``, such as a Scratch's stash, can hold it so that the lines are read once."""
    mail = F.lower(F.regexp_extract(line, r"^author-mail <?([^>]*)>?", 1))
    known = F.when(mail.isin("not.committed.yet", "external.file"), F.lit(local_user)).otherwise(mail)
    slim = rows.select(path, pos, F.when(F.col(line).startswith("author-mail "), known).alias("_mail"), F.col(line).startswith("\t").cast("int").alias("_text"))
    told = running(keep(slim), [path], pos, {"line_no": F.col("_text")}, {"author": F.col("_mail")})
    return told.where("_text = 1").select(path, F.col("line_no").cast("int").alias("line_no"), "author")
