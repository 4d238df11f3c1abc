"""Who wrote what: author roll-up, touched files, owned lines and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import lines
from quillmill.operators.containment import linked
from quillmill.operators.running import running

#: Share of a block's lines that its author must own (a fixed value).
OWNED = 0.6


def email_matches(a: Column, b: Column) -> Column:
    """Equal, or one within the other; case and outer spaces do not count, empty never matches."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def author_rollup(commits: DataFrame, email: str = "email", name: str = "name", pos: str = "pos") -> DataFrame:
    """email, name, n: commits per address, with the first name in log order (a blank one becomes the address); most first."""
    key = F.lower(F.trim(F.col(email)))
    per = commits.where(F.coalesce(key, F.lit("")) != "").groupBy(key.alias("email")).agg(F.min_by(F.coalesce(F.trim(F.col(name)), F.lit("")), pos).alias("name"), F.count("*").alias("n"))
    return per.select("email", F.when(F.col("name") == "", F.col("email")).otherwise(F.col("name")).alias("name"), "n").orderBy(F.desc("n"), "email")


#: Log rows of a file that are looked at (a fixed value).
HISTORY = 300


def touched(files: DataFrame, log: DataFrame, author: str, path: str = "path", pos: str | None = None, uncommitted: DataFrame | None = None, local_user: str = "") -> DataFrame:
    """Files that a log row (path, author) of the author names, among the first HISTORY of the file if ``pos`` orders them; where the local user is the author, files of ``uncommitted`` (path) too."""
    seen = log
    if pos:
        seen = log.withColumn("_r", F.row_number().over(Window.partitionBy(path).orderBy(pos))).where(F.col("_r") <= HISTORY)
    mine = seen.where(email_matches(F.col("author"), F.lit(author))).select(path)
    if uncommitted is not None:
        mine = mine.unionByName(uncommitted.where(email_matches(F.lit(local_user), F.lit(author))).select(path))
    return files.join(mine.distinct(), path, "left_semi")


def touched_by_all(log: DataFrame, authors: DataFrame, path: str = "path") -> DataFrame:
    """(path, email): the files that log rows (path, author) name, with every one of ``authors`` (email) whom :func:`email_matches` takes for the author."""
    said = log.select(path, F.lower(F.trim("author")).alias("_b")).distinct()
    who = authors.select("email", F.lower(F.trim("email")).alias("_a")).distinct()
    pairs = linked(who.select(F.col("_a").alias("a")), said.select(F.col("_b").alias("b")))
    return said.join(pairs, said["_b"] == pairs["b"]).join(who, F.col("a") == F.col("_a")).select(path, "email").distinct()


def author_needles(authors: DataFrame, author: str) -> DataFrame:
    """needle: fragments of three characters or more that tell the author in a login or name.

    From the address, its local part, and the names in ``authors`` (email, name) of
    addresses that hold it. An empty author has none, which matches everyone.
    """
    mail = author.strip().lower()
    spark = authors.sparkSession
    own = spark.createDataFrame([(mail,), (mail.split("@")[0],)], "said string")
    names = authors.where(F.contains(F.lower(F.trim("email")), F.lit(mail))).select(F.col("name").alias("said"))
    found = own.unionByName(names).select(normal_author(F.col("said")).alias("needle")).where((F.length("needle") >= 3) & F.lit(bool(mail)))
    return found.distinct()


def display_name(authors: DataFrame, wanted: DataFrame, email: str = "email") -> DataFrame:
    """wanted (email) with name: that of ``authors`` (email, name), else the address itself."""
    known = authors.select(F.col("email").alias("_e"), F.col("name").alias("_n"))
    return wanted.join(known, wanted[email] == known["_e"], "left").withColumn("name", F.coalesce("_n", email)).drop("_e", "_n")


def mask_lines(files: DataFrame, blame: DataFrame, author: str, path: str = "path", text: str = "text") -> DataFrame:
    """files with masked: the lines of others emptied, so numbers stay; files without blame stay whole, lines beyond it are emptied."""
    own = F.coalesce(email_matches(F.col("author"), F.lit(author)), F.lit(False))
    per = blame.groupBy(path).agg(F.array_agg(F.when(own, F.col("line_no"))).alias("_own"))
    out = files.join(per, path, "left")
    kept = F.transform(lines(F.col(text)), lambda s, i: F.when(F.array_contains("_own", (i + 1).cast("int")), s).otherwise(""))
    return out.withColumn("masked", F.when(F.col("_own").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_own")


def owned_blocks(blocks: DataFrame, blame: DataFrame, author: str, path: str = "path", least: float = OWNED) -> DataFrame:
    """Blocks (lo, hi) of which the author wrote at least that share of blamed lines; files without blame pass, empty spans do not.

    The author's lines and all lines are counted up along each file; a block asks for
    the counts before its first line and at its last one.
    """
    own = email_matches(F.col("author"), F.lit(author)).cast("int")
    lines_at = blame.select(F.col(path).alias("_path"), (F.col("line_no") * 2).cast("long").alias("_at"), own.alias("_own"), F.lit(1).alias("_all"), F.lit(None).cast("long").alias("_id"), F.lit(None).cast("int").alias("_end"), F.lit(None).cast(blocks.schema).alias("_row"))
    asked = blocks.select(F.monotonically_increasing_id().alias("_id"), F.struct(*blocks.columns).alias("_row"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("_end"), (F.col("_row.lo") * 2 - 1).cast("long").alias("_at")), F.struct(F.lit(1).alias("_end"), (F.col("_row.hi") * 2 + 1).cast("long").alias("_at")))).alias("e")
    asks = asked.select(F.col(f"_row.{path}").alias("_path"), "_id", "_row", ends).select("_path", "e._at", F.lit(0).alias("_own"), F.lit(0).alias("_all"), "_id", "e._end", "_row")
    told = running(lines_at.unionByName(asks), ["_path"], "_at", {"owned": F.col("_own"), "lines": F.col("_all")}).where("_id is not null")
    sign = F.when(F.col("_end") == 1, 1).otherwise(-1)
    per = told.groupBy("_id").agg(F.first("_row").alias("_row"), F.first("_path").alias("_path"), F.sum(sign * F.col("owned")).alias("_owned"), F.sum(sign * F.col("lines")).alias("_lines"))
    blamed = blame.select(F.col(path).alias("_known")).distinct()
    out = per.join(blamed, F.col("_path") == F.col("_known"), "left")
    return out.where(F.col("_known").isNull() | ((F.col("_lines") > 0) & (F.col("_owned") / F.col("_lines") >= least))).select("_row.*")


def normal_author(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def author_matches(needles: list[str], login: Column, name: Column) -> Column:
    """Any needle within login|name; no needles match all."""
    hay = F.concat(normal_author(login), F.lit("|"), normal_author(name))
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(hay, n)) if needles else F.lit(True)
