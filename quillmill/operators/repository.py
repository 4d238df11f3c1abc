"""Miners over exported repository tables: commits, documents, comments, pull requests."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import let, lines, squeeze_blank_lines, strip
from quillmill.operators.attribution import author_matches, mask_lines, owned_blocks
from quillmill.operators.budget import BUDGET_CHARS, quotas, trim_to_quota
from quillmill.operators.cleaning import blank_block_column, clean_lines, clean_markdown, distinct_key, doc_priority, is_noise_commit, looks_like_prose, strip_trailers
from quillmill.operators.comments import comment_blocks, suffix_of

# Limits, skipped names and folders, generated marks.
COMMITS, DOCS, COMMENTS, PRS = 200, 20, 150, 30
MIN_COMMIT, MIN_DOC, MIN_PR = 40, 80, 80
NOT_WRITTEN = (".pyi", ".d.ts", ".min.js", "_pb2.py", ".pb.go")
DOC_SUFFIXES = [".md", ".markdown", ".mdx", ".rst", ".txt"]
SKIP_NAME = r"(?i)^(?:changelog|change_log|changes|history|news|license|copying|notice|authors|contributors|codeowners|patents|third[-_]party[-_]notices|requirements[\w.-]*|constraints)\b"
VENDOR = r"(?i)(?:^|/)(?:node_modules|vendor|third_party|thirdparty|site-packages|dist|build|\.venv|venv|target|\.tox|__pycache__|migrations|fixtures|locales?|i18n|\.github/ISSUE_TEMPLATE|\.github/PULL_REQUEST_TEMPLATE)(?:/|$)"
GENERATED = r"(?i)do not edit|@generated|code generated by|autogenerated|auto-generated|generated by (?:protoc|swagger|openapi|thrift|sqlc|prisma|the protocol)"


def first_wins(df: DataFrame, key, pos: str) -> DataFrame:
    """The first row of each key in order of pos; a key of many rows costs partial minima only."""
    first = F.min(F.struct(F.col(pos).alias("_pos"), F.struct(*df.columns).alias("_row"))).alias("_first")
    return df.groupBy(key.alias("_key")).agg(first).select("_first._row.*")


def mine_commits(commits: DataFrame, limit: int | None = COMMITS, min_chars: int = MIN_COMMIT) -> DataFrame:
    """pos, kind, origin, text, author from (pos, sha, email, name, body), newest first; commits beyond 5 x limit are never seen (None: no limit)."""
    seen = commits if limit is None else commits.orderBy("pos").limit(5 * limit)
    subject = let(lines(strip(F.coalesce("body", F.lit("")))), lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit("")))
    good = seen.where(~is_noise_commit(subject, F.trim("email"), F.col("name"))).withColumn("text", strip_trailers(F.col("body"))).where(F.length("text") >= min_chars)
    out = first_wins(good, distinct_key(F.col("text")), "pos").orderBy("pos")
    out = out if limit is None else out.limit(limit)
    return out.select("pos", F.lit("commit").alias("kind"), F.concat(F.lit("git log "), F.left(F.trim("sha"), F.lit(7))).alias("origin"), "text", F.nullif(F.trim("email"), F.lit("")).alias("author"))


def mine_docs(files: DataFrame, blame: DataFrame | None = None, author: str | None = None, limit: int = DOCS) -> DataFrame:
    """pos, kind, origin, text, author from (path, text): prose documents, important ones first."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    good = files.where(suffix_of(F.col("path")).isin(*DOC_SUFFIXES) & ~F.col("path").rlike(VENDOR) & ~name.rlike(SKIP_NAME) & ~F.left("text", F.lit(2000)).rlike(GENERATED))
    if author and blame is not None:
        blanked = good.withColumn("text", blank_block_column(F.col("text")))
        good = mask_lines(blanked, blame, author).withColumn("text", clean_lines(lines(F.col("masked")))).drop("masked")
    else:
        good = good.withColumn("text", clean_markdown(F.col("text")))
    order = F.struct(doc_priority(F.col("path")).alias("p"), F.col("path").alias("q"))
    out = good.where(F.length("text") >= MIN_DOC).withColumn("pos", order).orderBy("pos").limit(limit)
    return out.select(F.row_number().over(Window.orderBy("pos")).cast("long").alias("pos"), F.lit("doc").alias("kind"), F.col("path").alias("origin"), "text", F.lit(author).alias("author"))  # at most limit rows


def mine_comments(files: DataFrame, blame: DataFrame | None = None, author: str | None = None, limit: int = COMMENTS) -> DataFrame:
    """pos, kind, origin, text, author: prose comment blocks of source files, each text once."""
    written = reduce(and_, [~F.endswith("path", F.lit(s)) for s in NOT_WRITTEN])
    good = files.where(written & ~F.col("path").rlike(VENDOR) & ~F.left("text", F.lit(4000)).rlike(GENERATED)).select("path", "text")
    found = comment_blocks(good).withColumn("block", strip(squeeze_blank_lines(F.col("block"))))
    if author and blame is not None:
        found = owned_blocks(found, blame, author)
    found = found.where(looks_like_prose(F.col("block"))).withColumn("pos", F.struct("path", "pos"))
    out = first_wins(found, distinct_key(F.col("block")), "pos").orderBy("pos").limit(limit)
    return out.select(F.row_number().over(Window.orderBy("pos")).cast("long").alias("pos"), F.lit("comment").alias("kind"), F.col("path").alias("origin"), F.col("block").alias("text"), F.lit(author).alias("author"))  # at most limit rows


PR = "array<struct<number:long,title:string,body:string,author:struct<login:string,name:string>,comments:array<struct<author:struct<login:string,name:string>,body:string>>>>"


def mine_prs(exports: DataFrame, needles: list[str], limit: int = PRS, raw: str = "raw", order: str | None = None) -> DataFrame:
    """pos, kind, origin, text, author from JSON lists of pull requests: bodies, then comments, of the author; several lists in order of a column."""
    first = F.col(order).alias("list_pos") if order else F.lit(0).alias("list_pos")
    prs = exports.select(first, F.posexplode(F.from_json(raw, PR)).alias("pr_pos", "p")).withColumn("pr_pos", F.struct("list_pos", "pr_pos")).drop("list_pos")
    body = prs.select("pr_pos", F.lit(0).alias("part"), F.lit(0).alias("at"), F.col("p.number").alias("number"), F.col("p.author").alias("who"), F.col("p.body").alias("body"))
    notes = prs.select("pr_pos", F.lit(1).alias("part"), F.posexplode("p.comments").alias("at", "c"), F.col("p.number").alias("number")).select("pr_pos", "part", "at", "number", F.col("c.author").alias("who"), F.col("c.body").alias("body"))
    both = body.unionByName(notes).where(author_matches(needles, F.col("who.login"), F.col("who.name"))).withColumn("text", clean_markdown(F.col("body"))).where(F.length("text") >= MIN_PR)
    out = both.withColumn("pos", F.struct("pr_pos", "part", "at")).orderBy("pos").limit(limit)
    return out.select(F.row_number().over(Window.orderBy("pos")).cast("long").alias("pos"), F.lit("pr").alias("kind"), F.concat(F.lit("PR #"), F.col("number").cast("string")).alias("origin"), "text", F.col("who.login").alias("author"))  # at most limit rows


def mine_all(parts: list[DataFrame], budget_chars: int = BUDGET_CHARS) -> DataFrame:
    """The miners' rows in order, trimmed to each kind's quota if they exceed the budget."""
    rows = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("part", F.lit(i)))
    totals = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum(F.length("text")).alias("n")).collect()}  # four kinds
    if sum(totals.values()) > budget_chars:
        rows = trim_to_quota(rows, "kind", F.length("text"), "pos", quotas(totals, budget_chars))
    return rows.orderBy("part", "pos").drop("part")


__all__ = ["first_wins", "mine_all", "mine_comments", "mine_commits", "mine_docs", "mine_prs"]
