"""Tables of one checkout; see :mod:`quillmill.sources.git_source` for many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.sources.git_calls import is_git_repo, safe_path, tracked_files
from quillmill.sources.git_source import read


def repository_files(spark: SparkSession, repo: str, shares: int = 1) -> DataFrame:
    """path, text of the tracked files that are text; bytes that are not UTF-8 are replaced."""
    return read(spark, [repo], "files", shares=shares).drop("repo")


def commits(spark: SparkSession, repo: str, author: str | None = None, most: int | None = 1000) -> DataFrame:
    """pos, sha, email, name, body of the newest commits without merges, of an author if given."""
    return read(spark, [repo], "log", author=author, most=most).drop("repo")


def blame(spark: SparkSession, repo: str, paths: list[str], most: int = 40, seconds: int = 10, shares: int = 1) -> DataFrame:
    """path, line_no, author of the first ``most`` paths; files that cannot be blamed are left out."""
    return read(spark, [repo], "blame", paths=paths[:most], seconds=seconds, shares=shares).drop("repo")


def history(spark: SparkSession, repo: str, paths: list[str], most: int = 300, shares: int = 1) -> tuple[DataFrame, DataFrame]:
    """(log, uncommitted): path, pos, author of the commits that touched each path, and the paths with changes that are not committed."""
    told = {"paths": paths, "shares": shares}
    return read(spark, [repo], "history", most=most, **told).drop("repo"), read(spark, [repo], "changes", **told).drop("repo")


def reviews(spark: SparkSession, repo: str, most: int = 30, export: str | None = None) -> DataFrame:
    """raw: the JSON list of the checkout's reviews, for ``mine_prs``; no row where there is none."""
    return read(spark, [repo], "reviews", most=most, export=export).drop("repo")


__all__ = ["blame", "commits", "history", "is_git_repo", "repository_files", "reviews", "safe_path", "tracked_files"]
