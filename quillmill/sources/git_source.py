"""A data source over checkouts: tracked files, log, blame, history, changes, review exports.

``spark.read.format("checkouts")`` with a partition a repository (and share of its
paths). Executors run git and read files, so repositories must lie where executors see them;
the driver only holds the list of repositories. What fails gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.sources import git_calls

TABLES = {
    "files": "repo string, path string, text string",
    "log": "repo string, pos long, sha string, email string, name string, body string",
    "blame": "repo string, path string, line_no int, author string",
    "history": "repo string, path string, pos int, author string",
    "changes": "repo string, path string",
    "reviews": "repo string, raw string",
}
#: Tables whose rows belong to paths: their repositories may be cut into several partitions.
BY_PATH = {"files", "blame", "history", "changes"}


@dataclass
class Share(InputPartition):
    """One of ``of`` shares of a repository's paths."""

    repo: str
    number: int
    of: int


class CheckoutReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "files")
        self.repos = json.loads(options["repos"])
        self.shares = int(options.get("shares", "1")) if self.table in BY_PATH else 1
        self.paths = json.loads(options["paths"]) if "paths" in options else None
        self.author, self.most, self.seconds = options.get("author"), options.get("most"), int(options.get("seconds", str(git_calls.SECONDS)))
        self.export = options.get("export")

    def partitions(self) -> list[Share]:
        return [Share(repo, i, self.shares) for repo in self.repos for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator[tuple]:
        repo = partition.repo
        if not git_calls.is_git_repo(repo):
            return
        for row in getattr(self, self.table)(repo, partition):
            yield (repo, *row)

    def wanted(self, repo: str, share: Share) -> list[str]:
        names = self.paths if self.paths is not None else git_calls.tracked_files(repo)
        return names[share.number :: share.of]

    def files(self, repo: str, share: Share) -> Iterator[tuple]:
        for name in self.wanted(repo, share):
            text = git_calls.read_text(repo, name)
            if text is not None:
                yield name, text

    def log(self, repo: str, share: Share) -> Iterator[tuple]:
        yield from git_calls.log(repo, self.author, int(self.most) if self.most else None, self.seconds)

    def blame(self, repo: str, share: Share) -> Iterator[tuple]:
        me = git_calls.run(repo, "config", "--get", "user.email").strip().lower()
        for name in self.wanted(repo, share):
            for number, author in git_calls.blame(repo, name, me, self.seconds):
                yield name, number, author

    def history(self, repo: str, share: Share) -> Iterator[tuple]:
        for name in self.wanted(repo, share):
            said = git_calls.run(repo, "log", "--follow", f"--max-count={self.most or 300}", "--format=%aE", "--", name, seconds=self.seconds)
            for i, who in enumerate(said.splitlines()):
                if who.strip():
                    yield name, i, who.strip()

    def changes(self, repo: str, share: Share) -> Iterator[tuple]:
        changed = {line[3:] for line in git_calls.run(repo, "status", "--porcelain", "-z", "--no-renames", "--untracked-files=all").split("\0") if line}
        for name in changed if self.paths is None and share.number == 0 else [n for n in self.wanted(repo, share) if n in changed] if self.paths is not None else []:
            yield (name,)

    def reviews(self, repo: str, share: Share) -> Iterator[tuple]:
        raw = git_calls.reviews(repo, self.export, int(self.most or 30))
        if raw:
            yield (raw,)


class Checkouts(DataSource):
    """Options: repos (a JSON list of folders), table (one of TABLES), shares, paths (a JSON list), author, most, seconds, export (a file in the checkout that holds the reviews)."""

    @classmethod
    def name(cls) -> str:
        return "checkouts"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "files")]

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("table", "files") not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}")
        return CheckoutReader(dict(self.options))


def read(spark: SparkSession, repos: list[str], table: str, **options) -> DataFrame:
    """A table of TABLES over all ``repos``."""
    spark.dataSource.register(Checkouts)
    told = {k: json.dumps(v) if k == "paths" else str(v) for k, v in options.items() if v is not None}
    return spark.read.format("checkouts").options(repos=json.dumps(repos), table=table, **told).load()
