"""Calls of git and files of one checkout, on whichever machine runs them; any failure gives nothing."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

# Seconds a command may take, bytes of a file that is read, and of its start that is searched for NUL.
SECONDS, MAX_BYTES, SNIFF = 30, 1_000_000, 8000
# What a review export holds, and the most reviews that are asked for.
REVIEW_FIELDS, MOST_REVIEWS = "number,title,body,author,comments", 100


def said(folder: str, *command: str, seconds: int = SECONDS) -> str:
    """Output of a command in a folder, empty if it fails or takes too long."""
    try:
        done = subprocess.run(command, cwd=folder, capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def run(repo: str, *args: str, seconds: int = SECONDS) -> str:
    return said(repo, "git", *args, seconds=seconds)


def is_git_repo(path: str) -> bool:
    return os.path.isdir(path) and run(path, "rev-parse", "--is-inside-work-tree").strip() == "true"


def tracked_files(repo: str) -> list[str]:
    return [p for p in run(repo, "ls-files", "-z").split("\0") if p]


def safe_path(repo: str, name: str) -> str | None:
    """The real path of a tracked name; None if it is absolute, a link, no file, too large, or leads out of the folder."""
    if not name or name.startswith("/") or "\0" in name:
        return None
    root, at = Path(repo).resolve(), Path(repo) / name
    try:
        real = at.resolve(strict=True)
        fits = not at.is_symlink() and real.is_file() and real.is_relative_to(root) and real.stat().st_size <= MAX_BYTES
    except (OSError, RuntimeError, ValueError):
        return None
    return str(real) if fits else None


def read_text(repo: str, name: str) -> str | None:
    """A tracked file's text, bytes that are not UTF-8 replaced; None if it may not be read or holds NUL early on."""
    real = safe_path(repo, name)
    try:
        data = Path(real).read_bytes() if real else None
    except OSError:
        return None
    return None if data is None or b"\0" in data[:SNIFF] else data.decode("utf-8", "replace")


def log(repo: str, author: str | None, most: int | None, seconds: int = SECONDS) -> Iterator[tuple[int, str, str, str, str]]:
    """(pos, sha, email, name, body) of commits without merges, newest first, of an author if given; records that are not whole are left out."""
    who = [f"--author={author}", "--regexp-ignore-case", "--fixed-strings"] if author else []
    count = [f"--max-count={most}"] if most is not None else []
    for pos, record in enumerate(run(repo, "log", "--no-merges", *count, "--format=%H%x1f%aE%x1f%aN%x1f%B%x1e", *who, seconds=seconds).split("\x1e")):
        part = record.split("\x1f", 3)
        if len(part) == 4:
            yield pos, part[0].strip(), part[1].strip(), part[2], part[3]


def blame(repo: str, name: str, me: str, seconds: int = SECONDS) -> Iterator[tuple[int, str | None]]:
    """(line number, author) of a file; lines that are not committed are ``me``'s."""
    number, author = 0, None
    for line in run(repo, "blame", "--line-porcelain", "--", name, seconds=seconds).split("\n"):
        if line.startswith("\t"):
            number += 1
            yield number, author
        elif line.startswith("author-mail "):
            mail = line[12:].strip().removeprefix("<").partition(">")[0].lower()
            author = me if mail in ("not.committed.yet", "external.file") else mail


def reviews(repo: str, export: str | None, most: int) -> str:
    """The JSON list of a checkout's reviews: a file that holds it, or what the host's command line tool tells."""
    if export is not None:
        return read_text(repo, export) or ""
    return said(repo, "gh", "pr", "list", "--state", "all", "--limit", str(max(1, min(most, MOST_REVIEWS))), "--json", REVIEW_FIELDS)
