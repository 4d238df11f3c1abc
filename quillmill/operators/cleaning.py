"""Cleaning of documents and commit messages, and tests for prose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import WS, collapse, is_blank, let, lines, rstrip, squeeze_blank_lines, strip

# Patterns and word lists that results must agree with.
TRAILERS = ["co-authored-by", "signed-off-by", "claude-session", "acked-by", "reviewed-by", "tested-by", "reported-by", "suggested-by", "helped-by", "cc", "change-id", "pr-link", "differential revision", "reviewed-on", "git-svn-id", "bug"]
GENERATED_LINE = r"\x{1F916}|generated with \[?claude code|generated with \[?cursor|co-?authored-?by|https?://claude\.ai/code|claude-session|noreply@anthropic\.com"
NOISE_SUBJECTS = [
    r"^merge\b", r"^merge pull request\b", r"^revert\b", r"^bump\b", r"^\w+\(deps(?:-dev)?\)", r"^(?:chore|ci|build|style)\b[^:]*:\s*(?:bump|update|upgrade|pin)\b",
    r"^(?:chore|ci|build)\b[^:]*:\s*(?:lint|format|prettier|reformat)\b", r"^update\s+(?:dependenc|changelog|lock|submodule|snapshot|package-lock)", r"^upgrade\s+dependenc",
    r"^(?:release|version|chore\(release\))\b", r"^v?\d+\.\d+(?:\.\d+)?(?:[-+][\w.]+)?\s*$", r"^\[?(?:automated|auto|bot|skip ci)\]?\b",
    r"^(?:apply|run)\s+(?:black|prettier|gofmt|rustfmt|isort|clang-format)", r"^regenerate\b", r"^(?:wip|tmp|temp|test|asdf|foo|stuff|misc|minor|cleanup|typo|fixes|fix)\s*[.!]?$",
    r"^(?:fix|fixed)\s+typos?\b", r"^initial commit\s*$", r"^(?:add|update)\s+\.?gitignore\s*$", r"^(?:merge branch|merge remote-tracking)\b",
]
BOT_AUTHOR = r"dependabot|renovate|github-actions|greenkeeper|snyk-bot|imgbot|pre-commit-ci|allcontributors|weblate|crowdin|\[bot\]|(?:^|[^a-z])bot@"
BADGE = r"^\s*(?:\[?!\[[^\]]*\]\((?:[^)]*)\)\]?(?:\([^)]*\)|\[[^\]]*\])?\s*|\[?!\[[^\]]*\]\[[^\]]*\]\]?(?:\[[^\]]*\])?\s*)+$"
LINK_REF = r"^\s*\[[^\]]+\]:\s*\S+"
RULE_LINE = r"\A[-=~^_*+|: ]{3,}\z"
INLINE = [(r"!\[[^\]]*\]\([^)]*\)", ""), (r"!\[[^\]]*\]\[[^\]]*\]", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\[[^\]]*\]", "$1"), (r"<[^>\n]{1,200}>", ""), (r"`{1,3}([^`]*)`{1,3}", "$1"), (r"^#{1,6}\s*", "")]
LICENSE = r"copyright\s+(?:\(c\)|\d{4}|©)|spdx-license-identifier|licensed under|permission is hereby granted|all rights reserved|apache license|gnu general public|redistribution and use in source"
PRAGMA = r"^(?:noqa|type:|pylint:|pyright:|mypy:|flake8:|ruff:|pragma:|fmt:|eslint|prettier|ts-ignore|@ts-|tslint|nolint|coding[:=]|!|-\*-|@ts-expect-error|istanbul |c8 |codegen|region\b|endregion\b)"
URL_ONLY = r"^\s*(?:see\s+)?https?://\S+\s*$"
PROSE_CHARS = 60
#: Blocks of a document, blanked in this order; each leaves its line ends.
BLOCKS = [
    (r"\A---\n.*?\n---\n", re.S),
    (r"^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", re.S | re.M),
    (r"^[ \t]*(?:```|~~~).*\Z", re.S | re.M),
    (r"^\.\. \w+::.*(?:\n(?:[ \t].*|\s*))*", re.M),
    (r"<!--.*?-->", re.S),
    (r"<(script|style)\b.*?</\1>", re.S | re.I),
]
COMPILED_BLOCKS = [re.compile(p, f) for p, f in BLOCKS]
IU = "(?iU)"


def strip_trailers(body: Column) -> Column:
    """A commit message without trailers and tool lines; blank lines collapse to one."""
    keys = r"^\s*(?:" + "|".join(TRAILERS) + r")\s*:|^\s*[A-Za-z][A-Za-z-]*-by\s*:"
    machine = lambda s: s.rlike(f"{IU}{GENERATED_LINE}|{keys}")
    kept = F.filter(lines(F.coalesce(body, F.lit(""))), lambda s: ~machine(strip(s)))
    text = F.array_join(F.transform(kept, lambda s: F.when(is_blank(s), "").otherwise(rstrip(s))), "\n")
    return strip(squeeze_blank_lines(text))


def is_noise_commit(subject: Column, email: Column, name: Column) -> Column:
    bot = F.coalesce(email, F.lit("")).rlike("(?i)" + BOT_AUTHOR) | F.coalesce(name, F.lit("")).rlike("(?i)" + BOT_AUTHOR)
    s = strip(F.coalesce(subject, F.lit("")))
    return bot | (s == "") | s.rlike(IU + "|".join(f"(?:{p})" for p in NOISE_SUBJECTS))


def blank_blocks(text: str) -> str:
    """Front matter, fences, directives, comments and script or style blocks as their line ends only."""
    for p in COMPILED_BLOCKS:
        text = p.sub(lambda m: "\n" * m[0].count("\n"), text)
    return text


@F.pandas_udf(T.StringType())
def _blank_blocks(texts: pd.Series) -> pd.Series:
    return texts.map(blank_blocks, na_action="ignore")


#: Where no block can start, Python is not needed.
HAS_BLOCK = r"(?i)\A---\n|```|~~~|(?m:^\.\. )|<!--|<script|<style"


def blank_block_column(text: Column) -> Column:
    return F.when(text.rlike(HAS_BLOCK), _blank_blocks(text)).otherwise(text)


def clean_lines(a: Column) -> Column:
    """The text of document lines without badges, link references, tables, rules, indented code and inline markup."""

    def inline(s: Column) -> Column:
        for p, to in INLINE:
            s = F.regexp_replace(s, p, to)
        return strip(s)

    def out(line: Column) -> Column:
        s = strip(line)
        code = (line.startswith("    ") | line.startswith("\t")) & ~s.rlike(r"\A[-*>#]")
        drop = s.rlike(f"(?U){BADGE}|{LINK_REF}") | s.startswith("|") | s.rlike(RULE_LINE) | code
        return F.when(s == "", "").when(drop, F.lit(None)).otherwise(let(inline(s), lambda x: F.when(x != "", x)))

    kept = F.filter(F.transform(a, out), lambda s: s.isNotNull())
    return strip(squeeze_blank_lines(F.array_join(kept, "\n")))


def clean_markdown(text: Column) -> Column:
    return clean_lines(lines(blank_block_column(F.coalesce(text, F.lit("")))))


def looks_like_prose(text: Column) -> Column:
    """At least 60 characters and 8 words, mostly letters and spaces, no pragma, bare URL or licence."""
    t = strip(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(t, rf"[^\p{{L}}{WS}]", ""))
    return (F.length(t) >= PROSE_CHARS) & ~t.rlike(f"{IU}{PRAGMA}|{URL_ONLY}") & ~t.rlike(IU + LICENSE) & (F.regexp_count(t, F.lit("[A-Za-z']{2,}")) >= 8) & (letters / F.greatest(F.length(t), F.lit(1)) > 0.6)


def distinct_key(text: Column) -> Column:
    """What first-wins distinct compares: white space collapsed, lower case."""
    return F.lower(F.regexp_replace(text, rf"[{WS}]+", " "))


def doc_priority(path: Column) -> Column:
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]*)/*\z", 1)
    starts = lambda *xs: name.rlike(r"\A(?:" + "|".join(xs) + ")")
    return F.when(starts("readme"), 0).when(starts("contributing", "code_of_conduct", "architecture", "design"), 1).when(low.startswith("docs/") | F.contains(low, F.lit("/docs/")), 2).when(starts("agents", "claude"), 3).otherwise(4)


__all__ = ["blank_block_column", "clean_lines", "clean_markdown", "collapse", "distinct_key", "doc_priority", "is_noise_commit", "looks_like_prose", "strip_trailers"]
