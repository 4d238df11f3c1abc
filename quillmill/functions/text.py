"""Text expressions that agree with Python's rules for white space, lines and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends as Python's str methods take them.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row even inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    # one match from both ends; a replacement would try every run of white space in a long text
    return F.regexp_extract(c, rf"(?s)\A[{WS}]*+(.*[^{WS}])", 1)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<![{WS}])[{WS}]++\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{WS}]")


def lines(c: Column) -> Column:
    """Lines without their ends; no empty last item."""
    return let(F.split(c, LINE_END, -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(strip(c), rf"[{WS}]+", " ")


def letter_words(c: Column) -> Column:
    """ASCII letter words with apostrophes, in lower case."""
    return F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit("([a-z']+)"), 1)


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")
