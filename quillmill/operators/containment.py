"""Which strings hold which others: an inverted index of their short substrings, then an exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the substrings that are looked up; shorter needles are looked up as a whole.
GRAM = 3


def grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of ``size`` characters; none if the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def held_in(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay): all pairs of the distinct strings where needle stands within hay; nulls and empty strings match nothing.

    ``needles`` has a column needle, ``hays`` a column hay. A needle meets only the
    strings that hold its rarest substring of GRAM characters (the needle itself if
    shorter), so a substring that many hold costs only needles that have no rarer one.
    """
    n = needles.where("needle <> ''").select("needle").distinct()
    h = hays.where("hay <> ''").select("hay").distinct()
    own = n.select("needle", F.least(F.length("needle"), F.lit(GRAM)).alias("size"))
    own = own.select("needle", F.explode(grams(F.col("needle"), F.col("size"))).alias("gram"))
    sizes = [r["size"] for r in n.select(F.least(F.length("needle"), F.lit(GRAM)).alias("size")).distinct().collect()]  # GRAM rows at most
    posts = h.select("hay", F.explode(F.concat(*[grams(F.col("hay"), s) for s in sizes] or [F.array().cast("array<string>")])).alias("gram"))
    often = posts.groupBy("gram").agg(F.count("*").alias("df"))
    known = own.join(often, "gram", "left")
    rarest = known.groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best")).where("best.df > 0").select("needle", F.col("best.gram").alias("gram"))
    return rarest.join(posts, "gram").where(F.contains("hay", F.col("needle"))).select("needle", "hay")


def linked(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): pairs of the distinct strings of columns a and b of which one stands within the other, or that are equal."""
    there = held_in(left.select(F.col("a").alias("needle")), right.select(F.col("b").alias("hay"))).select(F.col("needle").alias("a"), F.col("hay").alias("b"))
    back = held_in(right.select(F.col("b").alias("needle")), left.select(F.col("a").alias("hay"))).select(F.col("hay").alias("a"), F.col("needle").alias("b"))
    return there.union(back).distinct()
