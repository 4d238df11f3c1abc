"""Running sums and last values over long sequences, by blocks: no task holds a whole sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block, which is the longest stretch that one task puts in order.
BLOCK = 1 << 16


def running(df: DataFrame, keys: list[str], pos: str, sums: dict[str, Column], lasts: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """df with columns: ``sums`` added up to and including each row, ``lasts`` the last value that is not null.

    ``pos`` is a whole number that orders the rows of a key (a null key is one like
    any other); rows at one position share what they add up to. Blocks of positions
    are scanned on their own; what a block starts from comes from the blocks before
    it, a row each.
    """
    lasts = lasts or {}
    rows = df.withColumn("_block", F.floor(F.col(pos) / block).cast("long"))
    inside = Window.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({**{f"_sum_{n}": F.sum(c).over(inside) for n, c in sums.items()}, **{f"_last_{n}": F.last(c, ignorenulls=True).over(inside) for n, c in lasts.items()}})
    per = rows.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_add_{n}") for n, c in sums.items()), *(F.max_by(c, F.when(c.isNotNull(), F.col(pos))).alias(f"_end_{n}") for n, c in lasts.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_block").alias("_from"), *(F.sum(f"_add_{n}").over(before).alias(f"_base_{n}") for n in sums), *(F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_held_{n}") for n in lasts))
    same = F.col("_block").eqNullSafe(F.col("_from"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    out = local.join(start, same)
    added = {n: F.coalesce(f"_sum_{n}", F.lit(0)) + F.coalesce(f"_base_{n}", F.lit(0)) for n in sums}
    held = {n: F.coalesce(f"_last_{n}", f"_held_{n}") for n in lasts}
    return out.withColumns({**added, **held}).select(*df.columns, *added, *held)
