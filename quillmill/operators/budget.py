"""Character budgets: shares per kind, trimming to a quota, and the skip-greedy fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillmill.operators.running import running
from quillmill.session import Scratch

# The default budget and each kind's share of it.
BUDGET_CHARS = 180_000
KIND_SHARE = {"commit": 0.40, "doc": 0.25, "comment": 0.20, "pr": 0.15}


def quotas(totals: dict[str, int], budget: int, shares: dict[str, float] = KIND_SHARE) -> dict[str, int]:
    """Shares of the budget; what a kind does not need goes to those that want more, by share, for as many turns as kinds."""
    out = {k: int(budget * s) for k, s in shares.items()}
    need = {k: totals.get(k, 0) for k in shares}
    for _ in shares:
        over = [k for k in shares if need[k] > out[k]]
        spare = sum(max(out[k] - need[k], 0) for k in shares)
        if not over or spare <= 0:
            break
        whole = sum(shares[k] for k in over)
        out = {k: out[k] + int(spare * (shares[k] / whole)) if k in over else min(out[k], need[k]) for k in shares}
    return out


def trim_to_quota(df: DataFrame, kind: str, size: Column, pos: str, quota: dict[str, int]) -> DataFrame:
    """Rows of each kind after its longest (then earliest) rows are dropped until the quota is met; none where it is 0 or absent.

    Sums per kind and size give the size at which a kind meets its quota; rows of that
    one size are counted up by ``pos`` (a whole number, no two alike in a kind) in
    blocks, so no task holds a kind, or all rows of a size that all have.
    """
    cap = F.create_map(*[F.lit(x) for kv in (quota or {"": 0}).items() for x in kv])[F.col(kind)]
    out = df.withColumn("_size", size.cast("long"))
    per = out.groupBy(kind, "_size").agg(F.count("*").alias("_n")).withColumn("_sum", F.col("_n") * F.col("_size"))  # a row for each size that occurs
    upto = F.sum("_sum").over(Window.partitionBy(kind).orderBy("_size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = per.withColumn("_rest", upto).withColumn("_cap", cap.cast("long")).where("_cap > 0")
    # rows of a size stay while all rows up to them fit: so many of the size go
    goes = F.greatest(F.lit(0), F.least(F.col("_n"), F.ceil((F.col("_rest") - F.col("_cap")) / F.greatest("_size", F.lit(1)))))
    cut = met.withColumn("_go", F.when(F.col("_size") > 0, goes).otherwise(F.when(F.col("_rest") > F.col("_cap"), F.col("_n")).otherwise(0)))
    last = cut.groupBy(kind).agg(F.coalesce(F.max(F.when(F.col("_go") < F.col("_n"), F.struct("_size", "_go"))), F.struct(F.lit(-1).cast("long").alias("_size"), F.lit(0).cast("long").alias("_go"))).alias("_last"))
    rows = out.join(F.broadcast(last), kind).where(F.col("_size") <= F.col("_last._size"))  # a row a kind
    edge = (F.col("_size") == F.col("_last._size")) & (F.col("_last._go") > 0)
    late = running(rows.where(edge), [kind], pos, {"_rank": F.lit(1)}).where(F.col("_rank") > F.col("_last._go")).drop("_rank")
    return rows.where(~edge).unionByName(late).select(*df.columns)


#: Rows that a walk takes to the driver at once, and ranges that a longer stretch is cut into.
LEAF, RANGES = 20_000, 64


def fill(df: DataFrame, id_col: str, cost: Column, rank: list[Column], budget: int, scratch: Scratch, leaf: int = LEAF, ranges: int = RANGES) -> DataFrame:
    """(id): what a walk in rank order keeps: a row is skipped if something is kept and its cost no longer fits.

    Rows are cut into ranges of rank, of which the driver sees the sum and the least
    cost. A range that fits is kept as a whole, one whose least cost no longer fits is
    skipped, and only others are looked into: cut into ranges again, or walked row by
    row where they have at most ``leaf`` rows. Looking into a range keeps a row of it at least, so
    there are few. Rows of cost 0 always stay and are not listed.
    """
    order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
    rows = scratch.stash(df.select(F.col(id_col).alias("id"), cost.cast("long").alias("cost"), order.alias("r")))
    empty = rows.select("id").limit(0)
    head = rows.agg(F.min(F.struct("r", "cost", "id")).alias("x"), F.count("*").alias("n")).first()
    if not head["n"]:
        return empty
    one = head["x"]["id"] if head["x"]["cost"] > 0 else None  # the first row of all stays, whatever it costs
    used = max(head["x"]["cost"], 0)
    whole: list[DataFrame] = []
    single = [] if one is None else [one]

    def walk(part: DataFrame, n: int) -> None:
        nonlocal used
        if n <= leaf:
            for row in part.where(F.col("cost") <= budget - used).orderBy("r").collect():
                if used + row["cost"] <= budget:
                    single.append(row["id"])
                    used += row["cost"]
            return
        cut = scratch.stash(part.repartitionByRange(ranges, "r").withColumn("_part", F.spark_partition_id()))
        keep = []
        for s in cut.groupBy("_part").agg(F.sum("cost").alias("sum"), F.min("cost").alias("least"), F.count("*").alias("n")).orderBy("_part").collect():  # ``ranges`` rows
            if used + s["sum"] <= budget:
                keep.append(s["_part"])
                used += s["sum"]
            elif used + s["least"] <= budget:
                inner = cut.where((F.col("_part") == s["_part"]) & (F.col("cost") <= budget - used)).drop("_part")
                walk(inner, s["n"] if s["n"] <= leaf else inner.count())
        if keep:
            whole.append(cut.where(F.col("_part").isin(keep)).select("id"))

    rest = rows.where(F.col("cost") > 0)
    if one is not None:
        rest = rest.where(~F.col("id").eqNullSafe(F.lit(one)))
    walk(rest, head["n"])
    schema = StructType([StructField("id", rows.schema["id"].dataType)])
    return reduce(DataFrame.union, whole, rows.sparkSession.createDataFrame([(i,) for i in single], schema))  # rows of a few ranges at most
