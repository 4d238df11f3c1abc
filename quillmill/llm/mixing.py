"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token counts are summed per cell of the dimensions; cells are raked until every
dimension's marginal shares meet their targets; a document's probability is its
cell's weight over the cell's tokens, scaled so that the largest is one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Scratch

#: How far a marginal may be from its target, relatively; turns without a gain of a hundredth after which targets count as out of reach.
CLOSE, PATIENCE = 1e-4, 5
#: Targets that are not given are shares to this power: large categories weigh less than they hold.
FLATTEN = 0.85


def token_count(text: Column) -> Column:
    """Words between white space."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shape_topic(text: Column, tokens: Column) -> Column:
    """A stand-in topic from the make-up of the text, for corpora without topic labels."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    return (
        F.when(share("|#*<>{}") > 0.02, "markup")
        .when(share("0123456789") > 0.02, "numeric")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "capitals")
        .when(tokens < 100, "short")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def flattened(cells: DataFrame, dim: str) -> DataFrame:
    """(dim, target): shares of tokens to the power FLATTEN, made to sum to one."""
    per = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(FLATTEN)).alias("t"))
    total = per.agg(F.sum("t")).first()[0] or 1.0
    return per.select(dim, (F.col("t") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """cells with column w, whose shares by each dimension are the targets as nearly as cells allow.

    ``targets[dim]`` has columns dim and target. A value without a target gets weight 0.
    Turns go on until every marginal is within CLOSE of its target; where PATIENCE turns
    bring no gain, the targets contradict each other or the cells, which is warned of.
    """
    goals = {d: scratch.stash(targets[d] if d in targets else flattened(cells, d)) for d in dims}
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = scratch.stash(cells.withColumn("w", F.col("tokens") / F.lit(total)))
    best, stale = float("inf"), 0
    while stale < PATIENCE:
        worst = F.lit(0.0)
        for d in dims:
            now = out.groupBy(d).agg(F.sum("w").alias("now")).join(goals[d], d, "left")
            factor = F.when(F.col("now") > 0, F.coalesce("target", F.lit(0.0)) / F.col("now")).otherwise(F.lit(0.0))
            out = out.join(now.select(d, factor.alias("f")), d).withColumn("w", F.col("w") * F.col("f")).withColumn(f"off_{d}", F.when(F.col("w") > 0, F.abs(F.col("f") - 1)).otherwise(0.0)).drop("f")
            worst = F.greatest(worst, F.max(f"off_{d}"))
        turn = scratch.stash(out)
        out = turn.drop(*(f"off_{d}" for d in dims))
        off = turn.agg(worst.alias("x")).first()["x"] or 0
        if off < CLOSE:
            return out
        stale = 0 if off < 0.99 * best else stale + 1
        best = min(best, off)
    warnings.warn(f"targets are not all met: a marginal is off by {off:.3g} of its target", stacklevel=2)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", dims: tuple[str, ...] = ("source", "lang", "topic"), tokens_col: str = "n_tokens", targets: dict[str, DataFrame] | None = None, seed: str = "mix") -> DataFrame:
    """docs' ``id_col``, dims and tokens, with probability and kept.

    ``docs`` has a count of tokens and the dimensions as columns; null is a value like
    any other. kept compares the probability with a number in 0..1 hashed from the id
    and ``seed``, so reruns and lost executors give the same sample; rows with one id
    fall alike. Rows without tokens take no weight and are kept with the
    probability of their cell, or 0 where the cell has no tokens at all. An empty
    table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        # null is spelt out so that joins match it
        spelt = [F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("-")).alias(f"d{i}") for i, d in enumerate(dims)]
        rows = scratch.stash(docs.select(F.col(id_col).alias("id"), *(F.col(d) for d in dims), F.col(tokens_col).cast("long").alias("tokens"), *spelt))
        keys = [f"d{i}" for i in range(len(dims))]
        cells = scratch.stash(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")))
        goals = {keys[i]: targets[d].select(F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("-")).alias(keys[i]), "target") for i, d in enumerate(dims) if targets and d in targets}
        raked = rake(cells.where("tokens > 0"), keys, goals, scratch)
        rates = raked.select(*keys, (F.col("w") / F.col("tokens")).alias("rate"))
        top = rates.agg(F.max("rate")).first()[0] or 1.0
        rates = scratch.stash(rates.withColumn("p", F.col("rate") / F.lit(top)).drop("rate"))
        chance = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double")) / F.lit(float(1 << 53))
        out = rows.join(rates, keys, "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
        return scratch.finish(out.select(F.col("id").alias(id_col), *dims, F.col("tokens").alias(tokens_col), F.col("p").alias("probability"), (chance < F.col("p")).alias("kept")))


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with n_tokens and the stand-in topic."""
    counted = docs.withColumn("n_tokens", token_count(F.col(text_col)))
    return counted.withColumn("topic", shape_topic(F.col(text_col), F.col("n_tokens"))).drop(text_col)
