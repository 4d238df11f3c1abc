"""Triage: trim quotes, score, drop near duplicates, fill the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.budget import BUDGET_CHARS, fill
from quillmill.operators.relevance import score_binary, score_text, strip_quoted
from quillmill.operators.similarity import survivors
from quillmill.session import Scratch


def scored_samples(samples: DataFrame) -> DataFrame:
    """samples (sample_id, pos, origin, text) with quotes trimmed, and score, reason, verdict."""
    out = samples.withColumn("_q", strip_quoted(F.col("text"))).withColumn("_t", F.col("_q.text"))
    out = score_text(out, "_t", "origin")
    quoted = F.col("_q.removed") >= 0.5
    reason = F.when(quoted & (F.col("verdict") == "drop"), "mostly a quoted reply from someone else").when(quoted & (F.col("reason") != "short, but it does sound like you"), "trimmed a quoted reply, kept your part").otherwise(F.col("reason"))
    score = F.when(quoted & (F.col("verdict") == "drop"), F.least("score", F.lit(0.15))).otherwise(F.col("score"))
    text = F.when(F.col("_q.removed") > 0, F.col("_t")).otherwise(F.coalesce("text", F.lit("")))
    return out.withColumns({"reason": reason, "score": score, "text": text}).drop("_q", "_t")


def triage(samples: DataFrame, files: DataFrame | None = None, budget_chars: int = BUDGET_CHARS) -> DataFrame:
    """Every sample and file with score, reason, verdict, is_binary and kept; nothing is lost.

    samples: sample_id, pos, origin, text. files: sample_id, pos, filename, mimetype.
    Rank is score down, text length up, origin, then pos; pos must be unique.
    """
    cols = ["sample_id", "pos", "origin", "text", "score", "reason", "verdict"]
    rows = scored_samples(samples).select(*cols).withColumn("is_binary", F.lit(False))
    if files is not None:
        named = score_binary(files).withColumn("origin", F.col("filename")).withColumn("text", F.lit(None).cast("string"))
        rows = rows.unionByName(named.select(*cols).withColumn("is_binary", F.lit(True)))
    with Scratch(samples.sparkSession) as scratch:
        rows = scratch.stash(rows.withColumn("_cost", F.coalesce(F.length("text"), F.lit(0))))
        rank = [-F.col("score"), F.col("_cost"), F.col("origin"), F.col("pos")]
        found = survivors(rows.where("not is_binary and verdict <> 'drop'"), "sample_id", "text", rank).where("twin is not null")
        names = scratch.stash(found.join(rows.select(F.col("sample_id").alias("twin"), F.col("origin").alias("twin_origin")), "twin").select(F.col("id").alias("sample_id"), "twin_origin"))

        def judged(some: DataFrame) -> DataFrame:
            twin = F.col("twin_origin").isNotNull() & ~F.col("is_binary")
            told = {"verdict": F.when(twin, "drop").otherwise(F.col("verdict")), "reason": F.when(twin, F.concat(F.lit("nearly identical to "), "twin_origin")).otherwise(F.col("reason")), "score": F.when(twin, F.least("score", F.lit(0.2))).otherwise(F.col("score"))}
            return some.join(names, "sample_id", "left").withColumns(told).drop("twin_origin")

        eligible = (F.col("verdict") != "drop") & ~(F.col("is_binary") & (F.col("verdict") == "unsure"))
        chosen = fill(judged(rows.drop("text")).where(eligible), "pos", F.col("_cost"), rank, budget_chars, scratch)
        out = judged(rows).join(chosen.select(F.col("id").alias("pos"), F.lit(True).alias("_chosen")), "pos", "left")
        kept = eligible & (F.coalesce("_chosen", F.lit(False)) | (F.col("_cost") == 0))
        out = out.withColumns({"kept": kept, "reason": F.when(eligible & ~kept, "no room left in this run").otherwise(F.col("reason"))})
        return scratch.finish(out.select(*cols, "is_binary", "kept"))


def picked_positions(raw: str, count: int) -> list[int] | None:
    """1-based positions of a selection such as ``1,3 5``, each once; None if any part is no position."""
    parts = raw.replace(",", " ").split()
    if not all(p.isdigit() and 1 <= int(p) <= count for p in parts):
        return None
    return list(dict.fromkeys(map(int, parts)))


def put_back(judged: DataFrame, positions: list[int], rank: list[Column]) -> DataFrame:
    """judged with kept set for the rejected rows at these places in rank order (only the first so many rows are ranked)."""
    first = judged.where("not kept").orderBy(*rank).limit(max(positions, default=0)).withColumn("_spot", F.row_number().over(Window.orderBy(*rank)))  # at most max(positions) rows
    chosen = first.where(F.col("_spot").isin(*positions)).select("pos", F.lit(True).alias("_back"))
    return judged.join(F.broadcast(chosen), "pos", "left").withColumn("kept", F.col("kept") | F.coalesce("_back", F.lit(False))).select(*judged.columns)


def unpack(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, files) that are kept."""
    kept = judged.where("kept")
    return kept.where("not is_binary"), kept.where("is_binary")
