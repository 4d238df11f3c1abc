"""The dry-run report: samples, totals and findings as tables, and one rendering of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.cost import estimate_tokens, with_cost


def sample_tokens(samples: DataFrame) -> DataFrame:
    """samples with tokens filled in where they are not known yet."""
    return samples.withColumn("tokens", F.when(F.coalesce("tokens", F.lit(0)) > 0, F.col("tokens")).otherwise(estimate_tokens(F.col("text"))).cast("long"))


def totals(samples: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """n, chars, tokens, and with findings n_findings and n_high."""
    per = sample_tokens(samples).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    if findings is None:
        return per
    return per.crossJoin(F.broadcast(findings.agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "high").alias("n_high"))))  # one row each


def totals_by_kind(samples: DataFrame, kind: str = "kind") -> DataFrame:
    """kind, n, chars, tokens and is_total: a row per kind, and one for all."""
    per = sample_tokens(samples).rollup(kind).agg(F.grouping(kind).cast("boolean").alias("is_total"), F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return per.select(kind, "is_total", "n", "chars", "tokens")


def ordered_findings(findings: DataFrame) -> DataFrame:
    """By severity (high first), origin, line."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return findings.orderBy(rank, "origin", "line")


def render(samples: DataFrame, findings: DataFrame, most: int = 1000, model: str | None = None) -> str:
    """A text report of at most ``most`` samples and findings, with the input's cost for a model."""
    t = totals(samples, findings).first()
    rows = sample_tokens(samples).orderBy("pos").limit(most).collect()
    out = [f"{i:>4}. {r['kind']}: {r['origin']} ({len(r['text'] or '')} chars, ~{r['tokens']} tokens)" for i, r in enumerate(rows, 1)]
    out += [f"total: {t['n']} samples, {t['chars']} chars, ~{t['tokens']} tokens", f"findings: {t['n_findings']} ({t['n_high']} high)"]
    if model:
        cost = samples.sparkSession.createDataFrame([(t["tokens"], 0, model)], "i long, o long, m string")
        dollars = with_cost(cost, "i", "o", "m").first()["cost"]
        out.append(f"cost ({model}): " + ("unknown" if dollars is None else f"${dollars:.4f} for the input"))
    out += [f"  [{r['severity']}] {r['rule']} {r['origin']}:{r['line']} {r['excerpt']}" for r in ordered_findings(findings).limit(most).collect()]
    return "\n".join(out)
