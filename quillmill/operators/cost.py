"""Token estimates and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Model, input, output, threshold, input and output over it (per million tokens).
PRICES = [
    ("gemini-3.7-flash", 0.75, 3.75, None, None, None),
    ("gemini-3.6-flash", 0.75, 3.75, None, None, None),
    ("gemini-3.5-flash-lite", 0.30, 2.50, None, None, None),
    ("gemini-3.5-flash", 1.50, 9.00, None, None, None),
    ("gemini-3.1-flash-lite", 0.25, 1.50, None, None, None),
    ("gemini-3.1-pro-preview", 2.00, 12.00, 200_000, 4.00, 18.00),
    ("gemini-3-flash-preview", 0.50, 3.00, None, None, None),
    ("gemini-2.5-pro", 1.25, 10.00, 200_000, 2.50, 15.00),
    ("gemini-2.5-flash-lite", 0.10, 0.40, None, None, None),
    ("gemini-2.5-flash", 0.30, 2.50, None, None, None),
]
UNPRICED = ["-image", "-live", "-tts", "-audio", "-embedding", "embedding-", "-veo", "imagen"]


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input double, output double, threshold long, input_over double, output_over double")


def estimate_tokens(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("long")


def normal_model(model: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(model, F.lit("")))), r"\Amodels/", "")
    for end in ("-latest", "-001", "-002", "-exp"):
        out = F.regexp_replace(out, end + r"\z", "")
    return out


def with_cost(df: DataFrame, tokens_in: str, tokens_out: str, model: str) -> DataFrame:
    """df with cost in dollars; null where the model has no known flat price.

    The price is the exact model's or that of the longest table name the model begins
    with; above a threshold of input tokens the higher rates hold for the whole call.
    """
    name = normal_model(F.col(model))
    p = F.create_map(*[x for m, *v in PRICES for x in (F.lit(m), F.array(*[F.lit(y).cast("double") for y in v]))])
    keys = F.array(*[F.lit(m) for m, *_ in sorted(PRICES, key=lambda r: (-len(r[0]), r[0]))])
    found = F.when(~F.exists(F.array(*map(F.lit, UNPRICED)), lambda u: F.contains(F.col("_m"), u)), F.get(F.filter(keys, lambda k: F.col("_m").startswith(k)), F.lit(0)))
    out = df.withColumn("_m", name).withColumn("_p", p[found])
    i, o = (F.greatest(F.col(c), F.lit(0)).cast("double") for c in (tokens_in, tokens_out))
    over = F.coalesce(i > F.col("_p")[2], F.lit(False))
    million = F.lit(1_000_000.0)
    cost = i / million * F.when(over, F.col("_p")[3]).otherwise(F.col("_p")[0]) + o / million * F.when(over, F.col("_p")[4]).otherwise(F.col("_p")[1])
    return out.withColumn("cost", cost).drop("_m", "_p")
