"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

All stages but the last return the columns of documents (extra columns stay as
they are). Rows with a null doc_id pass every filter that goes by id only if the
operator itself keeps them; rows that share a doc_id stand or fall together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, jaccard_join, langid, mixing, pii
from quillmill.llm.common import Scratch, sized

#: Near copies are documents whose sets of so many words a shingle have so many hundredths in common (op10 has values of its own).
NEAR_WORDS, NEAR_PCT = 5, 80
#: A language is rejected below this probability (and where the text has no letter).
LEAST_SCORE = 0.3


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named __0, __1, .. so that no extra column meets an operator's own names; the new name of each."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only numbered()'s columns, by the names that they had."""
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set lang to the predicted language; documents without letters or with an unsure language go."""
    rows, name = numbered(docs)
    model = langid.fit_language_model(rows, name["doc_id"], name["text"], name["lang"])
    said = langid.predict_languages(rows, model, name["text"], tuple(rows.columns))
    kept = said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return named(kept.withColumn(name["lang"], F.col("lang_pred")), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the document with the smallest id stays."""
    rows, name = numbered(docs)
    key = name["doc_id"]
    classes = jaccard_join.jaccard_classes(rows, key, name["text"], n=NEAR_WORDS, pct=NEAR_PCT)
    gone = classes.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return named(rows.join(sized(gone), key, "left_anti"), name)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each span of personal data by its kind; n_chars follows."""
    rows, name = numbered(docs)
    found = pii.find_pii(rows, name["doc_id"], name["text"], keep=tuple(c for c in rows.columns if c != name["text"]), redact=True)
    found = found.withColumn(name["text"], F.col("redacted")).withColumn(name["n_chars"], F.length("redacted").cast("long"))
    return named(found, name)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics meet flattened shares."""
    rows, name = numbered(docs)
    measured = rows.select(*(F.col(name[c]).alias(c) for c in ("doc_id", "text", "lang", "source")))
    kept = mixing.mix(mixing.with_measures(measured)).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return named(rows.join(sized(kept), F.col(name["doc_id"]).eqNullSafe(F.col("kept_id")), "left_semi"), name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return bpe.bpe_encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encode", encode),
]
#: Models are trained on the way, which SQL cannot express; tests compare each stage's decisions with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    with Scratch(spark) as scratch:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, stage in STAGES[:-1]:
            docs = scratch.stash(stage(spark, docs, sf_dir))
        return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
