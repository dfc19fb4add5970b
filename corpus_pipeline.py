"""A training corpus from raw documents: five stages, each working on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.llm.byte_bpe import round_trip
from scoreframe.llm.common import shared_path, table
from scoreframe.llm.containment import keep_uncontaminated
from scoreframe.llm.near_duplicates import keep_one
from scoreframe.llm.personal_data import redact_documents
from scoreframe.llm.toxicity import keep_clean, train

#: Near-duplicates share this share of their distinct runs of five words, in percent.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, finds toxic go.

    Null and empty texts score as a text without words and stay; repeated rows share their verdict; without labels all stay.
    """
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays, with all of its rows.

    Null and empty texts are like nothing and stay, as do rows with a null id.
    """
    return keep_one(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item of the benchmark go; null and empty texts, and without items all, stay."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; n_chars, where there is one, follows the text; null and empty texts stay as they are."""
    out = redact_documents(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's number of tokens and the digests of its ids and of what they decode to; null and empty texts have none."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the trained classifiers nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read back, as lineage ends there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
