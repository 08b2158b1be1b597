"""The corpus pipeline: five operators in a row, each on all that the one before has kept.

Every stage's result is written as Parquet under the shared checkpoint folder
and read back as the next stage's documents.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm.common import stored
from hourglass.llm.decontamination import keep_uncontaminated
from hourglass.llm.language import keep_languages
from hourglass.llm.ngram_jaccard import keep_one_of_each
from hourglass.llm.packing import pack_lengths, word_lengths
from hourglass.llm.private_data import mask_private


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and holds most of the text (the model learns from all with a lang)."""
    return keep_languages(docs, F.lit(True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one_of_each(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return mask_private(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words stand in the packed sequences."""
    return pack_lengths(word_lengths(docs))


STAGES = [("language ID", language_stage), ("n-gram Jaccard join", near_duplicate_stage), ("benchmark decontamination", decontamination_stage),
          ("PII", private_data_stage), ("best-fit packing", packing_stage)]

#: SQL cannot express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
