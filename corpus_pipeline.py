"""Documents to packed training sequences: five stages, each reading what its predecessor kept.

Of every stage: an empty table gives an empty one with the same columns; columns beyond those of documents go along, whatever their names;
null and repeated ids are rows like others; null and empty texts are clean, similar to nothing, without personal data, and one empty piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loam.llm import jaccard_join, mixing, packing, pii, toxicity
from loam.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the grammar learns from the labels of the documents given."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar shingles, those of the least doc_id; rows with a null id all stay."""
    return jaccard_join.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars is counted anew where the text changed."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its block comes in the mix of sources, at least once."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of a document in a training sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The tagger and the grammar can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the folder that executors share and read again."""
    root = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{root}/{k}-{name}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
