"""A corpus pipeline: quality, toxicity, near duplicates, mixing and packing of ``documents``.

Each stage works on all that the one before kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oplake.llm import jaccard, mixing, packing, quality, toxicity
from oplake.llm.common import scratch, short_batches, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose naive Bayes support vector score reaches 0.3."""
    short_batches(spark)
    return quality.keep_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression does not find toxic."""
    short_batches(spark)
    return toxicity.keep_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, up to three times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: The stages learn, hash and tokenise, which SQL does not express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
