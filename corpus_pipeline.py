"""A training corpus from raw documents: quality, toxicity, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import decontamination, packing, quality_classifier, simhash, toxicity
from scholia.llm.queries import table, vocabulary
from scholia.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return quality_classifier.accepted(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.harmless(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, packed into sequences along the curve."""
    return packing.pack(docs, vocabulary(), end_id=1)


STAGES = [("quality classifier", quality), ("toxicity", harmless), ("SimHash near-dedup", deduplicated), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: SQL has neither the classifiers nor XXH64; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written and reread as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
