"""From raw documents to packed training windows in five stages.

Each stage works on all rows that the one before it kept, returns them as a
DataFrame, and is written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import classifier, packing, pii, rules, simhash
from sparkloom.llm._common import materialize, release, scratch_scope, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the production policy go."""
    return rules.keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, terms that disclose it are generalised or removed."""
    return pii.sanitize(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: A fitted model, connected components and a packer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage made on its way is deleted when its
    result is written, and that result when the next one is."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(keep=name):
            docs = materialize(stage(spark, before, sf_dir), name)
        release(before)
        before = docs
    return docs
