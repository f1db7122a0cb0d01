"""The corpus pipeline: rated out, deduplicated twice, mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. run() writes each
stage's result to the shared folder as Parquet and reads it for the next, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answergauge.llm import exact_dedup, mixing, packing, quality_classifier, queries, simhash, store


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It is trained on the rated documents among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(docs, quality_classifier.grades_of_labels(labels), 3)
    return quality_classifier.select_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    index = exact_dedup.DigestIndex(spark, store.new_path(spark, "digests"))
    out = exact_dedup.drop_duplicates(docs, index)
    index.close()
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The classifier's weights and the tokenizer's ids aren't SQL's; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = store.new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
