"""A corpus from raw documents to shards: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. SQL cannot express the first stage
(a trained classifier), so the pipeline has no oracle. tests/llm/test_pipeline.py
holds each stage on its own input: the classifier against planted good and bad
documents, near dedup and decontamination against brute force, mixing against
the SQL of op1, sharding against its laws, and run() against the chain of its
stages. The stages take empty tables and columns with names that the operators
use inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrain.llm import classifier, decontaminate, minhash, mixing, sharding
from lexigrain.storage import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it scores below one half go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.good(docs, labels, Scratch(spark, "quality"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates on five-word shingles at a similarity of 0.8: one document of each group stays."""
    return minhash.drop_copies(docs, Scratch(spark, "copies"), width=5, num=80, den=100)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a ten-word window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items, Scratch(spark, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 (repeating), 150 % of all words, at most two epochs of a source."""
    return mixing.apply(docs, Scratch(spark, "mixture"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 shards of equal row counts, equal texts together; adds shard and slot."""
    return sharding.assign(docs, Scratch(spark, "shards"))


STAGES = [
    ("quality classifier", keep_good),
    ("near dedup", keep_one),
    ("benchmark decontamination", keep_clean),
    ("mixing sources", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
