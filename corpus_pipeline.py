"""The corpus pipeline: documents through the stages, each written as Parquet and read again.

Order: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlake.llm import classifier, decontaminate, line_dedup, packing, queries, simhash
from offerlake.llm.common import dropped, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.select(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line repeats."""
    return line_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their token ids."""
    return packing.pack(docs, queries.tokenizer_path(), with_ids=True)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near), ("benchmark decontamination", benchmark), ("packing", pack)]

#: SQL can't express the classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if k:  # what a stage has read is its predecessor's table, and nobody else's
            dropped(before)
    return docs
