"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark overlaps, packing.

STAGES are applied in order, each to what the one before kept, written as Parquet in the shared folder and read again.
All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontam, near, packing, quality, suffix
from rasterloom.llm.common import discard, materialise, table
from rasterloom.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; a host is a source, a path its language section."""
    labels = quality.bad_labels(table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return near.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in an earlier document."""
    return suffix.cut_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without overlap with the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 2048."""
    return packing.pack_documents(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("token_bytes")).drop("token_bytes")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier, the suffix sort and the tokenizer have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, before)
        before = path
    return docs
