"""The corpus pipeline: junk and copies go, sources are mixed to their weights, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reliefspark.llm import exact_dedup, mixing, ngram_join, packing, quality
from reliefspark.llm.common import read_table, release, tables, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts go."""
    return quality.kept(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, one of the largest id stays; a row that only shares its id with a dropped one stays."""
    return exact_dedup.kept_rows(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, directly or by others, that with the least id stays."""
    return ngram_join.kept_rows(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a document taken twice is there in two rows."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_one_copy),
    ("near-duplicate join", keep_one_near_copy),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and reread; a stage's own tables go when it is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = tables()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(since=before, keep=1)
    return docs
