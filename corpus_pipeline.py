"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the documents of the next one.  All but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.llm.arrays import forget, saved
from pressgrid.llm.compression_bands import good_documents
from pressgrid.llm.decontamination import clean_documents
from pressgrid.llm.line_frequency import without_boilerplate
from pressgrid.llm.packing import packed_documents
from pressgrid.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base rules keep."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    left = without_boilerplate(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packed_documents(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_dedup),
          ("decontamination", decontamination), ("packing", packing)]

#: zstandard, XXH64 and the tokenizer have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        forget(*written)
        written = [docs]
    return docs
