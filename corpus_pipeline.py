"""The corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's documents.

A document with a null doc_id passes every stage that decides by doc_id. Rows that repeat a doc_id are one document to the stages that decide by it. A null or empty text is scored like any text, has one empty line, no shingles and length 1; a null one stays
null. Texts of any length are taken whole. Stages keep all columns of documents, whatever further ones there are and whatever their names, and change none but text and n_chars. Empty documents give no rows; without labels nothing is
rejected, and without benchmark items nothing goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revloom.llm import decontamination, line_dedup, ngram_join, packing, quality
from revloom.llm.common import table, written


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of a smaller doc_id holds; a document may be left empty."""
    return line_dedup.rewrite(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest doc_id."""
    gone = ngram_join.join(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    gone = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in a length bucket and a batch."""
    return packing.pack(docs.withColumn("doc_id", F.col("doc_id").cast("long")))


STAGES = [
    ("quality", good_only),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The classifier's scores can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
